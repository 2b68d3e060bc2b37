"""Aggregations of season totals, rates and shares with stated null policies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.scalars import as_column, safe_divide

# The totals of a player season.
TOTALS = (
    "games_on_roster", "games_played", "games_started", "minutes", "field_goals_made", "field_goals_attempted", "three_point_field_goals_made", "three_point_field_goals_attempted",
    "free_throws_made", "free_throws_attempted", "offensive_rebounds", "defensive_rebounds", "rebounds", "assists", "steals", "blocks", "turnovers", "fouls", "points",
)
# The totals given per 40 minutes, by their short name.
PER_40 = {
    "points": "points", "rebounds": "rebounds", "assists": "assists", "steals": "steals", "blocks": "blocks", "turnovers": "turnovers", "fga": "field_goals_attempted", "tpa": "three_point_field_goals_attempted",
    "fta": "free_throws_attempted", "oreb": "offensive_rebounds", "dreb": "defensive_rebounds", "fouls": "fouls",
}


def total(c: Column | str, nulls: str = "keep") -> Column:
    """Sum; all-null groups give null (``keep``) or 0 (``zero``)."""
    x = as_column(c)
    return F.sum(x) if nulls == "keep" else F.coalesce(F.sum(x), F.lit(0))


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Mean over rows that have both and a positive weight; null where there is none."""
    v, w = as_column(value), as_column(weight)
    ok = v.isNotNull() & (w > 0)
    return F.sum(F.when(ok, v * w)) / F.nullif(F.sum(F.when(ok, w)), F.lit(0.0))


def rates(prefix: str = "") -> dict[str, Column]:
    """Ratios of totals; a zero denominator gives null."""
    c = lambda name: F.col(f"{prefix}{name}").cast("double")
    out = {
        "fg_pct": safe_divide(c("field_goals_made"), c("field_goals_attempted")),
        "three_pct": safe_divide(c("three_point_field_goals_made"), c("three_point_field_goals_attempted")),
        "ft_pct": safe_divide(c("free_throws_made"), c("free_throws_attempted")),
        "efg_pct": safe_divide(c("field_goals_made") + 0.5 * c("three_point_field_goals_made"), c("field_goals_attempted")),
        "ts_pct": safe_divide(c("points"), 2 * (c("field_goals_attempted") + 0.44 * c("free_throws_attempted"))),
        "assist_turnover_ratio": safe_divide(c("assists"), c("turnovers")),
        "three_attempt_rate": safe_divide(c("three_point_field_goals_attempted"), c("field_goals_attempted")),
        "free_throw_rate": safe_divide(c("free_throws_attempted"), c("field_goals_attempted")),
        "minutes_per_game": safe_divide(c("minutes"), c("games_played")),
        "start_rate": safe_divide(c("games_started"), c("games_played")),
    }
    return out | {f"{short}_per_40": safe_divide(40 * c(name), c("minutes")) for short, name in PER_40.items()}


def collapse_seasons(rows: DataFrame, keys: Sequence[str], nulls: str = "keep") -> DataFrame:
    """Totals of each key; ``rows`` may hold several teams of a season."""
    return rows.groupBy(*keys).agg(*[total(c, nulls).alias(c) for c in TOTALS if c in rows.columns])


def team_context(prefix: str = "") -> dict[str, Column]:
    """Possessions, rating and shooting ratios of a team's totals."""
    c = lambda name: F.col(f"{prefix}{name}").cast("double")
    possessions = c("field_goals_attempted") - c("offensive_rebounds") + c("turnovers") + 0.44 * c("free_throws_attempted")
    return {
        "possessions": possessions,
        "rating": safe_divide(100 * c("points"), possessions),
        "efg_pct": safe_divide(c("field_goals_made") + 0.5 * c("three_point_field_goals_made"), c("field_goals_attempted")),
        "turnover_rate": safe_divide(c("turnovers"), possessions),
        "assist_rate": safe_divide(c("assists"), c("field_goals_made")),
    }


def missingness(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Long table (by, feature, n_rows, n_missing, share_missing) in one aggregation."""
    wide = df.groupBy(by).agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = wide.unpivot([by, "n_rows"], list(columns), "feature", "n_missing")
    return long.withColumn("share_missing", F.round(F.col("n_missing") / F.col("n_rows"), 6))


def dense_years(grouped: DataFrame, year: str, first: int, last: int, zero: Sequence[str]) -> DataFrame:
    """Every year of the range, with zeros where nothing was counted."""
    spine = grouped.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias(year))
    return spine.join(grouped, year, "left").fillna(0, list(zero))


def crosstab_share(df: DataFrame, row: str, column: str) -> DataFrame:
    """Long cross-tabulation with each cell's share of its row."""
    cells = df.groupBy(row, column).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(row))  # a row's cells, not its records
    return cells.select(row, column, "n", F.round(F.col("n") / whole, 6).alias("share"))


def standardized_difference(df: DataFrame, group: Column, features: Sequence[str]) -> DataFrame:
    """Difference of means over the pooled deviation; null if a side has no variance."""
    parts = []
    for f in features:
        for side, cond in (("l", group), ("r", ~group)):
            x = F.when(cond, F.col(f).cast("double"))
            parts += [F.avg(x).alias(f"{f}|m{side}"), F.var_samp(x).alias(f"{f}|v{side}")]
    row = df.agg(*parts)
    each = [
        F.struct(F.lit(f).alias("feature"), F.col(f"`{f}|ml`").alias("ml"), F.col(f"`{f}|mr`").alias("mr"), ((F.col(f"`{f}|vl`") + F.col(f"`{f}|vr`")) / 2).alias("pooled")) for f in features
    ]
    smd = F.when(F.col("pooled") > 0, (F.col("ml") - F.col("mr")) / F.sqrt("pooled"))
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*").select("feature", F.round("ml", 6).alias("mean_left"), F.round("mr", 6).alias("mean_right"), F.round(smd, 6).alias("smd"))


def row_conflicts(cols: Sequence[Column]) -> Column:
    """True where the non-null values differ among themselves."""
    return F.size(F.array_distinct(F.array_compact(F.array(*cols)))) > 1


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns absent in a part are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
