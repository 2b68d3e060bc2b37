"""Composite pipelines: measurement sources, rosters, history, outcomes, modelling tables.

Each takes and gives DataFrames; what was dropped or found odd comes out as ledgers beside the
result, computed by aggregates over the same plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions.scalars import age_on_july_first, clean_id, college_position, number, normalize_position, safe_divide, split_qualifier, within
from quillspan.operators.aggregates import TOTALS, collapse_seasons, rates, row_conflicts, team_context, total, weighted_mean
from quillspan.operators.audit import NameRule, drop_empty_columns, leaking
from quillspan.operators.drift import normal_label
from quillspan.operators.joins import band_join, existence_flag, key_membership, latest_per, merge_rosters, validated_join
from quillspan.operators.windows import average_rank, with_previous

KEYS = ("player", "year")
# Columns that name, date or place a row and measure nothing.
NOT_MEASURED = (
    NameRule("an identifier", ("id",), ends=("_id",)),
    NameRule("a name", ("name",), ends=("_name",)),
    NameRule("the calendar", ("season", "year", "draft_year")),
    NameRule("a position", ("position",)),
)


@dataclass
class Source:
    """One row per key, with what happened to the raw columns."""

    table: DataFrame
    dropped: list[tuple[str, str]]
    collisions: list[tuple[str, str, str]]


def measured_columns(columns: Sequence[str]) -> tuple[dict[str, str], list[tuple[str, str]], list[tuple[str, str, str]]]:
    """(raw -> label, dropped with reason, collisions as (label, kept, lost)); the first label wins."""
    kept: dict[str, str] = {}
    dropped, collisions = [], []
    for raw in columns:
        label = normal_label(raw)
        if reason := leaking([label], NOT_MEASURED).get(label):
            dropped.append((raw, reason))
        elif label in kept.values():
            collisions.append((label, next(k for k, v in kept.items() if v == label), raw))
        else:
            kept[raw] = label
    return kept, dropped, collisions


def measurement_source(df: DataFrame, player: str, year: str, position: str | None = None, prefix: str = "combine_") -> Source:
    """Raw measurements as one row per (player, year): numbers averaged, position by majority.

    Columns are named by their normal labels; those without any number are dropped.
    """
    kept, dropped, collisions = measured_columns([c for c in df.columns if c not in (player, year, position)])
    rows = df.select(clean_id(F.col(f"`{player}`")).alias("player"), F.col(f"`{year}`").try_cast("int").alias("year"), *([normalize_position(F.col(f"`{position}`")).alias("position")] if position else []), *[number(F.col(f"`{raw}`")).alias(prefix + label) for raw, label in kept.items()])
    rows = rows.dropna(subset=list(KEYS))
    full = drop_empty_columns(rows)
    dropped += [(c, "no number in any row") for c in rows.columns if c not in full.columns]
    values = [c for c in full.columns if c.startswith(prefix)]
    aggs = [F.avg(c).alias(c) for c in values] + ([F.mode("position", deterministic=True).alias("position")] if "position" in full.columns else [])
    return Source(full.groupBy(*KEYS).agg(F.count("*").alias("n_rows"), *aggs).drop("n_rows"), dropped, collisions)


def cohort(sources: Mapping[str, DataFrame], chosen: DataFrame, how: str = "inner") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table, membership, conflicts): keys of all sources with the target ``chosen``.

    ``chosen`` holds the keys that were selected; the position is the first there is, in the
    order of the sources.
    """
    named = {n: df.withColumnRenamed("position", f"position_{n}") if "position" in df.columns else df for n, df in sources.items()}
    joined = merge_rosters(list(named.values()), KEYS, how)
    places = [F.col(f"position_{n}") for n, df in sources.items() if "position" in df.columns]
    if places:
        conflicts = joined.where(row_conflicts(places)).select(*KEYS, *places)
        joined = joined.withColumn("position", F.coalesce(*places)).drop(*[f"position_{n}" for n in sources])
    else:
        conflicts = joined.limit(0).select(*KEYS)
    table = existence_flag(joined, chosen, list(KEYS), "drafted")
    membership = key_membership(sources, list(KEYS)).where(F.col("sources_present") < len(sources))
    return table, membership, conflicts


def event_names(df: DataFrame, player: str, year: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(names, conflicts): one name per key, split off its qualifier; keys with several differ."""
    q = split_qualifier(name)
    rows = df.select(clean_id(player).alias("player"), F.col(year).try_cast("int").alias("year"), q.base.alias("base"), q.base_compact.alias("name"), q.qualifier_compact.alias("qualifier")).dropna(subset=list(KEYS)).distinct()
    several = rows.groupBy(*KEYS).agg(F.countDistinct("name").alias("n_names")).where("n_names > 1")
    return latest_per(rows, KEYS, F.length("base").desc(), F.col("base").asc()), several


def college_seasons(box: DataFrame) -> DataFrame:
    """(athlete, season): totals over teams, rates, and the primary team's name and position."""
    rows = box.where(F.col("athlete").isNotNull())
    main = latest_per(rows, ["athlete", "season"], F.col("minutes").desc_nulls_last(), F.col("games_played").desc_nulls_last(), F.col("team").asc_nulls_last())
    main = main.select("athlete", "season", "team", college_position("position").alias("position"))
    sums = collapse_seasons(rows, ["athlete", "season"])
    return validated_join(sums, main, ["athlete", "season"], "one_to_one").withColumns(rates())


def history_features(anchors: DataFrame, seasons: DataFrame, born: DataFrame, back: int = 6) -> tuple[DataFrame, DataFrame]:
    """(features, rejected ages) per anchor: last season, career, development and age.

    ``anchors``: athlete, anchor; ``seasons`` as from :func:`college_seasons`; ``born``:
    athlete, season, date_of_birth (the newest row that has one counts).
    """
    names = list(rates())
    rows = band_join(anchors, seasons, ["athlete"], "anchor", "season", -back, 0)
    rows = with_previous(rows, ["athlete"], "season", names)
    last = latest_per(rows, ["athlete"], F.col("season").desc())
    last = last.select(
        "athlete", F.col("season").alias("college_last_season"), (F.col("anchor") - F.col("season")).cast("double").alias("college_season_gap"), F.col("position").alias("college_position"),
        *[F.col(n).alias(f"college_last_{n}") for n in names], *[F.col(f"{n}_delta").alias(f"college_development_{n}") for n in names], F.col("season_gap").cast("double").alias("college_development_gap"),
    )
    career = rows.groupBy("athlete").agg(*[total(c).alias(c) for c in TOTALS], F.countDistinct("season").alias("college_seasons"), (F.max("season") - F.min("season") + 1).alias("college_span"))
    career = career.select("athlete", "college_seasons", "college_span", *[x.alias(f"college_career_{n}") for n, x in rates().items()])
    newest = latest_per(born.where("date_of_birth is not null"), ["athlete"], F.col("season").desc_nulls_last(), F.col("date_of_birth").asc()).select("athlete", "date_of_birth")
    out = anchors.join(last, "athlete", "left").join(career, "athlete", "left").join(newest, "athlete", "left")
    out = out.withColumn("_age", age_on_july_first("anchor", "date_of_birth")).withColumn("college_age_on_july_1", within("_age", 16, 35)).withColumn("has_college_data", F.col("college_last_season").isNotNull().cast("int"))
    rejected = out.where("_age is not null and college_age_on_july_1 is null").select("athlete", "anchor", "date_of_birth", F.col("_age").alias("age"))
    return out.drop("_age", "date_of_birth"), rejected


def outcomes(roster: DataFrame, seasons: DataFrame, stats: Sequence[str], years: int = 3) -> DataFrame:
    """Roster with the sums of the first ``years`` seasons; without seasons zeros.

    ``roster``: player, year; ``seasons``: player, season, gp, minutes and ``stats``.
    """
    sums = ["gp", "minutes", *stats]
    rows = band_join(roster.select(*KEYS), seasons.select("player", "season", *sums), ["player"], "year", "season", 0, years - 1)
    totals = rows.groupBy(*KEYS).agg(*[total(c, "zero").alias(f"nba_{c}_{years}y") for c in sums], F.countDistinct("season").alias(f"nba_seasons_{years}y"))
    made = roster.join(totals, list(KEYS), "left").fillna(0, [c for c in totals.columns if c not in KEYS])
    minutes, games = F.col(f"nba_minutes_{years}y"), F.col(f"nba_gp_{years}y")
    per_36 = {f"nba_{c}_per_36_{years}y": safe_divide(36 * F.col(f"nba_{c}_{years}y"), minutes) for c in stats}
    return made.withColumns({f"nba_reached_{years}y": (games > 0).cast("int"), f"nba_minutes_per_game_{years}y": safe_divide(minutes, games)} | per_36)


def weighted_outcomes(roster: DataFrame, seasons: DataFrame, stats: Sequence[str], weight: str = "minutes", years: int = 3) -> DataFrame:
    """Per (player, year): means of rates over the first seasons, weighted by ``weight``."""
    rows = band_join(roster.select(*KEYS), seasons.select("player", "season", weight, *stats), ["player"], "year", "season", 0, years - 1)
    return rows.groupBy(*KEYS).agg(*[weighted_mean(c, weight).alias(f"nba_{c}_{years}y_weighted") for c in stats])


def team_features(stats: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """(season, team): context features and their rank within the season.

    ``stats`` is long: season, team, stat_name, value; ``names`` maps stat names to totals.
    Every wanted column exists, also where no row has the stat.
    """
    rows = stats.where(F.col("stat_name").isin(*names)).select("season", "team", "stat_name", number("value").alias("value")).dropna(subset=["season", "team"])
    wide = rows.groupBy("season", "team").pivot("stat_name", list(names)).agg(F.avg("value")).withColumnsRenamed(dict(names))
    made = wide.select("season", "team", *[x.alias(f"college_team_{n}") for n, x in team_context().items()])
    for n in team_context():
        made = average_rank(made, f"college_team_{n}", ["season"], f"college_team_{n}_pct", percent=True)
    return made


def bios(core: DataFrame) -> DataFrame:
    """The last row of each (season, athlete) in the order of files and rows."""
    return latest_per(core, ["season", "athlete"], F.col("source_file").desc(), F.col("row_no").desc())


def two_stage(classified: DataFrame, regressed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, broken): both model tables side by side; rows not drafted may have no outcome."""
    out = validated_join(classified, regressed, list(KEYS), "one_to_one")
    broken = out.where((F.col("drafted") == 0) & F.col("nba_minutes_3y").isNotNull())
    return out.withColumn("nba_minutes_3y", F.coalesce("nba_minutes_3y", F.lit(0.0))), broken


def typed_empty(spark, columns: Mapping[str, str]) -> DataFrame:
    """An empty table of the given columns, for sources that are absent."""
    return spark.createDataFrame([], T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in columns.items())))


def crosswalk_or_empty(df: DataFrame, player: str = "nba_player_id", athlete: str = "espn_athlete_id") -> DataFrame:
    """(player, athlete) of a crosswalk; one with other columns counts as empty."""
    if not {player, athlete} <= set(df.columns):
        return typed_empty(df.sparkSession, {"player": "string", "athlete": "string"})
    rows = df.select(clean_id(player).alias("player"), clean_id(athlete).alias("athlete")).dropna()
    counts = rows.groupBy("player", "athlete").agg(F.count("*").alias("n"))
    return latest_per(counts, ["player"], F.col("n").desc(), F.col("athlete").asc()).select("player", "athlete")


