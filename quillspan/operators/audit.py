"""Audits: keys, domains, profiles, manifests and consistency of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions.scalars import any_null, any_value


def key_quality(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, rows with a null key, distinct keys, repeated groups and surplus rows."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    whole = ~any_null(list(keys))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(~whole, F.col("n"))), F.lit(0)).alias("null_key_rows"),
        F.count_if(whole).alias("distinct_keys"),
        F.count_if(whole & (F.col("n") > 1)).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(whole & (F.col("n") > 1), F.col("n") - 1)), F.lit(0)).alias("surplus_rows"),
    )


def violations(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(check, n_rows, n_bad) of named conditions that should never hold; one pass."""
    row = df.agg(F.count("*").alias("n_rows"), *[F.count_if(c).alias(name) for name, c in checks.items()])
    return row.unpivot(["n_rows"], list(checks), "check", "n_bad")


def table_profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, null cells, share of null cells, columns without any value."""
    counts = [F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]
    n = len(counts)
    row = df.agg(F.count("*").alias("n_rows"), *counts)
    filled = sum((F.col(f"c{i}") for i in range(n)), F.lit(0))
    empty = sum((F.when(F.col(f"c{i}") == 0, 1).otherwise(0) for i in range(n)), F.lit(0))
    nulls = F.col("n_rows") * n - filled
    return row.select("n_rows", F.lit(n).cast("bigint").alias("n_columns"), nulls.cast("bigint").alias("null_cells"), F.round(100 * nulls / F.nullif(F.col("n_rows") * n, F.lit(0)), 6).alias("null_cell_pct"), empty.cast("bigint").alias("all_null_columns"))


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_distinct, n_infinite) of numeric columns; constant means at most 1."""
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        parts += [F.min(x).alias(f"{c}|a"), F.max(x).alias(f"{c}|b"), F.count_if(F.abs(x) == float("inf")).alias(f"{c}|i")]
    row = df.agg(*parts)
    each = [F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(f"`{c}|a`") == F.col(f"`{c}|b`"), F.lit(True)).cast("int").alias("is_constant"), F.col(f"`{c}|i`").alias("n_infinite")) for c in columns]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def numeric_columns(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in without]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold no value; one aggregation decides."""
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.drop(*[c for i, c in enumerate(df.columns) if row[i] == 0])


@dataclass(frozen=True)
class NameRule:
    """What column names say: whole names, beginnings, ends or parts, in lower case."""

    meaning: str
    names: tuple[str, ...] = ()
    starts: tuple[str, ...] = ()
    ends: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()

    def holds(self, name: Column) -> Column:
        text = F.lower(name)
        tests = [text.isin(*self.names)] if self.names else []
        tests += [text.startswith(x) for x in self.starts] + [text.endswith(x) for x in self.ends] + [text.contains(x) for x in self.parts]
        return reduce(lambda a, b: a | b, tests)

    def matches(self, name: str) -> bool:
        text = name.lower()
        return text in self.names or text.startswith(self.starts) or text.endswith(self.ends) or any(x in text for x in self.parts)


# Columns that may not be features, by what they give away.
LEAKAGE = (
    NameRule("the outcome of the draft, or what is known after it", ("drafted", "overall_pick", "round_number", "round_pick", "draft_pick", "drafted_team", "draft_team", "draft_organization", "team_abbreviation", "organization", "organization_type", "nba_min_3y"), starts=("nba_",)),
    NameRule("who it is", ("id", "name", "player_id", "temp_player_id", "athlete_id", "college_espn_id", "player_name", "first_name", "last_name", "normalized_name"), ends=("_id", "_name")),
    NameRule("how or whether records were joined", ("player_profile_flag", "combine_available", "has_college_data"), parts=("match_method",)),
    NameRule("the calendar", ("year", "season", "draft_year"), ends=("_year", "_season")),
)

# Groups of feature names of a model table.
FEATURE_GROUPS = (
    NameRule("target", ("drafted",)),
    NameRule("key", ("event_id", "nba_player_id", "draft_year", "player_name")),
    NameRule("availability", ("has_college_data", "combine_available", "player_profile_flag")),
    NameRule("identity", ("college_espn_id", "organization", "organization_type"), parts=("match_method",)),
    NameRule("combine_derived", starts=("combine_derived",)),
    NameRule("combine_shooting", starts=("combine_spot", "combine_shot", "combine_off_drib", "combine_on_move")),
    NameRule("combine_drills", starts=("combine_lane", "combine_sprint", "combine_bench", "combine_three_quarter"), parts=("vertical",)),
    NameRule("combine_measurements", starts=("combine",)),
    NameRule("college_team", starts=("college_team",)),
    NameRule("college_development", starts=("college_delta", "college_development")),
    NameRule("college_last_season", starts=("college_last",)),
    NameRule("college_career", starts=("college_career",)),
    NameRule("age", parts=("age_on_",)),
    NameRule("college_other", starts=("college",)),
)


def first_meaning(name: Column, rules: Sequence[NameRule]) -> Column:
    """Meaning of the first rule that holds, null where none does."""
    return F.coalesce(*[F.when(r.holds(name), F.lit(r.meaning)) for r in rules])


def feature_manifest(df: DataFrame, rules: Sequence[NameRule] = FEATURE_GROUPS) -> DataFrame:
    """(name, place, type, role) of the columns of a table; a name without a rule is a ``feature``."""
    rows = [(f.name, i, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    names = df.sparkSession.createDataFrame(rows, "name string, place int, type string")
    return names.withColumn("role", F.coalesce(first_meaning(F.col("name"), rules), F.lit("feature")))


def leaking(names: Sequence[str], rules: Sequence[NameRule] = LEAKAGE) -> dict[str, str]:
    """Those of the names that a rule holds for (by default: may not be features), with what it says."""
    found = {n: next((r.meaning for r in rules if r.matches(n)), None) for n in names}
    return {n: meaning for n, meaning in found.items() if meaning}


def first_existing(df: DataFrame, *names: str) -> str | None:
    """The first of the names that is a column, ignoring case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[n.lower()] for n in names if n.lower() in have), None)


def target_integrity(rows: DataFrame, official: DataFrame, keys: Sequence[str], target: str, by: str, outcome: str | None = None) -> DataFrame:
    """Per ``by``: rows, rows whose target differs from their key's presence among ``official`` keys,
    and rows outside them that carry an ``outcome`` all the same."""
    known = official.select(*keys).dropna().distinct().withColumn("_official", F.lit(1))
    joined = rows.join(known, list(keys), "left").withColumn("_official", F.coalesce("_official", F.lit(0)))
    stray = F.count_if((F.col("_official") == 0) & F.col(outcome).isNotNull()) if outcome else F.lit(0).cast("bigint")
    return joined.groupBy(by).agg(F.count("*").alias("n_rows"), F.count_if(~F.col(target).eqNullSafe(F.col("_official"))).alias("n_differing"), stray.alias("n_stray_outcomes"))


def verdicts(checks: DataFrame, tolerated: Sequence[str] = ()) -> DataFrame:
    """(check_name, n_rows, n_bad) with a verdict: PASS, WARN for a tolerated check, else FAIL."""
    bad = F.when(F.col("check_name").isin(*tolerated), "WARN").otherwise("FAIL") if tolerated else F.lit("FAIL")
    return checks.withColumn("verdict", F.when(F.col("n_bad") == 0, "PASS").otherwise(bad))


def file_coverage(df: DataFrame, file: str, key: str, measures: Sequence[str]) -> DataFrame:
    """Per file: rows, distinct keys, repeated rows, rows with a measurement."""
    return df.groupBy(file).agg(
        F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"), (F.count(key) - F.countDistinct(key)).alias("n_repeated"), F.count_if(any_value(list(measures))).alias("n_measured")
    )


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: are both tables equal as bags, and how many rows differ each way."""
    left, right = a.exceptAll(b).agg(F.count("*").alias("only_left")), b.exceptAll(a).agg(F.count("*").alias("only_right"))
    return left.crossJoin(right).withColumn("equal", (F.col("only_left") + F.col("only_right") == 0).cast("int"))  # one row each


def validate_model_table(df: DataFrame, key: Sequence[str], target: str, features: Sequence[str]) -> None:
    """Raise unless the key is unique and complete, the target binary and features usable."""
    found = key_quality(df, key).first()
    if found["null_key_rows"] or found["repeated_keys"]:
        raise ValueError(f"key {list(key)}: {found['null_key_rows']} rows without, {found['repeated_keys']} repeated")
    bad = df.where(~F.coalesce(F.col(target).isin(0, 1), F.lit(False))).limit(1).count()
    if bad:
        raise ValueError(f"target {target} is not binary")
    named = leaking(features)
    text = [c for c in features if not isinstance(df.schema[c].dataType, (T.NumericType, T.StringType))]
    if named or text:
        raise ValueError(f"not allowed as features: {named or text}")


def mirror_parity(table: DataFrame, mirror: DataFrame) -> DataFrame:
    """One row: rows of a table and of its JSON mirror, columns that only one of them names.

    ``mirror`` has the form that ``files.read_result_sets`` gives.
    """
    heads = mirror.select(F.explode("headers").alias("h")).select(F.lower("h").alias("h")).distinct()
    names = table.sparkSession.createDataFrame([(c.lower(),) for c in table.columns], "h string")
    only = names.join(heads, "h", "left_anti").select(F.lit("table").alias("side"), "h").unionByName(heads.join(names, "h", "left_anti").select(F.lit("mirror").alias("side"), "h"))
    # a handful of column names
    odd = only.agg(F.count_if(F.col("side") == "table").alias("only_table"), F.count_if(F.col("side") == "mirror").alias("only_mirror")).first()
    counts = table.agg(F.count("*").alias("rows_table")).first()[0], mirror.where("values is not null").count()
    verdict = "PASS" if counts[0] == counts[1] and not odd["only_table"] and not odd["only_mirror"] else "FAIL"
    return table.sparkSession.createDataFrame([(counts[0], counts[1], odd["only_table"], odd["only_mirror"], verdict)], "rows_table long, rows_mirror long, only_table long, only_mirror long, verdict string")
