"""Joins with stated cardinality, time bands and evidence.

Keys follow SQL: null never equals null.  Where a rule needs an order, it is a parameter, so
results do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.scalars import contains_either_way


def band_join(anchors: DataFrame, rows: DataFrame, keys: Sequence[str], anchor: str, value: str, low: int, high: int, how: str = "inner") -> DataFrame:
    """Rows of the anchor's entity with ``value`` in [anchor + low, anchor + high].

    One equi-join; the band is its residual condition, so the shuffle is on the keys alone.
    """
    a, r = anchors.alias("a"), rows.alias("r")
    on = [F.col(f"a.{k}") == F.col(f"r.{k}") for k in keys]
    on.append(F.col(f"r.{value}").between(F.col(f"a.{anchor}") + low, F.col(f"a.{anchor}") + high))
    return a.join(r, reduce(lambda x, y: x & y, on), how).select("a.*", *[F.col(f"r.{c}") for c in rows.columns if c not in keys and c not in anchors.columns])


def latest_per(rows: DataFrame, keys: Sequence[str], *order: Column, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key by ``order``."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")


def existence_flag(rows: DataFrame, others: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``rows`` with a 0/1 column: does the key occur in ``others``?"""
    found = others.select(*keys).dropna(subset=list(keys)).distinct().withColumn("_found", F.lit(1))
    return rows.join(found, list(keys), "left").withColumn(name, F.coalesce("_found", F.lit(0)).cast("int")).drop("_found")


def purge_groups(training: DataFrame, later: DataFrame, group: str) -> DataFrame:
    """Training rows whose group does not occur later; rows without group stay."""
    return training.join(later.select(group).dropna().distinct(), group, "left_anti")


def assert_unique(rows: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """``rows`` unchanged; a repeated key fails the job when rows are read.

    The check is a grouped count joined back, so the plan stays lazy and one pass does both.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).alias("c")
    same = reduce(lambda x, y: x & y, [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys])
    checked = F.when(F.col("c._n") > 1, F.raise_error(F.lit(f"{what}: the key {', '.join(keys)} is not unique")).cast("boolean")).otherwise(F.lit(True))
    return rows.alias("r").join(counts, same).where(checked).select("r.*")


def validated_join(left: DataFrame, right: DataFrame, keys: Sequence[str], validate: str, how: str = "left", grouped: Sequence[str] = ()) -> DataFrame:
    """Equi-join that fails if ``one_to_one``, ``many_to_one`` or ``one_to_many`` is broken.

    A side named in ``grouped`` (``left``, ``right``) is the result of a grouping by the keys: it can't
    repeat one and is not counted again.
    """
    sides = {"one_to_one": (True, True), "many_to_one": (False, True), "one_to_many": (True, False), "many_to_many": (False, False)}[validate]
    if sides[0] and "left" not in grouped:
        left = assert_unique(left, keys, "left side")
    if sides[1] and "right" not in grouped:
        right = assert_unique(right, keys, "right side")
    return left.join(right, list(keys), how)


def usual_mapping(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key; ties go to the smallest value."""
    counts = rows.dropna(subset=[key, value]).groupBy(key, value).agg(F.count("*").alias("n"))
    return latest_per(counts, [key], F.col("n").desc(), F.col(value).asc())


def merge_rosters(rosters: Sequence[DataFrame], keys: Sequence[str], how: str) -> DataFrame:
    """N-way ``inner`` or ``full`` join on the keys."""
    return reduce(lambda a, b: a.join(b, list(keys), how), rosters)


def key_membership(rosters: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """0/1 matrix of keys over sources, with ``sources_present``."""
    tagged = [df.select(*keys).dropna().distinct().withColumn("source", F.lit(name)) for name, df in rosters.items()]
    every = reduce(DataFrame.unionByName, tagged)
    flags = [F.max(F.when(F.col("source") == name, 1).otherwise(0)).cast("int").alias(name) for name in rosters]
    return every.groupBy(*keys).agg(*flags, F.count("*").alias("sources_present"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that occur on one side alone, with the side's name."""
    return a.exceptAll(b).distinct().join(b.distinct(), a.columns, "left_anti").withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).distinct().join(a.distinct(), a.columns, "left_anti").withColumn("side", F.lit("right")))


def identity_tiers(events: DataFrame, candidates: DataFrame, back: int = 6) -> DataFrame:
    """Each event with its entity, found tier by tier, and the status of the search.

    ``events``: event_id, name, qualifier, year; ``candidates``: name, season, entity, team.
    Tier 1: exactly one entity of that name in the season.  Tier 2: of several, exactly one
    whose team contains the qualifier.  Tier 3, only where the season has none: exactly one in
    the ``back`` seasons before.
    """
    keyed = events.where("name is not null and name <> ''").select("event_id", "name", "qualifier", "year")
    near = candidates.dropna(subset=["name", "entity", "season"]).select("name", "season", "entity", "team").distinct()
    met = keyed.join(near, "name").where(F.col("season").between(F.col("year") - back, F.col("year")))
    fits = contains_either_way(F.col("team"), F.col("qualifier"))
    same = F.col("season") == F.col("year")
    # per event and entity first: sets of entities are never gathered, only counted
    per_entity = met.groupBy("event_id", "entity").agg(F.max(same).alias("now"), F.max(same & fits).alias("fit"))
    found = per_entity.groupBy("event_id").agg(
        F.count_if("now").alias("n_now"), F.min(F.when(F.col("now"), F.col("entity"))).alias("e_now"),
        F.count_if("fit").alias("n_fit"), F.min(F.when(F.col("fit"), F.col("entity"))).alias("e_fit"),
        F.count_if(~F.col("now")).alias("n_past"), F.min(F.when(~F.col("now"), F.col("entity"))).alias("e_past"),
    )
    all_events = events.select("event_id", "qualifier").join(found, "event_id", "left").fillna(0, ["n_now", "n_fit", "n_past"])
    asked = F.coalesce(F.col("qualifier") != "", F.lit(False))
    # Names of the outcomes
    status = (
        F.when(F.col("n_now") == 1, "same_season_unique_compact_name")
        .when((F.col("n_now") > 1) & asked & (F.col("n_fit") == 1), "same_season_unique_team_qualifier")
        .when((F.col("n_now") > 1) & asked & (F.col("n_fit") == 0), "qualifier_did_not_identify_candidate")
        .when((F.col("n_now") > 1) & asked, "ambiguous_team_qualifier")
        .when(F.col("n_now") > 1, "ambiguous_same_season_compact_name")
        .when(F.col("n_past") == 1, "prior_six_seasons_unique_compact_name")
        .when(F.col("n_past") > 1, "ambiguous_prior_six_seasons_compact_name")
        .otherwise("unmatched_no_exact_candidate")
    )
    entity = F.when(F.col("n_now") == 1, F.col("e_now")).when((F.col("n_now") > 1) & asked & (F.col("n_fit") == 1), F.col("e_fit")).when((F.col("n_now") == 0) & (F.col("n_past") == 1), F.col("e_past"))
    return all_events.select("event_id", entity.alias("entity"), status.alias("status"))


def name_fallback(events: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact-name search over all seasons: (accepted, ambiguous).

    ``events``: event_id, name, org; ``candidates``: name, entity, team.  Accepted is the only entity of a
    name, or of several the only one with a team that contains the organisation or is contained in it
    (columns event_id, entity, method).  Ambiguous lists every candidate of the other events with the
    number of candidates and of fitting ones.
    """
    keyed = events.where("name is not null and name <> ''").select("event_id", "name", "org")
    near = candidates.dropna(subset=["name", "entity"]).select("name", "entity", "team").distinct()
    # one row an event and entity: teams are only counted, never gathered
    met = keyed.join(near, "name").groupBy("event_id", "entity").agg(F.max(contains_either_way(F.col("team"), F.col("org"))).alias("fits"))
    counts = met.groupBy("event_id").agg(F.count("*").alias("n"), F.count_if("fits").alias("n_fit"), F.min("entity").alias("only"), F.min(F.when(F.col("fits"), F.col("entity"))).alias("only_fit"))
    unique, by_team = F.col("n") == 1, F.col("n_fit") == 1
    accepted = counts.where(unique | by_team).select("event_id", F.when(unique, F.col("only")).otherwise(F.col("only_fit")).alias("entity"), F.when(unique, F.lit("unique_name")).otherwise(F.lit("unique_team_of_name")).alias("method"))
    open_ = counts.where(~(unique | by_team)).select("event_id", F.col("n").alias("n_candidates"), F.col("n_fit").alias("n_fitting"))
    return accepted, met.select("event_id", "entity").join(open_, "event_id")
