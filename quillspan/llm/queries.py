"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.scalars import clean_id, finite
from quillspan.llm import leaks, matching, mojibake, packing, splits, survivors, variants
from quillspan.operators.profile import usable_height, usable_position, mask_of
from quillspan.sources.tables import table


def _groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "draft_classification", "event_id", "nba_player_id", "college_espn_id")
    rows = rows.select("event_id", clean_id("nba_player_id").alias("player"), clean_id("college_espn_id").alias("athlete"))
    return splits.group_members(rows, "event_id", ["player", "athlete"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).where("`group` <> event_id").select(F.col("group").alias("group_event_id"), "event_id")


def _plan(spark: SparkSession, d: str) -> list[tuple[str, float]]:
    # split_plan has one row per split
    return [(r["split_name"], r["share"]) for r in table(spark, d, "split_plan", "split_name", "share").orderBy("split_name").limit(1001).collect()]


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    label = table(spark, d, "draft_classification", "event_id", F.col("drafted").alias("label"))
    return splits.split_groups(_groups(spark, d), "event_id", label, _plan(spark, d)).select("event_id", F.col("group").alias("group_event_id"), "split_name")


def _matching_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    draft = table(spark, d, "draft_classification", "nba_player_id", "college_espn_id", "player_name", "position", "organization", "college_age_on_july_1", "draft_year", "combine_height_wo_shoes")
    draft = draft.select(
        clean_id("nba_player_id").alias("player"), clean_id("college_espn_id").alias("athlete"), F.col("player_name").alias("name"), "position", F.col("organization").alias("org"),
        finite("college_age_on_july_1").alias("age"), F.col("draft_year").alias("year"), finite("combine_height_wo_shoes").alias("height"),
    )
    core = table(spark, d, "player_core", "athlete_id", "full_name", "date_of_birth", "position_abbreviation", "height", "season")
    core = core.select(clean_id("athlete_id").alias("athlete"), F.col("full_name").alias("name"), F.col("date_of_birth").alias("born"), F.col("position_abbreviation").alias("position"), finite("height").alias("height"), "season")
    box = table(spark, d, "player_season_from_box", "athlete_id", "athlete_display_name", "team_display_name", "season")
    box = box.select(clean_id("athlete_id").alias("athlete"), F.col("athlete_display_name").alias("name"), F.col("team_display_name").alias("team"), "season")
    return draft, core, box


def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    found = matching.match_players(*_matching_inputs(spark, d))
    return found.select(F.col("player").alias("nba_player_id"), F.col("athlete").alias("athlete_id"), "confidence", F.col("method").alias("college_match_method"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_matches(spark, d).select("nba_player_id", "athlete_id")


P5_KEYS = ("nba_player_id", "draft_year")


def _measures(spark: SparkSession, d: str) -> DataFrame:
    fields = ("position", "height_wo_shoes", "height_w_shoes", "weight", "wingspan")
    rows = table(spark, d, "combine_anthro", "anthro_row_id", "loaded_at", "trust_rank", *P5_KEYS, *fields)
    rows = rows.withColumn("nba_player_id", clean_id("nba_player_id")).where("nba_player_id is not null")
    several = rows.groupBy(*P5_KEYS).count().where("count > 1")
    rows = rows.alias("r").join(several.alias("s"), F.expr("r.nba_player_id = s.nba_player_id and r.draft_year <=> s.draft_year"), "left_semi")
    usable = {
        "position": usable_position(F.col("position")),
        "height_wo_shoes": usable_height(F.col("height_wo_shoes"), mask_of(F.col("height_wo_shoes"))).cast("string"),
        "height_w_shoes": usable_height(F.col("height_w_shoes"), mask_of(F.col("height_w_shoes"))).cast("string"),
        "weight": F.when(~F.isnan("weight"), F.col("weight")).cast("string"),
        "wingspan": F.when(~F.isnan("wingspan"), F.col("wingspan")).cast("string"),
    }
    cell = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in usable.items()])).alias("c")
    rows = rows.select(*P5_KEYS, cell, F.col("trust_rank").alias("trust"), F.col("loaded_at").alias("at"), F.col("anthro_row_id").alias("row_id"))
    return rows.select(*P5_KEYS, "c.*", "trust", "at", "row_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(_measures(spark, d), P5_KEYS).select(*P5_KEYS, "field", F.col("row_id").alias("anthro_row_id"))


def p5_consensus(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(_measures(spark, d), P5_KEYS, policy="support").select(*P5_KEYS, "field", "value", "support")


def _typed_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "player_names", "name_id", "player_name", "normalized_name", "organization", "draft_year", "position")
    name = F.coalesce(F.nullif(F.trim("player_name"), F.lit("")), F.col("normalized_name"))
    return rows.select("name_id", name.alias("name"), "organization", F.col("draft_year").alias("year"), "position")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.variant_pairs(_typed_names(spark, d))


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    return variants.named_alike(_typed_names(spark, d))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text"))


def p8_vector_containers(spark: SparkSession, d: str) -> DataFrame:
    """Containers under three binding limits: 2,048 tokens, 8 texts, half of the largest attention cost."""
    sizes = packing.token_counts(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return packing.pack(sizes, max_items=8, max_cost=2048**2 / 2, rule="dot")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.damaged_documents(table(spark, d, "documents", "doc_id", "text"))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored_documents(table(spark, d, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (p3_found, p3_splits, p4_found, p4_matches, p5_found, p5_consensus, p6_found, p6_clusters, p8_containers, p8_vector_containers, p9_found, p10_found, p10_restored)}
