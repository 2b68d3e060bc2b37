"""Queries over scalar functions: identifiers, names, labels, dates, numbers, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import scalars as S
from quillspan.plans.base import Book, sql_id
from quillspan.sources.tables import table

book = Book()


@book.query(f"select box_row_id, {sql_id('athlete_id')} as athlete, {sql_id('team_id')} as team from player_season_from_box")
def normalize_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "player_season_from_box", "box_row_id", "athlete_id", "team_id").select("box_row_id", S.clean_id("athlete_id").alias("athlete"), S.clean_id("team_id").alias("team"))


_SUFFIX = "regexp_replace(lower(strip_accents(coalesce({0}, ''))), '\\b(jr|sr|ii|iii|iv|v)\\b\\.?', ' ', 'g')"


@book.query(f"select name_id, trim(regexp_replace({_SUFFIX.format('player_name')}, '[^a-z0-9]+', ' ', 'g')) as name from player_names")
def normalize_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "player_names", "name_id", "player_name").select("name_id", S.normalize_name("player_name").alias("name"))


@book.query(f"select name_id, regexp_replace({_SUFFIX.format('player_name')}, '[^a-z0-9]+', '', 'g') as name from player_names")
def compact_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "player_names", "name_id", "player_name").select("name_id", S.compact_name("player_name").alias("name"))


@book.query("select p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') as label from part")
def snake_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part", "p_partkey", "p_type").select("p_partkey", S.snake_label("p_type").alias("label"))


_POSITION = "nullif(trim(regexp_replace(regexp_replace(replace(upper(trim(position)), '/', '-'), '\\s*-\\s*', '-', 'g'), '\\s+', ' ', 'g')), '')"


@book.query(f"select anthro_row_id, {_POSITION} as position, case {_POSITION} when 'GUARD' then 'G' when 'FORWARD' then 'F' when 'CENTER' then 'C' else {_POSITION} end as short from combine_anthro")
def position_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "combine_anthro", "anthro_row_id", "position").select("anthro_row_id", S.normalize_position("position").alias("position"), S.college_position("position").alias("short"))


@book.query("select distinct season, season || '-' || lpad(cast((season + 1) % 100 as varchar), 2, '0') as label, season as back from player_season_from_box")
def season_label(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "player_season_from_box", "season").distinct().withColumn("label", S.season_label("season"))
    return rows.withColumn("back", S.season_start("label"))


@book.query("select core_row_id, round(floor((epoch(make_timestamp(season, 7, 1, 0, 0, 0)) - epoch(date_of_birth)) / 86400) / 365.2425, 6) as age from player_core")
def age_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "player_core", "core_row_id", "season", "date_of_birth").select("core_row_id", F.round(S.age_on_july_first("season", "date_of_birth"), 6).alias("age"))


@book.query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.absent') as absent from events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "props").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.get_json_object("props", "$.absent").alias("absent"))


@book.query("select p_partkey, case when p_size > 0 and p_size <= 10 then 'small' when p_size > 10 and p_size <= 30 then 'middle' when p_size > 30 and p_size <= 50 then 'large' end as size_bin from part")
def pick_bins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", S.right_closed_bins("p_size", [0, 10, 30, 50], ["small", "middle", "large"]).alias("size_bin"))


@book.query("""select o_orderkey, round(ln(1 + o_totalprice), 6) as log_price, round(exp(ln(1 + o_totalprice)) - 1, 2) as back, round(sqrt(o_totalprice), 6) as root, round(log10(o_totalprice), 6) as magnitude,
 round(o_totalprice / nullif(o_custkey % 3, 0), 6) as divided, floor(o_totalprice + 0.5) as whole from orders""")
def math_scalars(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("o_totalprice")
    return table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_custkey").select(
        "o_orderkey", F.round(F.log1p(x), 6).alias("log_price"), F.round(F.expm1(F.log1p(x)), 2).alias("back"), F.round(F.sqrt(x), 6).alias("root"), F.round(F.log10(x), 6).alias("magnitude"),
        F.round(S.safe_divide(x, F.col("o_custkey") % 3), 6).alias("divided"), S.half_up_count(x).cast("double").alias("whole"),
    )


@book.query("select l_orderkey, l_linenumber, l_partkey, l_discount, round(ln(greatest(0.000001, least(1 - 0.000001, l_discount)) / (1 - greatest(0.000001, least(1 - 0.000001, l_discount)))), 6) as logit from lineitem")
def logit_clip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_discount").withColumn("logit", F.round(S.clipped_logit("l_discount"), 6))


@book.query("select event_id, coalesce(combine_weight, combine_wingspan, combine_height_wo_shoes) as first_value, coalesce(college_match_method, position) as filled from draft_classification")
def coalesce_row(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "draft_classification", "event_id", "combine_weight", "combine_wingspan", "combine_height_wo_shoes", "college_match_method", "position")
    return e.select("event_id", F.coalesce("combine_weight", "combine_wingspan", "combine_height_wo_shoes").alias("first_value"), F.coalesce("college_match_method", "position").alias("filled"))


@book.query("select anthro_row_id, case when weight is not null and not isnan(weight) and not isinf(weight) then weight end as weight from combine_anthro")
def inf_to_null(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "combine_anthro", "anthro_row_id", "weight").select("anthro_row_id", S.finite("weight").alias("weight"))


@book.query("select anthro_row_id, abs(weight - wingspan * 2.5) <= 0.5 + 0.01 * abs(wingspan * 2.5) as near_by from combine_anthro where weight is not null and wingspan is not null and not isnan(weight)")
def isclose_check(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "combine_anthro", "anthro_row_id", "weight", "wingspan").where(~F.isnan("weight")).dropna()
    return a.select("anthro_row_id", S.close_to("weight", F.col("wingspan") * 2.5, 0.01, 0.5).alias("near_by"))


@book.query("select cast(y as int) as year from range(1995, 2026) r(y)")
def year_sequence(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1995, 2026).select(F.col("id").cast("int").alias("year"))


@book.query("select c_custkey, split_part(c_name, '#', 1) as kind, try_cast(split_part(c_name, '#', 2) as bigint) as number from customer")
def struct_expand(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split("c_name", "#")
    return table(spark, d, "customer", "c_custkey", F.struct(parts[0].alias("kind"), F.get(parts, F.lit(1)).try_cast("bigint").alias("number")).alias("s"), ).select("c_custkey", "s.*")


@book.query("select name_id, case when typed_at is null then null else cast(date_diff('day', cast(typed_at as date), make_date(cast(draft_year as bigint), 7, 1)) as bigint) end as days_before from player_names where draft_year is not null")
def reference_days(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "player_names", "name_id", "draft_year", "typed_at").where("draft_year is not null")
    return n.select("name_id", F.datediff(F.make_date(F.col("draft_year").cast("int"), F.lit(7), F.lit(1)), F.col("typed_at").cast("date")).cast("bigint").alias("days_before"))


@book.query("select event_type, cast(date_trunc('day', ts) as date) as day, count(*) as n, round(sum(value), 4) as total from events group by all")
def daily_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_type", F.to_date("ts").alias("day"), "value")
    return e.groupBy("event_type", "day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@book.query("select doc_type, count(*) as n, cast(coalesce(sum(n_chars), 0) as bigint) as n_chars, count(*) filter (where text is null or text = '') as n_empty from documents group by doc_type")
def document_counts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents", "doc_type", "n_chars", "text")
    return x.groupBy("doc_type").agg(F.count("*").alias("n"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars"), F.count_if(F.coalesce(F.col("text") == "", F.lit(True))).alias("n_empty"))


QUERIES, SQL = book.queries, book.sql
