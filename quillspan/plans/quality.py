"""Queries of the general data problems (profile, as-of attributes, schema drift)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.scalars import clean_id
from quillspan.operators import asof, drift, profile
from quillspan.session import cut_lineage
from quillspan.sources.tables import table

HEIGHTS = ("height_wo_shoes", "height_w_shoes")
PLACES = ("position",)


#: All columns of combine_anthro: those profiled as texts and those profiled as numbers.
TEXTS = ("load_id", "loaded_at", "feed", "trust_rank", "nba_player_id", "draft_year", "player_name", "position", *HEIGHTS)
NUMBERS = ("anthro_row_id", "load_id", "trust_rank", "draft_year", "weight", "wingspan", "standing_reach", "body_fat_pct")


def _cells(spark: SparkSession, d: str, columns: tuple[str, ...] = (*HEIGHTS, *PLACES)) -> DataFrame:
    rows = table(spark, d, "combine_anthro", *dict.fromkeys(("anthro_row_id", "load_id", *columns)))
    return profile.masked_cells(rows, "anthro_row_id", "load_id", columns)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    cells = profile.judged_cells(_cells(spark, d), HEIGHTS, PLACES)
    bad = cells.where("violation").select(F.lit("cell").alias("kind"), "column_name", F.col("case_id").cast("bigint").alias("case_id"))
    loads = profile.deviating_loads(profile.load_figures(cells, PLACES)).select(F.lit("load").alias("kind"), "column_name", F.col("load_id").cast("bigint").alias("case_id"))
    return bad.unionByName(loads)


def p1_patterns(spark: SparkSession, d: str) -> DataFrame:
    return profile.patterns(_cells(spark, d), profile.fitting_mask(HEIGHTS, PLACES))


def p1_column_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.column_profile(_cells(spark, d, TEXTS))


def p1_numeric_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.numeric_profile(table(spark, d, "combine_anthro", *NUMBERS), NUMBERS)


def p1_mask_divergence(spark: SparkSession, d: str) -> DataFrame:
    return profile.mask_divergence(_cells(spark, d, TEXTS))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "draft_classification", "event_id", "college_espn_id", "draft_year", "event_at")
    events = events.select("event_id", clean_id("college_espn_id").alias("entity"), F.col("draft_year").alias("anchor"), F.col("event_at").alias("at"))
    rows = table(spark, d, "player_season_from_box", "box_row_id", "season", "athlete_id", "team_id", "known_at")
    rows = rows.select(F.col("box_row_id").alias("row_id"), "season", clean_id("athlete_id").alias("entity"), clean_id("team_id").alias("team"), "known_at")
    return asof.latest_season_as_known(events, rows).select("event_id", F.col("row_id").alias("box_row_id"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "combine_raw_records", "record_id", "feed_id", "file_name", "file_year", "row_no", "record")


def _schema_changes(records: DataFrame) -> DataFrame:
    found = drift.members(records, "record", "record_id", "feed_id", "file_name", "file_year", "row_no")
    return drift.schema_changes(found, "feed_id", "file_name", "file_year", "row_no")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _schema_changes(_records(spark, d)).where("change <> 'column'").select("file_name", "change", "raw_label").distinct()


def p7_table(spark: SparkSession, d: str) -> DataFrame:
    """The one table of all records; JSON is read once for the schemas and once for the values."""
    records = _records(spark, d)
    return drift.consistent_table(records, "record", cut_lineage(_schema_changes(records)), "feed_id", "file_name", "record_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_patterns, p1_column_profile, p1_numeric_profile, p1_mask_divergence, p2_found, p7_found, p7_table)}

_POSITIONS = "PG|SG|SF|PF|C|G|F"
_CELLS = """
cells as (
  select anthro_row_id as case_id, load_id, 'height_wo_shoes' as column_name, height_wo_shoes as value from combine_anthro
  union all select anthro_row_id, load_id, 'height_w_shoes', height_w_shoes from combine_anthro
  union all select anthro_row_id, load_id, 'position', position from combine_anthro)"""

_TEXTS = "cells as (" + " union all ".join(f"select load_id, '{c}' as column_name, cast({c} as varchar) as value from combine_anthro" for c in TEXTS) + ")"


def _mask_sql() -> str:
    """The character-class mask of ``value``; runs by class and by each other character."""
    mask = "value"
    for pattern, mark in (("\\p{Lu}", "A"), ("[\\p{Ll}\\p{Lt}\\p{Lm}\\p{Lo}]", "a"), ("[0-9]", "9"), ("[０-９]", "N"), ("[\\t\\n\\x0b\\f\\r]", "S")):
        mask = f"regexp_replace({mask}, '{pattern}', '{mark}', 'g')"
    for c in ("A", "a", "9", "N", "S", " ", "[.]", "-", "/", ",", "\"", "''", "[?]", ":", "_"):
        mask = f"regexp_replace({mask}, '{c}{{2,}}', '{c.strip('[]')}⁺', 'g')"
    return mask


_MASK = _mask_sql()

SQL = {
    "p1_found": f"""
with {_CELLS},
judged as (
  select *, coalesce(trim(value, ' ') = '', true) as missing,
    case when column_name <> 'position' and regexp_full_match(value, ' *[0-9]+([.][0-9]+)? *') and cast(trim(value, ' ') as double) between 60 and 96 then cast(trim(value, ' ') as double) end as x,
    case when column_name = 'position' then regexp_replace(replace(upper(trim(value, ' ')), '/', '-'), ' *- *', '-', 'g') end as p
  from cells),
seen as (
  select *, case when regexp_full_match(p, '{_POSITIONS}') or (regexp_full_match(p, '({_POSITIONS})-({_POSITIONS})') and split_part(p, '-', 1) <> split_part(p, '-', 2)) then p end as label from judged),
marked as (select *, not missing and x is null and label is null as bad from seen),
base as (
  select load_id, column_name, count(*) as n, count(*) filter (where missing) as m, count(*) filter (where bad) as b, avg(x) as mean, count(label) as labels
  from marked group by all),
figures as (
  select load_id, column_name, 'missing' as figure, m / n as v, 0.2 as lim from base
  union all select load_id, column_name, 'unusable', b / nullif(n - m, 0), 0.2 from base
  union all select load_id, column_name, 'mean', mean, 1.5 from base
  union all select s.load_id, s.column_name, s.label, coalesce(c.k, 0) / s.labels, 0.2
  from (select b.load_id, b.column_name, b.labels, l.label from base b, (select distinct label from marked where label is not null) l where b.labels > 0) s
  left join (select load_id, label, count(*) as k from marked where label is not null group by all) c on c.load_id is not distinct from s.load_id and c.label = s.label),
medians as (select column_name, figure, median(v) as mid from figures where v is not null group by all)
select 'cell' as kind, column_name, case_id from marked where bad
union all
select distinct 'load', f.column_name, cast(f.load_id as bigint) from figures f join medians m using (column_name, figure) where f.v is not null and abs(f.v - m.mid) > f.lim""",
    "p1_column_profile": f"""
with {_TEXTS},
v as (select column_name, value, {_MASK} as mask, count(*) as n from cells where value is not null and trim(value, ' ') <> '' group by all)
select c.column_name, c.n_rows, c.n_rows - coalesce(sum(v.n), 0)::bigint as n_missing, count(v.value) as n_distinct, count(distinct v.mask) as n_masks,
  min(v.value) as low, max(v.value) as high, max(v.n) as n_top
from (select column_name, count(*) as n_rows from cells group by all) c left join v using (column_name) group by c.column_name, c.n_rows""",
    "p1_patterns": f"""
with {_CELLS},
m as (select column_name, {_MASK} as mask, count(*) as n_cells from cells where value is not null and trim(value, ' ') <> '' group by all),
s as (select *, n_cells / sum(n_cells) over (partition by column_name) as share from m)
select column_name, mask, n_cells, round(share, 9) as share, (share < 0.005)::int as rare,
  case when column_name = 'position' then regexp_full_match(mask, '[Aa /⁺-]+') else regexp_full_match(mask, '( ⁺?)?9⁺?([.]9⁺?)?( ⁺?)?') end::int as fits from s""",
    "p1_mask_divergence": f"""
with {_TEXTS},
m as (select column_name, load_id, {_MASK} as mask, count(*)::double as n from cells where value is not null and trim(value, ' ') <> '' group by all),
t as (select *, sum(n) over (partition by column_name, load_id) as n_load, sum(n) over (partition by column_name, mask) as n_mask, sum(n) over (partition by column_name) as n_all from m),
p as (select *, n / n_load as p, (n_mask - n) / (n_all - n_load) as q from t where n_all > n_load)
select column_name, load_id, max(n_load)::bigint as cells,
  round(sum(0.5 * p * log2(p / ((p + q) / 2)) + case when q > 0 then 0.5 * q * log2(q / ((p + q) / 2)) else 0 end) + 0.5 * (1 - sum(q)), 6) as divergence
from p group by column_name, load_id""",
    "p1_numeric_profile": "\nunion all\n".join(
        f"select '{c}' as column_name, count(*) as n_rows, count(x) as n_values, min(x) as low, max(x) as high, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as deviation from (select case when not isnan(cast({c} as double)) then cast({c} as double) end as x from combine_anthro)"
        for c in NUMBERS
    ),
    "p2_found": """
with e as (
  select event_id, draft_year, event_at, regexp_replace(trim(college_espn_id), '[.]0$', '') as a from draft_classification),
b as (
  select box_row_id, season, known_at, regexp_replace(trim(athlete_id), '[.]0$', '') as a, coalesce(nullif(regexp_replace(trim(team_id), '[.]0$', ''), ''), '') as t from player_season_from_box),
j as (
  select event_id, box_row_id, season, known_at, case when lower(t) in ('', 'nan', 'none', '<na>') then '' else t end as t from e join b using (a)
  where a not in ('', 'nan', 'None', '<NA>') and known_at <= event_at and season between draft_year - 6 and draft_year),
l as (select * from j qualify season = max(season) over (partition by event_id))
select event_id, box_row_id from l qualify row_number() over (partition by event_id, t order by known_at desc, box_row_id) = 1""",
}
