"""Queries over duplicates, missing values, shares, ranks, domains and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.scalars import clean_id, finite, number, sum_columns, within
from quillspan.operators import audit
from quillspan.operators.aggregates import crosstab_share, dense_years, missingness, standardized_difference
from quillspan.operators.joins import latest_per
from quillspan.operators.windows import average_rank, choose_top, group_medians, repeated
from quillspan.plans.base import ANCHORS_SQL, SEASONS_SQL, Book, entity_seasons, sql_id
from quillspan.sources.tables import table

book = Book()
_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@book.query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def dup_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber")
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@book.query("select l_orderkey, l_linenumber, l_partkey, l_suppkey from (select *, count(*) over (partition by l_orderkey, l_linenumber) as n from lineitem) where n > 1")
def dup_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").withColumn("again", repeated(["l_orderkey", "l_linenumber"])).where("again").drop("again")


@book.query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey, l_extendedprice) = 1")
def dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem", *_LINE, "l_shipdate")
    return latest_per(rows, ["l_orderkey", "l_linenumber"], *[F.col(c).asc() for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")]).select(*_LINE)


@book.query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) = 1")
def dedupe_keep_last(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem", *_LINE, "l_shipdate")
    return latest_per(rows, ["l_orderkey", "l_linenumber"], *[F.col(c).desc() for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")]).select(*_LINE)


@book.query(f"""with k as (select {sql_id('nba_player_id')} as a, draft_year as b, count(*) as n from draft_classification group by all)
select cast(sum(n) as bigint) as n_rows, cast(coalesce(sum(n) filter (where a is null or b is null), 0) as bigint) as null_key_rows, count(*) filter (where a is not null and b is not null) as distinct_keys,
 count(*) filter (where a is not null and b is not null and n > 1) as repeated_keys, cast(coalesce(sum(n - 1) filter (where a is not null and b is not null and n > 1), 0) as bigint) as surplus_rows from k""")
def key_quality(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "draft_classification", clean_id("nba_player_id").alias("player"), "draft_year")
    return audit.key_quality(e, ["player", "draft_year"])


@book.query("select o_custkey, count(distinct year(o_orderdate)) as n_years, string_agg(distinct cast(year(o_orderdate) as varchar), ' | ' order by cast(year(o_orderdate) as varchar)) as years from orders group by 1 having count(distinct year(o_orderdate)) > 1")
def having_repeat_years(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_custkey", F.year("o_orderdate").cast("string").alias("y"))
    return o.groupBy("o_custkey").agg(F.countDistinct("y").alias("n_years"), F.array_join(F.array_sort(F.collect_set("y")), " | ").alias("years")).where("n_years > 1")


@book.query("""with g as (select draft_year, count(*) as n, sum(cast(drafted as int)) as pos from draft_classification group by 1)
select cast(y as int) as draft_year, coalesce(n, 0) as n, cast(coalesce(pos, 0) as bigint) as positives, round(pos / nullif(n, 0), 6) as rate from range(1995, 2026) r(y) left join g on draft_year = y""")
def class_balance_dense(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "draft_classification", "draft_year", "drafted").groupBy("draft_year").agg(F.count("*").alias("n"), F.sum(F.col("drafted").cast("int")).alias("positives"))
    out = dense_years(g, "draft_year", 1995, 2025, ["n", "positives"])
    return out.withColumn("rate", F.round(F.col("positives") / F.nullif(F.col("n"), F.lit(0)), 6))


_FEATURES = ("college_age_on_july_1", "combine_height_wo_shoes", "combine_weight", "combine_wingspan", "position")


@book.query("\nunion all ".join(f"select draft_year, count(*) as n_rows, '{c}' as feature, count(*) filter (where {c} is null) as n_missing, round(count(*) filter (where {c} is null) / count(*), 6) as share_missing from draft_classification group by draft_year" for c in _FEATURES))
def missingness_long(spark: SparkSession, d: str) -> DataFrame:
    return missingness(table(spark, d, "draft_classification", "draft_year", *_FEATURES), "draft_year", _FEATURES)


@book.query("select *, round(n / sum(n) over (partition by o_orderpriority), 6) as share from (select o_orderpriority, o_orderstatus, count(*) as n from orders group by all)")
def crosstab_status(spark: SparkSession, d: str) -> DataFrame:
    return crosstab_share(table(spark, d, "orders", "o_orderpriority", "o_orderstatus"), "o_orderpriority", "o_orderstatus")


@book.query("select coalesce(position, 'Missing') as position, count(*) as n from draft_classification group by 1 order by n desc, 1 limit 10")
def value_counts_top(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "draft_classification", F.coalesce("position", F.lit("Missing")).alias("position"))
    return e.groupBy("position").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "position").limit(10)


@book.query("select c_mktsegment, count(*) as n, round(median(c_acctbal), 6) as middle, round(stddev_samp(c_acctbal), 4) as dev, round(stddev_pop(c_acctbal), 4) as dev_pop, round(100 * avg(case when c_acctbal < 0 then 1.0 else 0.0 end), 6) as pct_negative from customer group by 1")
def median_std_stats(spark: SparkSession, d: str) -> DataFrame:
    x, rows = F.col("c_acctbal"), table(spark, d, "customer", "c_mktsegment", "c_acctbal")
    spread = rows.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.round(F.stddev_samp(x), 4).alias("dev"), F.round(F.stddev_pop(x), 4).alias("dev_pop"), F.round(100 * F.avg((x < 0).cast("double")), 6).alias("pct_negative")
    )
    middle = group_medians(rows, ["c_mktsegment"], "c_acctbal", "middle").withColumn("middle", F.round("middle", 6))
    return spread.join(middle, "c_mktsegment").select("c_mktsegment", "n", "middle", "dev", "dev_pop", "pct_negative")


@book.query("select l_returnflag, round(corr(l_quantity, l_extendedprice), 6) as r, count(*) as n from lineitem group by 1")
def pearson(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_extendedprice").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.count("*").alias("n"))


@book.query(f"""with {SEASONS_SQL}, b as (select season, minutes as x, fg_pct as y from s where minutes is not null and fg_pct is not null),
r as (select season, rank() over (partition by season order by x) + (count(*) over (partition by season, x) - 1) / 2 as rx, rank() over (partition by season order by y) + (count(*) over (partition by season, y) - 1) / 2 as ry from b)
select season, count(*) as n, round(corr(rx, ry), 6) as rho from r group by season""")
def spearman_pairwise(spark: SparkSession, d: str) -> DataFrame:
    box = table(spark, d, "player_season_from_box", "box_row_id", "season", "athlete_id", "team_id", "minutes", "fg_pct", "known_at")
    box = box.withColumn("athlete", clean_id("athlete_id")).withColumn("team", F.coalesce(clean_id("team_id"), F.lit(""))).where("athlete is not null")
    rows = latest_per(box, ["season", "athlete", "team"], F.col("known_at").desc_nulls_last(), F.col("box_row_id").asc()).select("season", F.col("minutes").alias("x"), F.col("fg_pct").alias("y")).dropna()
    ranked = average_rank(average_rank(rows, "x", ["season"], "rx"), "y", ["season"], "ry")
    return ranked.groupBy("season").agg(F.count("*").alias("n"), F.round(F.corr("rx", "ry"), 6).alias("rho"))


_TARGET, _RANKED = "age", ("height", "weight", "season")


@book.query("\nunion all ".join(f"""select '{a}' as feature, '{b}' as other, n, round(n / n_all, 6) as coverage, round(rho, 6) as rho from (
 select count(*) as n, corr(ra, rb) as rho from (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2 as rb
  from (select {a}::double as a, {b}::double as b from player_core where {a} is not null and not isnan({a}::double) and {b} is not null and not isnan({b}::double)))), (select count(*) as n_all from player_core)""" for i, a in enumerate((*_RANKED, _TARGET)) for b in (*_RANKED, _TARGET)[i + 1:]))  # fmt: skip
def spearman_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of each pair of columns over the rows that have both, with their share of all rows."""
    from quillspan.operators.aggregates import union_all

    names = (*_RANKED, _TARGET)
    rows = table(spark, d, "player_core", *[finite(F.col(c).cast("double")).alias(c) for c in names])
    whole = rows.agg(F.count("*").alias("n_all"))
    parts = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = average_rank(average_rank(rows.select(a, b).dropna(), a, [], "ra"), b, [], "rb")
            found = both.agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho"))
            parts.append(found.crossJoin(whole).select(F.lit(a).alias("feature"), F.lit(b).alias("other"), "n", F.round(F.col("n") / F.col("n_all"), 6).alias("coverage"), F.round("rho", 6).alias("rho")))  # one row each
    return union_all(parts)


@book.query("select c_custkey, rank() over (order by c_acctbal) + (count(*) over (partition by c_acctbal) - 1) / 2 as place, round((rank() over (order by c_acctbal) + (count(*) over (partition by c_acctbal) - 1) / 2) / count(*) over (), 6) as pct from customer")
def global_average_rank(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", "c_custkey", "c_acctbal")
    ranked = average_rank(average_rank(c, "c_acctbal", [], "place"), "c_acctbal", [], "pct", percent=True)
    return ranked.select("c_custkey", "place", F.round("pct", 6).alias("pct"))


@book.query("\nunion all ".join(f"select '{c}' as feature, round(avg({c}) filter (where drafted = 1), 6) as mean_left, round(avg({c}) filter (where drafted <> 1), 6) as mean_right, round((avg({c}) filter (where drafted = 1) - avg({c}) filter (where drafted <> 1)) / sqrt(nullif((var_samp({c}) filter (where drafted = 1) + var_samp({c}) filter (where drafted <> 1)) / 2, 0)), 6) as smd from draft_classification" for c in _FEATURES[:4]))
def smd_two_groups(spark: SparkSession, d: str) -> DataFrame:
    return standardized_difference(table(spark, d, "draft_classification", "drafted", *_FEATURES[:4]), F.col("drafted") == 1, _FEATURES[:4])


@book.query("select draft_year, cast(drafted as int) as drafted, count(*) as n, count(combine_weight) as with_weight, round(count(combine_weight) / count(*), 6) as share from draft_classification group by all")
def coverage_by_year_target(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "draft_classification", "draft_year", F.col("drafted").cast("int").alias("drafted"), "combine_weight")
    return e.groupBy("draft_year", "drafted").agg(F.count("*").alias("n"), F.count("combine_weight").alias("with_weight"), F.round(F.count("combine_weight") / F.count("*"), 6).alias("share"))


@book.query("select o_orderkey, cast(year(o_orderdate) as int) as year, case when row_number() over (partition by year(o_orderdate) order by o_totalprice desc, o_orderkey) <= floor(0.1 * count(*) over (partition by year(o_orderdate)) + 0.5) then 1 else 0 end as chosen from orders")
def top_fraction_per_year(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    return choose_top(o, ["year"], 0.1, "o_totalprice", ["o_orderkey"], "chosen").drop("o_totalprice")


@book.query("select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 5")
def head_per_group(spark: SparkSession, d: str) -> DataFrame:
    return latest_per(table(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.col("o_totalprice").desc(), F.col("o_orderkey").asc(), n=5)


@book.query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def topk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@book.query("select o_orderpriority, max(o_totalprice) as price, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) as o_orderkey from orders group by 1")
def argmax_row(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderpriority", "o_orderkey", "o_totalprice")
    return o.groupBy("o_orderpriority").agg(F.max("o_totalprice").alias("price"), F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))


@book.query("select o_orderkey, o_custkey, max(o_totalprice) over (partition by o_custkey) as most, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as nth from orders")
def group_broadcast(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    return table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").select("o_orderkey", "o_custkey", F.max("o_totalprice").over(w).alias("most"), (F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")) - 1).cast("bigint").alias("nth"))


@book.query("""select 'negative minutes' as "check", count(*) as n_rows, count(*) filter (where minutes < 0) as n_bad from player_season_from_box
union all select 'made above attempted', count(*), count(*) filter (where field_goals_made > field_goals_attempted) from player_season_from_box
union all select 'rebounds do not add up', count(*), count(*) filter (where abs(rebounds - offensive_rebounds - defensive_rebounds) > 0.5) from player_season_from_box
union all select 'share outside 0 to 1', count(*), count(*) filter (where not (fg_pct between 0 and 1)) from player_season_from_box
union all select 'rate differs from totals', count(*), count(*) filter (where abs(fg_pct - field_goals_made / nullif(field_goals_attempted, 0)) > 0.0015) from player_season_from_box""")
def domain_checks(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "player_season_from_box", "minutes", "field_goals_made", "field_goals_attempted", "rebounds", "offensive_rebounds", "defensive_rebounds", "fg_pct")
    return audit.violations(b, {
        "negative minutes": F.col("minutes") < 0, "made above attempted": F.col("field_goals_made") > F.col("field_goals_attempted"),
        "rebounds do not add up": F.abs(F.col("rebounds") - F.col("offensive_rebounds") - F.col("defensive_rebounds")) > 0.5, "share outside 0 to 1": ~F.col("fg_pct").between(0, 1),
        "rate differs from totals": F.abs(F.col("fg_pct") - F.col("field_goals_made") / F.nullif(F.col("field_goals_attempted"), F.lit(0.0))) > 0.0015,
    })


_CORE = ("core_row_id", "season", "athlete_id", "full_name", "date_of_birth", "position_abbreviation", "height", "weight", "age", "position_name")


@book.query("with c as (select count(*) as n_rows, " + ", ".join(f"count({c}) as {c}" for c in _CORE) + f" from player_core), f as (select n_rows, {' + '.join(_CORE)} as filled, {' + '.join(f'case when {c} = 0 then 1 else 0 end' for c in _CORE)} as empty from c) select n_rows, cast({len(_CORE)} as bigint) as n_columns, cast(n_rows * {len(_CORE)} - filled as bigint) as null_cells, round(100 * (n_rows * {len(_CORE)} - filled) / (n_rows * {len(_CORE)}), 6) as null_cell_pct, cast(empty as bigint) as all_null_columns from f")
def profile_nulls(spark: SparkSession, d: str) -> DataFrame:
    return audit.table_profile(table(spark, d, "player_core", *_CORE))


@book.query(" union all ".join(f"select '{c}' as column_name, case when count(distinct {c}) <= 1 then 1 else 0 end as is_constant, count(*) filter (where isinf({c}::double)) as n_infinite from player_core" for c in ("season", "height", "weight", "age")))
def constant_columns(spark: SparkSession, d: str) -> DataFrame:
    return audit.constant_columns(table(spark, d, "player_core", "season", "height", "weight", "age"), ["season", "height", "weight", "age"])


def _group_sql(rules: tuple[audit.NameRule, ...]) -> str:
    tests = []
    for r in rules:
        parts = [f"lower(column_name) in ({', '.join(repr(n) for n in r.names)})"] if r.names else []
        parts += [f"starts_with(lower(column_name), '{x}')" for x in r.starts] + [f"suffix(lower(column_name), '{x}')" for x in r.ends] + [f"contains(lower(column_name), '{x}')" for x in r.parts]
        tests.append(f"when {' or '.join(parts)} then '{r.meaning}'")
    return "case " + " ".join(tests) + " else {} end"


@book.query("select column_name as name, " + _group_sql(audit.FEATURE_GROUPS).format("'feature'") + " as role from (describe draft_classification)")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    return audit.feature_manifest(table(spark, d, "draft_classification")).select("name", "role")


@book.query("select column_name as name, " + _group_sql(audit.LEAKAGE).format("null") + " as gives_away from (describe player_season_from_box) union all select column_name, " + _group_sql(audit.LEAKAGE).format("null") + " from (describe draft_classification)")
def leakage_report(spark: SparkSession, d: str) -> DataFrame:
    """What the columns of both tables would give away as features."""
    from quillspan.operators.aggregates import union_all

    parts = [audit.feature_manifest(table(spark, d, t)).select("name", audit.first_meaning(F.col("name"), audit.LEAKAGE).alias("gives_away")) for t in ("player_season_from_box", "draft_classification")]
    return union_all(parts)


@book.query("select cast(load_id as bigint) as load_id, count(*) as n_rows, count(distinct nba_player_id) as n_keys, count(nba_player_id) - count(distinct nba_player_id) as n_repeated, count(*) filter (where weight is not null or wingspan is not null or standing_reach is not null) as n_measured from combine_anthro group by 1")
def file_coverage(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "combine_anthro", F.col("load_id").cast("bigint").alias("load_id"), "nba_player_id", "weight", "wingspan", "standing_reach")
    return audit.file_coverage(a, "load_id", "nba_player_id", ["weight", "wingspan", "standing_reach"])


@book.query("select load_id, feed, count(*) as n, round(count(*) / max(n_load), 6) as share from (select *, count(*) over (partition by load_id) as n_load from combine_anthro) group by load_id, feed")
def partition_coverage(spark: SparkSession, d: str) -> DataFrame:
    return crosstab_share(table(spark, d, "combine_anthro", "load_id", "feed"), "load_id", "feed")


@book.query(f"""with {ANCHORS_SQL}, b as (select distinct {sql_id('athlete_id')} as athlete from player_core)
select case when b.athlete is null then 0 else 1 end as in_core, count(*) as n from a left join b using (athlete) group by 1""")
def dictionary_coverage(spark: SparkSession, d: str) -> DataFrame:
    from quillspan.operators.joins import existence_flag
    from quillspan.plans.base import anchors

    core = table(spark, d, "player_core", clean_id("athlete_id").alias("athlete"))
    return existence_flag(anchors(spark, d), core, ["athlete"], "in_core").groupBy("in_core").agg(F.count("*").alias("n"))


@book.query(f"with {SEASONS_SQL} select season, cast(sum(games_on_roster) as bigint) as n_roster, count(*) as n_rows, count(distinct athlete) as n_athletes, count(*) - count(distinct athlete) as n_extra_teams from s group by season")
def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    s = entity_seasons(spark, d).groupBy("season")
    return s.agg(F.sum("games_on_roster").alias("n_roster"), F.count("*").alias("n_rows"), F.countDistinct("athlete").alias("n_athletes"), (F.count("*") - F.countDistinct("athlete")).alias("n_extra_teams"))


@book.query("""select event_id, draft_year from draft_classification where combine_weight between 180 and 220 and draft_year in (2005, 2010, 2015) and coalesce(starts_with(position, 'P'), false) and not coalesce(combine_wingspan > 85, false)""")
def predicate_mix(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "draft_classification", "event_id", "draft_year", "combine_weight", "position", "combine_wingspan")
    return e.where(F.col("combine_weight").between(180, 220) & F.col("draft_year").isin(2005, 2010, 2015) & F.coalesce(F.col("position").startswith("P"), F.lit(False)) & ~F.coalesce(F.col("combine_wingspan") > 85, F.lit(False))).select("event_id", "draft_year")


@book.query("select event_id, case when combine_weight is null or combine_wingspan is null then 'rejected' else 'kept' end as route from draft_classification")
def null_key_split(spark: SparkSession, d: str) -> DataFrame:
    from quillspan.functions.scalars import any_null

    e = table(spark, d, "draft_classification", "event_id", "combine_weight", "combine_wingspan")
    return e.select("event_id", F.when(any_null(["combine_weight", "combine_wingspan"]), "rejected").otherwise("kept").alias("route"))


@book.query("select event_id, combine_height_wo_shoes as combine_height, round(combine_wingspan - combine_height_wo_shoes, 6) as combine_derived_reach, round(703 * combine_weight / nullif(combine_height_wo_shoes * combine_height_wo_shoes, 0), 6) as combine_derived_bmi, case when combine_weight is null then 0 else 1 end as has_weight, case when combine_weight is null and combine_wingspan is null then null else coalesce(combine_weight, 0) + coalesce(combine_wingspan, 0) end as weight_and_span from draft_classification")
def derived_measures(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "draft_classification", "event_id", "combine_height_wo_shoes", "combine_wingspan", "combine_weight").withColumnRenamed("combine_height_wo_shoes", "combine_height")
    h, w = F.col("combine_height"), F.col("combine_weight")
    return e.select(
        "event_id", "combine_height", F.round(F.col("combine_wingspan") - h, 6).alias("combine_derived_reach"), F.round(703 * w / F.nullif(h * h, F.lit(0.0)), 6).alias("combine_derived_bmi"),
        w.isNotNull().cast("int").alias("has_weight"), sum_columns(["combine_weight", "combine_wingspan"]).alias("weight_and_span"),
    )


_NUMS = ("season", "height", "weight", "age")


@book.query("select " + ", ".join(f"round(avg({c}), 6) as mean_{c}" for c in _NUMS) + " from player_core")
def numeric_columns_agg(spark: SparkSession, d: str) -> DataFrame:
    core = table(spark, d, "player_core")
    return core.agg(*[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in audit.numeric_columns(core, ["core_row_id"])])


@book.query("select position, count(*) as n, round(avg(combine_weight), 6) as mean_weight, min(combine_weight) as low, max(combine_weight) as high, count(distinct draft_year) as n_years, arg_min(organization, event_id) filter (where organization is not null) as first_org from draft_classification group by position")
def null_group_kept(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("combine_weight")
    e = table(spark, d, "draft_classification", "event_id", "position", "combine_weight", "draft_year", "organization")
    return e.groupBy("position").agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean_weight"), F.min(x).alias("low"), F.max(x).alias("high"), F.countDistinct("draft_year").alias("n_years"), F.min_by("organization", F.when(F.col("organization").isNotNull(), F.col("event_id"))).alias("first_org"))


@book.query("select position, draft_year, count(*) as n from draft_classification where position is not null and draft_year is not null group by all")
def null_group_dropped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "draft_classification", "position", "draft_year").dropna().groupBy("position", "draft_year").agg(F.count("*").alias("n"))


@book.query("select core_row_id, case when age between 16 and 35 then age end as age, case when height between 60 and 96 then height end as height from player_core")
def age_bounds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "player_core", "core_row_id", "age", "height").select("core_row_id", within("age", 16, 35).alias("age"), within("height", 60, 96).alias("height"))


@book.query("select anthro_row_id, case when isfinite(try_cast(height_wo_shoes as double)) then try_cast(height_wo_shoes as double) end as lenient from combine_anthro")
def lenient_cast(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "combine_anthro", "anthro_row_id", "height_wo_shoes").select("anthro_row_id", number("height_wo_shoes").alias("lenient"))


QUERIES, SQL = book.queries, book.sql
