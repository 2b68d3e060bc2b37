"""Queries over entity-season panels: totals, rates, history, careers, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.scalars import safe_divide
from quillspan.operators.aggregates import TOTALS, collapse_seasons, rates, team_context, total, weighted_mean
from quillspan.operators.joins import assert_unique, band_join, latest_per
from quillspan.operators.windows import average_rank, with_previous
from quillspan.plans.base import ANCHORS_SQL, ATHLETE_SQL, RATES_SQL, SEASONS_SQL, Book, anchors, athlete_seasons, entity_seasons
from quillspan.sources.tables import table

book = Book()
_BIG = {c for c in TOTALS if c.startswith("games")}


def _sum_sql(c: str) -> str:
    return f"cast({c} as bigint) as {c}" if c in _BIG else c


@book.query(f"with {ATHLETE_SQL} select athlete, season, {', '.join(_sum_sql(c) for c in TOTALS)} from t")
def entity_season_collapse(spark: SparkSession, d: str) -> DataFrame:
    return athlete_seasons(spark, d)


@book.query(f"with {ATHLETE_SQL} select athlete, season, {', '.join(f'round({x}, 6) as {n}' for n, x in RATES_SQL.items())} from t")
def season_rates(spark: SparkSession, d: str) -> DataFrame:
    return athlete_seasons(spark, d).select("athlete", "season", *[F.round(x, 6).alias(n) for n, x in rates().items()])


@book.query(f"with {ATHLETE_SQL}, {ANCHORS_SQL} select athlete, anchor, season, minutes, points from a join t using (athlete) where season between anchor - 6 and anchor")
def history_band_join(spark: SparkSession, d: str) -> DataFrame:
    return band_join(anchors(spark, d), athlete_seasons(spark, d).select("athlete", "season", "minutes", "points"), ["athlete"], "anchor", "season", -6, 0)


@book.query(f"with {ATHLETE_SQL}, {ANCHORS_SQL} select athlete, anchor, season, minutes, points, anchor - season as season_gap from a join t using (athlete) where season between anchor - 6 and anchor qualify row_number() over (partition by athlete order by season desc) = 1")
def asof_last_season(spark: SparkSession, d: str) -> DataFrame:
    return latest_per(history_band_join(spark, d), ["athlete"], F.col("season").desc()).withColumn("season_gap", F.col("anchor") - F.col("season"))


_LAST = "h as (select athlete, anchor, season, points, minutes, 40 * points / nullif(minutes, 0) as rate, row_number() over (partition by athlete order by season desc) as k from a join t using (athlete) where season between anchor - 6 and anchor)"


@book.query(f"""with {ATHLETE_SQL}, {ANCHORS_SQL}, {_LAST},
c as (select athlete, max(anchor) as anchor, sum(points) as points, sum(minutes) as minutes, count(*) as n_seasons, cast(max(season) - min(season) + 1 as bigint) as span from h group by athlete)
select c.athlete, c.anchor, l.season as last_season, c.n_seasons, c.span, round(l.rate, 6) as last_rate, round(40 * c.points / nullif(c.minutes, 0), 6) as career_rate,
  round(l.rate - p.rate, 6) as rate_delta, cast(l.season - p.season as bigint) as season_gap
from c join h l on l.athlete = c.athlete and l.k = 1 left join h p on p.athlete = c.athlete and p.k = 2""")
def career_vs_last_delta(spark: SparkSession, d: str) -> DataFrame:
    rows = history_band_join(spark, d).withColumn("rate", safe_divide(40 * F.col("points"), "minutes"))
    rows = with_previous(rows, ["athlete"], "season", ["rate"])
    career = rows.groupBy("athlete").agg(
        F.max("anchor").alias("anchor"), F.count("*").alias("n_seasons"), (F.max("season") - F.min("season") + 1).cast("bigint").alias("span"), F.sum("points").alias("points"), F.sum("minutes").alias("minutes"),
        F.max_by(F.struct("season", "rate", "rate_delta", "season_gap"), "season").alias("last"),
    )
    return career.select(
        "athlete", "anchor", F.col("last.season").alias("last_season"), "n_seasons", "span", F.round("last.rate", 6).alias("last_rate"),
        F.round(safe_divide(40 * F.col("points"), "minutes"), 6).alias("career_rate"), F.round("last.rate_delta", 6).alias("rate_delta"), F.col("last.season_gap").cast("bigint").alias("season_gap"),
    )


@book.query(f"""with {ATHLETE_SQL}, {ANCHORS_SQL},
o as (select athlete, sum(coalesce(points, 0)) as points, sum(coalesce(minutes, 0)) as minutes, count(distinct season) as n from a join t using (athlete) where season >= anchor and season < anchor + 3 group by athlete)
select athlete, anchor, coalesce(points, 0) as points_3y, coalesce(minutes, 0) as minutes_3y, coalesce(n, 0) as seasons_3y, round(36 * points / nullif(minutes, 0), 6) as points_per_36 from a left join o using (athlete)""")
def forward_outcome_3y(spark: SparkSession, d: str) -> DataFrame:
    a = anchors(spark, d)
    rows = band_join(a, athlete_seasons(spark, d).select("athlete", "season", "points", "minutes"), ["athlete"], "anchor", "season", 0, 2)
    sums = rows.groupBy("athlete").agg(total(F.coalesce("points", F.lit(0.0)), "zero").alias("points"), total(F.coalesce("minutes", F.lit(0.0)), "zero").alias("minutes"), F.countDistinct("season").alias("n"))
    out = a.join(sums, "athlete", "left")
    return out.select("athlete", "anchor", F.coalesce("points", F.lit(0.0)).alias("points_3y"), F.coalesce("minutes", F.lit(0.0)).alias("minutes_3y"), F.coalesce("n", F.lit(0)).alias("seasons_3y"), F.round(safe_divide(36 * F.col("points"), "minutes"), 6).alias("points_per_36"))


@book.query(f"""with {ATHLETE_SQL}, {ANCHORS_SQL}
select athlete, round(sum(case when ts is not null and minutes > 0 then ts * minutes end) / nullif(sum(case when ts is not null and minutes > 0 then minutes end), 0), 6) as ts_weighted
from a join (select athlete, season, minutes, {RATES_SQL['ts_pct']} as ts from t) using (athlete) where season between anchor - 6 and anchor group by athlete""")
def weighted_mean_outcome(spark: SparkSession, d: str) -> DataFrame:
    t = athlete_seasons(spark, d).select("athlete", "season", "minutes", rates()["ts_pct"].alias("ts"))
    rows = band_join(anchors(spark, d), t, ["athlete"], "anchor", "season", -6, 0)
    return rows.groupBy("athlete").agg(F.round(weighted_mean("ts", "minutes"), 6).alias("ts_weighted"))


@book.query(f"with {SEASONS_SQL} select athlete, season, team, minutes, cast(games_played as bigint) as games_played from s qualify row_number() over (partition by athlete, season order by minutes desc nulls last, games_played desc nulls last, team nulls last) = 1")
def primary_team(spark: SparkSession, d: str) -> DataFrame:
    rows = entity_seasons(spark, d)
    best = latest_per(rows, ["athlete", "season"], F.col("minutes").desc_nulls_last(), F.col("games_played").desc_nulls_last(), F.col("team").asc_nulls_last())
    return best.select("athlete", "season", "team", "minutes", F.col("games_played").cast("bigint").alias("games_played"))


_TEAM = SEASONS_SQL + ",\nm as (select season, team, " + ", ".join(f"sum({c}) as {c}" for c in TOTALS) + " from s group by season, team)"
_POSS = "(field_goals_attempted - offensive_rebounds + turnovers + 0.44 * free_throws_attempted)"


def _team_seasons(spark: SparkSession, d: str) -> DataFrame:
    return collapse_seasons(entity_seasons(spark, d), ["season", "team"])


@book.query(f"""with {_TEAM}, r as (select season, team, round(100 * points / nullif({_POSS}, 0), 6) as rating from m)
select season, team, rating, round((rank() over (partition by season order by rating) + (count(*) over (partition by season, rating) - 1) / 2) / count(rating) over (partition by season), 6) as pct_rank from r where rating is not null
union all select season, team, rating, null from r where rating is null""")
def team_pct_rank(spark: SparkSession, d: str) -> DataFrame:
    rated = _team_seasons(spark, d).select("season", "team", F.round(team_context()["rating"], 6).alias("rating"))
    return average_rank(rated, "rating", ["season"], "pct_rank", percent=True).withColumn("pct_rank", F.round("pct_rank", 6))


@book.query(f"""with {_TEAM} select season, team, round({_POSS}, 6) as possessions, round(100 * points / nullif({_POSS}, 0), 6) as rating,
 round((field_goals_made + 0.5 * three_point_field_goals_made) / nullif(field_goals_attempted, 0), 6) as efg_pct, round(turnovers / nullif({_POSS}, 0), 6) as turnover_rate, round(assists / nullif(field_goals_made, 0), 6) as assist_rate from m""")
def pip_team_context(spark: SparkSession, d: str) -> DataFrame:
    return _team_seasons(spark, d).select("season", "team", *[F.round(x, 6).alias(n) for n, x in team_context().items()])


_PLACES = ("G", "F", "C")


@book.query(f"with {SEASONS_SQL} select season, " + ", ".join(f"sum(points) filter (where athlete_position_abbreviation = '{p}') as \"{p}\"" for p in _PLACES) + " from s group by season")
def team_stat_pivot(spark: SparkSession, d: str) -> DataFrame:
    return entity_seasons(spark, d).groupBy("season").pivot("athlete_position_abbreviation", list(_PLACES)).agg(F.sum("points"))


_LONG = ("minutes", "points", "rebounds", "assists")


@book.query(f"with {ATHLETE_SQL} " + " union all ".join(f"select athlete, season, '{c}' as stat, {c} as value from t" for c in _LONG))
def long_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return athlete_seasons(spark, d).unpivot(["athlete", "season"], list(_LONG), "stat", "value")


@book.query("""select l_suppkey as entity, cast(year(o_orderdate) as int) as season, count(*) as n_rows, count(*) filter (where l_returnflag <> 'N') as appeared,
 count(*) filter (where l_returnflag = 'R' and l_linestatus = 'F') as started, cast(sum(coalesce(l_quantity, 0)) as double) as quantity, round(sum(l_extendedprice), 2) as price
from lineitem join orders on l_orderkey = o_orderkey group by all""")
def event_season_totals(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    orders = table(spark, d, "orders", "o_orderkey", F.year("o_orderdate").alias("season"))
    rows = items.join(orders, items.l_orderkey == orders.o_orderkey)
    appeared = F.col("l_returnflag") != "N"
    return rows.groupBy(F.col("l_suppkey").alias("entity"), "season").agg(
        F.count("*").alias("n_rows"), F.count_if(appeared).alias("appeared"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("started"),
        F.coalesce(F.sum("l_quantity"), F.lit(0.0)).alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"),
    )


@book.query("select l_suppkey as entity, sum(nullif(l_discount, 0)) is null as all_null, round(sum(nullif(l_discount, 0)), 6) as kept, round(coalesce(sum(nullif(l_discount, 0)), 0), 6) as zeroed, count(nullif(l_discount, 0)) as n_values from lineitem group by l_suppkey")
def min_count_sum(spark: SparkSession, d: str) -> DataFrame:
    x = F.nullif(F.col("l_discount"), F.lit(0.0))
    rows = table(spark, d, "lineitem", "l_suppkey", "l_discount").groupBy(F.col("l_suppkey").alias("entity"))
    return rows.agg(total(x).isNull().alias("all_null"), F.round(total(x), 6).alias("kept"), F.round(total(x, "zero"), 6).alias("zeroed"), F.count(x).alias("n_values"))


@book.query(f"""with {ATHLETE_SQL} select athlete, season, points, points - lag(points) over (partition by athlete order by season) as points_delta, minutes - lag(minutes) over (partition by athlete order by season) as minutes_delta,
 season - lag(season) over (partition by athlete order by season) as season_gap from t""")
def lag_vs_selfjoin(spark: SparkSession, d: str) -> DataFrame:
    return with_previous(athlete_seasons(spark, d).select("athlete", "season", "points", "minutes"), ["athlete"], "season", ["points", "minutes"]).drop("minutes")


@book.query(f"""with {_TEAM}, p as (select athlete, season, team from s qualify row_number() over (partition by athlete, season order by minutes desc nulls last, games_played desc nulls last, team nulls last) = 1)
select athlete, season, p.team, round(100 * m.points / nullif({_POSS.replace('field_goals_attempted', 'm.field_goals_attempted')}, 0), 6) as team_rating, case when m.points is not null then 1 else 0 end as has_team_context
from p left join (select * from m where points >= 100) m using (season, team)""")
def team_context_join(spark: SparkSession, d: str) -> DataFrame:
    context = _team_seasons(spark, d).where("points >= 100").select("season", "team", F.round(team_context()["rating"], 6).alias("team_rating"), F.col("points").isNotNull().alias("known"))
    rows = primary_team(spark, d).select("athlete", "season", "team")
    joined = rows.join(assert_unique(context, ["season", "team"], "team context"), ["season", "team"], "left")
    return joined.select("athlete", "season", "team", "team_rating", F.coalesce("known", F.lit(False)).cast("int").alias("has_team_context"))


@book.query(f"""with {ATHLETE_SQL}, {ANCHORS_SQL}, {_LAST}, b as (
  select {"regexp_replace(trim(athlete_id), '[.]0$', '')"} as athlete, date_of_birth from player_core where date_of_birth is not null
  qualify row_number() over (partition by regexp_replace(trim(athlete_id), '[.]0$', '') order by season desc, core_row_id) = 1)
select a.athlete, a.anchor, case when l.athlete is null then 0 else 1 end as has_college_data, l.season as last_season, cast(a.anchor - l.season as double) as season_gap, round(l.rate, 6) as last_points_per_40,
  case when age between 16 and 35 then round(age, 6) end as age_on_july_1
from a left join h l on l.athlete = a.athlete and l.k = 1
left join (select a.athlete, floor((epoch(make_timestamp(a.anchor, 7, 1, 0, 0, 0)) - epoch(b.date_of_birth)) / 86400) / 365.2425 as age from a join b on b.athlete = a.athlete) g on g.athlete = a.athlete""")
def pip_history_features(spark: SparkSession, d: str) -> DataFrame:
    from quillspan.functions.scalars import age_on_july_first, clean_id, within

    a = anchors(spark, d)
    rows = history_band_join(spark, d).withColumn("rate", safe_divide(40 * F.col("points"), "minutes"))
    last = latest_per(rows, ["athlete"], F.col("season").desc()).select("athlete", F.col("season").alias("last_season"), "rate")
    core = table(spark, d, "player_core", "core_row_id", "athlete_id", "season", "date_of_birth").where("date_of_birth is not null").withColumn("athlete", clean_id("athlete_id"))
    born = latest_per(core, ["athlete"], F.col("season").desc(), F.col("core_row_id").asc()).select("athlete", "date_of_birth")
    out = a.join(last, "athlete", "left").join(born, "athlete", "left")
    return out.select(
        "athlete", "anchor", F.col("last_season").isNotNull().cast("int").alias("has_college_data"), "last_season", (F.col("anchor") - F.col("last_season")).cast("double").alias("season_gap"),
        F.round("rate", 6).alias("last_points_per_40"), F.round(within(age_on_july_first("anchor", "date_of_birth"), 16, 35), 6).alias("age_on_july_1"),
    )


@book.query(f"""with {ATHLETE_SQL}, {ANCHORS_SQL}, {_LAST}, f as (
 select a.athlete, a.anchor, l.rate, n from a left join h l on l.athlete = a.athlete and l.k = 1 left join (select athlete, count(*) as n from h group by athlete) c on c.athlete = a.athlete),
e as (select event_id, draft_year, cast(drafted as int) as drafted, {"case when lower(regexp_replace(trim(college_espn_id), '[.]0$', '')) not in ('', 'nan', 'none', '<na>') then regexp_replace(trim(college_espn_id), '[.]0$', '') end"} as athlete, combine_wingspan, combine_height_wo_shoes, combine_weight from draft_classification)
select event_id, draft_year, drafted, round(combine_wingspan - combine_height_wo_shoes, 6) as combine_derived_reach, round(703 * combine_weight / nullif(combine_height_wo_shoes * combine_height_wo_shoes, 0), 6) as combine_derived_bmi,
 round(f.rate, 6) as college_last_points_per_40, f.n as college_seasons, case when f.n is null then 0 else 1 end as has_college_data from e left join f using (athlete)""")
def pip_enriched(spark: SparkSession, d: str) -> DataFrame:
    from quillspan.functions.scalars import clean_id
    from quillspan.operators.joins import validated_join

    rows = history_band_join(spark, d).withColumn("rate", safe_divide(40 * F.col("points"), "minutes"))
    feats = rows.groupBy("athlete").agg(F.max_by("rate", "season").alias("rate"), F.count("*").alias("n"))
    events = table(spark, d, "draft_classification", "event_id", "draft_year", "drafted", "college_espn_id", "combine_wingspan", "combine_height_wo_shoes", "combine_weight")
    events = events.withColumn("athlete", clean_id("college_espn_id"))
    out = validated_join(events, feats, ["athlete"], "many_to_one", grouped=["right"])
    height = F.col("combine_height_wo_shoes")
    return out.select(
        "event_id", "draft_year", F.col("drafted").cast("int").alias("drafted"), F.round(F.col("combine_wingspan") - height, 6).alias("combine_derived_reach"),
        F.round(safe_divide(703 * F.col("combine_weight"), height * height), 6).alias("combine_derived_bmi"), F.round("rate", 6).alias("college_last_points_per_40"), F.col("n").alias("college_seasons"), F.col("n").isNotNull().cast("int").alias("has_college_data"),
    )


_WIDE = f"""{ATHLETE_SQL}, {ANCHORS_SQL}, g as (select a.anchor, t.* from a join t using (athlete) where season between anchor - 6 and anchor),
c as (select athlete, count(*) as n_seasons, max(season) - min(season) + 1 as span, {', '.join(f'sum({c}) as {c}' for c in TOTALS)} from g group by athlete),
l as (select * from g qualify row_number() over (partition by athlete order by season desc) = 1),
cr as (select athlete, n_seasons, span, {', '.join(f'{x} as {n}' for n, x in RATES_SQL.items())} from c),
lr as (select athlete, anchor - season as season_gap, {', '.join(f'{x} as {n}' for n, x in RATES_SQL.items())} from l),
f as (select cr.athlete, n_seasons, cast(span as bigint) as span, season_gap, {', '.join(f'round(cr.{n}, 6) as college_career_{n}, round(lr.{n}, 6) as college_last_{n}, round(lr.{n} - cr.{n}, 6) as college_delta_{n}' for n in RATES_SQL)} from cr join lr using (athlete))"""


def _wide_features(spark: SparkSession, d: str) -> DataFrame:
    """Per college athlete up to the first draft year: career, last season and their difference in every rate."""
    history = band_join(anchors(spark, d), athlete_seasons(spark, d), ["athlete"], "anchor", "season", -6, 0)
    sums = [F.sum(c).alias(c) for c in TOTALS]
    latest = F.max_by(F.struct(*TOTALS, "season", "anchor"), "season").alias("latest")
    rows = history.groupBy("athlete").agg(F.count("*").alias("n_seasons"), (F.max("season") - F.min("season") + 1).cast("bigint").alias("span"), *sums, latest)
    career, last = rates(), rates("latest.")
    columns = [F.round(x, 6).alias(f"college_{kind}_{n}") for n in career for kind, x in (("career", career[n]), ("last", last[n]), ("delta", last[n] - career[n]))]
    return rows.select("athlete", "n_seasons", "span", (F.col("latest.anchor") - F.col("latest.season")).alias("season_gap"), *columns)


_EVENT_SQL = "e as (select event_id, draft_year, cast(drafted as int) as drafted, " + """case when lower(regexp_replace(trim(college_espn_id), '[.]0$', '')) not in ('', 'nan', 'none', '<na>') then regexp_replace(trim(college_espn_id), '[.]0$', '') end as athlete,
 round(combine_wingspan - combine_height_wo_shoes, 6) as combine_derived_reach, round(703 * combine_weight / nullif(combine_height_wo_shoes * combine_height_wo_shoes, 0), 6) as combine_derived_bmi, college_age_on_july_1 as age_on_july_1 from draft_classification)"""


@book.query(f"with {_WIDE}, {_EVENT_SQL} select event_id, draft_year, drafted, combine_derived_reach, combine_derived_bmi, age_on_july_1, case when f.athlete is null then 0 else 1 end as has_college_data, f.* exclude (athlete) from e left join f on f.athlete = e.athlete")
def pip_enriched_wide(spark: SparkSession, d: str) -> DataFrame:
    """The classification table with all rates of career, last season and development."""
    from quillspan.functions.scalars import clean_id

    events = table(spark, d, "draft_classification", "event_id", "draft_year", "drafted", "college_espn_id", "combine_wingspan", "combine_height_wo_shoes", "combine_weight", "college_age_on_july_1")
    height = F.col("combine_height_wo_shoes")
    events = events.select(
        "event_id", "draft_year", F.col("drafted").cast("int").alias("drafted"), clean_id("college_espn_id").alias("athlete"), F.round(F.col("combine_wingspan") - height, 6).alias("combine_derived_reach"),
        F.round(safe_divide(703 * F.col("combine_weight"), height * height), 6).alias("combine_derived_bmi"), F.col("college_age_on_july_1").alias("age_on_july_1"),
    )
    feats = _wide_features(spark, d).withColumn("has", F.lit(1))  # one row an athlete: it is grouped by it
    return events.join(feats, "athlete", "left").withColumn("has_college_data", F.coalesce("has", F.lit(0))).drop("has", "athlete")


@book.query(f"""with {_WIDE}, {_EVENT_SQL},
r as (select {"case when lower(regexp_replace(trim(nba_player_id), '[.]0$', '')) not in ('', 'nan', 'none', '<na>') then regexp_replace(trim(nba_player_id), '[.]0$', '') end"} as player, event_id from draft_classification where drafted = 1),
k as (select player, e.* from r join e using (event_id) where player is not null qualify row_number() over (partition by player order by draft_year, event_id) = 1),
o as (select athlete, sum(coalesce(minutes, 0)) as minutes_3y, sum(coalesce(points, 0)) as points_3y from a join t using (athlete) where season >= anchor and season < anchor + 3 group by athlete)
select player, event_id, draft_year, combine_derived_reach, combine_derived_bmi, case when f.athlete is null then 0 else 1 end as has_college_data, n_seasons, college_career_points_per_40, college_last_points_per_40, college_delta_points_per_40, college_career_ts_pct, college_last_ts_pct,
  coalesce(minutes_3y, 0) as minutes_3y, coalesce(points_3y, 0) as points_3y from k left join f on f.athlete = k.athlete left join o on o.athlete = k.athlete""")
def pip_drafted_players(spark: SparkSession, d: str) -> DataFrame:
    """One row per drafted player: first draft, measurements, college features and the outcome of three seasons."""
    from quillspan.functions.scalars import clean_id

    ids = table(spark, d, "draft_classification", "event_id", clean_id("nba_player_id").alias("player"))
    rows = pip_enriched_wide(spark, d).where("drafted = 1").join(ids.where("player is not null"), "event_id")
    rows = latest_per(rows, ["player"], F.col("draft_year").asc(), F.col("event_id").asc())
    college = table(spark, d, "draft_classification", "event_id", clean_id("college_espn_id").alias("athlete"))
    outcome = forward_outcome_3y(spark, d).select("athlete", "minutes_3y", "points_3y")
    rows = rows.join(college, "event_id").join(outcome, "athlete", "left")
    return rows.select(
        "player", "event_id", "draft_year", "combine_derived_reach", "combine_derived_bmi", "has_college_data", "n_seasons",
        *[f"college_{k}_points_per_40" for k in ("career", "last", "delta")], "college_career_ts_pct", "college_last_ts_pct",
        F.coalesce("minutes_3y", F.lit(0.0)).alias("minutes_3y"), F.coalesce("points_3y", F.lit(0.0)).alias("points_3y"),
    )


QUERIES, SQL = book.queries, book.sql
