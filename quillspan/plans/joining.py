"""Queries over joins, set operations, identity and membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.scalars import any_alias, clean_id, compact_name, split_qualifier
from quillspan.operators import audit
from quillspan.operators.aggregates import union_all
from quillspan.operators.joins import existence_flag, identity_tiers, key_membership, latest_per, merge_rosters, name_fallback, purge_groups, symmetric_difference, usual_mapping, validated_join
from quillspan.operators.profile import normal_position
from quillspan.plans.base import Book, sql_id
from quillspan.sources.tables import table

book = Book()
_ROSTERS = {"building": "BUILDING", "machinery": "MACHINERY", "furniture": "FURNITURE", "household": "HOUSEHOLD"}


def _rosters(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Nations of customers of four market segments with a high balance, as four sources."""
    c = table(spark, d, "customer", "c_nationkey", "c_mktsegment", "c_acctbal")
    return {n: c.where((F.col("c_mktsegment") == s) & (F.col("c_acctbal") > 8000)).groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 6).alias(n)) for n, s in _ROSTERS.items()}


_ROSTER_SQL = ", ".join(f"{n} as (select c_nationkey, round(avg(c_acctbal), 6) as {n} from customer where c_mktsegment = '{s}' and c_acctbal > 8000 group by c_nationkey)" for n, s in _ROSTERS.items())


@book.query(f"with {_ROSTER_SQL} select * from building join machinery using (c_nationkey) join furniture using (c_nationkey) join household using (c_nationkey)")
def four_source_intersection(spark: SparkSession, d: str) -> DataFrame:
    return merge_rosters(list(_rosters(spark, d).values()), ["c_nationkey"], "inner")


@book.query(f"with {_ROSTER_SQL} select * from building full join machinery using (c_nationkey) full join furniture using (c_nationkey) full join household using (c_nationkey)")
def four_source_outer(spark: SparkSession, d: str) -> DataFrame:
    return merge_rosters(list(_rosters(spark, d).values()), ["c_nationkey"], "full")


_MEMBER_SQL = "k as (" + " union all ".join(f"select distinct o_custkey as key, '{n}' as source from orders where o_orderpriority = '{p}'" for n, p in (("urgent", "1-URGENT"), ("high", "2-HIGH"), ("low", "5-LOW"))) + ")"


@book.query(f"with {_MEMBER_SQL} select key, cast(max(case when source = 'urgent' then 1 else 0 end) as int) as urgent, cast(max(case when source = 'high' then 1 else 0 end) as int) as high, cast(max(case when source = 'low' then 1 else 0 end) as int) as low, count(*) as sources_present from k group by key having count(*) < 3")
def key_membership_audit(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", F.col("o_custkey").alias("key"), "o_orderpriority")
    parts = {n: o.where(F.col("o_orderpriority") == p) for n, p in (("urgent", "1-URGENT"), ("high", "2-HIGH"), ("low", "5-LOW"))}
    return key_membership(parts, ["key"]).where("sources_present < 3")


@book.query("select c_custkey, case when exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT') then 1 else 0 end as has_urgent from customer")
def existence_flag_urgent(spark: SparkSession, d: str) -> DataFrame:
    urgent = table(spark, d, "orders", F.col("o_custkey").alias("c_custkey"), "o_orderpriority").where("o_orderpriority = '1-URGENT'")
    return existence_flag(table(spark, d, "customer", "c_custkey"), urgent, ["c_custkey"], "has_urgent")


@book.query(f"""with e as (select event_id, {sql_id('nba_player_id')} as player, draft_year from draft_classification)
select event_id, player from e where draft_year <= 2012 and (player is null or player not in (select player from e where draft_year > 2012 and player is not null))""")
def anti_purge(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "draft_classification", "event_id", "nba_player_id", "draft_year").withColumn("player", clean_id("nba_player_id"))
    return purge_groups(e.where("draft_year <= 2012"), e.where("draft_year > 2012"), "player").select("event_id", "player")


@book.query("""with a as (select distinct o_custkey as key from orders where year(o_orderdate) = 1996), b as (select distinct o_custkey as key from orders where year(o_orderdate) = 1997)
select key, 'left' as side from a where key not in (select key from b) union all select key, 'right' from b where key not in (select key from a)""")
def key_symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", F.col("o_custkey").alias("key"), F.year("o_orderdate").alias("year"))
    return symmetric_difference(o.where("year = 1996").select("key").distinct(), o.where("year = 1997").select("key").distinct())


@book.query("select c_custkey as key, c_name as name, c_acctbal as balance, c_mktsegment as segment from customer union all select s_suppkey, s_name, s_acctbal, null from supplier")
def union_drift(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier", F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return union_all([c, s])


@book.query("""with l as (select l_partkey, l_suppkey, count(*) as n, cast(sum(l_quantity) as double) as quantity from lineitem group by all),
r as (select l_partkey, l_suppkey, count(*) as n_returned from lineitem where l_returnflag = 'R' group by all)
select l.l_partkey, l.l_suppkey, n, quantity, coalesce(n_returned, 0) as n_returned from l left join r using (l_partkey, l_suppkey)""")
def left_join_composite(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    keys = ["l_partkey", "l_suppkey"]
    left = items.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    right = items.where("l_returnflag = 'R'").groupBy(*keys).agg(F.count("*").alias("n_returned"))
    return validated_join(left, right, keys, "one_to_one", grouped=["left", "right"]).fillna(0, ["n_returned"])


@book.query("select o_orderkey, o_totalprice, c_name, n_name, r_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey where o_totalprice > 200000")
def left_join_renamed(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice").where("o_totalprice > 200000")
    c, n, r = table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey"), table(spark, d, "nation"), table(spark, d, "region")
    places = n.join(r, n.n_regionkey == r.r_regionkey, "left")
    whole = o.join(c, o.o_custkey == c.c_custkey, "left").join(places, c.c_nationkey == places.n_nationkey, "left")
    return whole.select("o_orderkey", "o_totalprice", "c_name", "n_name", "r_name")


@book.query("""with a as (select o_custkey, round(sum(o_totalprice), 2) as total from orders where year(o_orderdate) = 1996 group by 1), b as (select o_custkey, round(sum(o_totalprice), 2) as total from orders where year(o_orderdate) = 1997 group by 1)
select o_custkey, a.total as total_before, b.total as total_after from a join b using (o_custkey)""")
def inner_suffix_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    part = lambda y, n: o.where(F.col("year") == y).groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias(n))
    return part(1996, "total_before").join(part(1997, "total_after"), "o_custkey")


@book.query("select * from (select l_partkey, l_suppkey, count(*) as n from lineitem group by l_partkey, l_suppkey) qualify row_number() over (partition by l_partkey order by n desc, l_suppkey) = 1")
def crosswalk_mode(spark: SparkSession, d: str) -> DataFrame:
    return usual_mapping(table(spark, d, "lineitem", "l_partkey", "l_suppkey"), "l_partkey", "l_suppkey")


_NAME = "regexp_replace(regexp_replace(lower(strip_accents(coalesce({0}, ''))), '\\b(jr|sr|ii|iii|iv|v)\\b\\.?', ' ', 'g'), '[^a-z0-9]+', '', 'g')"


@book.query(f"""with e as (select event_id, {_NAME.format('player_name')} as name, {_NAME.format("coalesce(organization, '')")} as qualifier, draft_year as year from draft_classification),
c as (select distinct {_NAME.format('athlete_display_name')} as name, season, {sql_id('athlete_id')} as entity, {_NAME.format('team_display_name')} as team from player_season_from_box where {sql_id('athlete_id')} is not null and athlete_display_name is not null),
m as (select event_id, entity, bool_or(season = year) as now, bool_or(season = year and coalesce(team <> '' and qualifier <> '' and (contains(team, qualifier) or contains(qualifier, team)), false)) as fit
  from e join c using (name) where name <> '' and season between year - 6 and year group by event_id, entity),
f as (select event_id, count(*) filter (where now) as n_now, min(entity) filter (where now) as e_now, count(*) filter (where fit) as n_fit, min(entity) filter (where fit) as e_fit, count(*) filter (where not now) as n_past, min(entity) filter (where not now) as e_past from m group by event_id),
g as (select e.event_id, qualifier <> '' as asked, coalesce(n_now, 0) as n_now, e_now, coalesce(n_fit, 0) as n_fit, e_fit, coalesce(n_past, 0) as n_past, e_past from e left join f using (event_id))
select event_id, case when n_now = 1 then e_now when n_now > 1 and asked and n_fit = 1 then e_fit when n_now = 0 and n_past = 1 then e_past end as entity,
 case when n_now = 1 then 'same_season_unique_compact_name' when n_now > 1 and asked and n_fit = 1 then 'same_season_unique_team_qualifier' when n_now > 1 and asked and n_fit = 0 then 'qualifier_did_not_identify_candidate'
  when n_now > 1 and asked then 'ambiguous_team_qualifier' when n_now > 1 then 'ambiguous_same_season_compact_name' when n_past = 1 then 'prior_six_seasons_unique_compact_name' when n_past > 1 then 'ambiguous_prior_six_seasons_compact_name' else 'unmatched_no_exact_candidate' end as status from g""")
def identity_match_tiers(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "draft_classification", "event_id", "player_name", "organization", "draft_year")
    events = events.select("event_id", compact_name("player_name").alias("name"), compact_name("organization").alias("qualifier"), F.col("draft_year").alias("year"))
    box = table(spark, d, "player_season_from_box", "athlete_display_name", "season", "athlete_id", "team_display_name").where("athlete_display_name is not null")
    return identity_tiers(events, box.select(compact_name("athlete_display_name").alias("name"), "season", clean_id("athlete_id").alias("entity"), compact_name("team_display_name").alias("team")))


@book.query(f"""with e as (select event_id, {sql_id('college_espn_id')} as college, college_match_method as how from draft_classification)
select coalesce(nullif(trim(how), ''), 'none') as method, count(*) as n, count(college) as n_matched, round(count(college) / count(*), 6) as rate from e group by 1""")
def match_audit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "draft_classification", "college_match_method", "college_espn_id")
    how = F.coalesce(F.nullif(F.trim("college_match_method"), F.lit("")), F.lit("none")).alias("method")
    got = F.count(clean_id("college_espn_id"))
    return e.groupBy(how).agg(F.count("*").alias("n"), got.alias("n_matched"), F.round(got / F.count("*"), 6).alias("rate"))


@book.query(f"select draft_year, cast(drafted as int) as drafted, count(*) as n, round(avg(case when {sql_id('college_espn_id')} is null then 0.0 else 1.0 end), 6) as match_rate from draft_classification group by all")
def match_rate_by_year(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "draft_classification", "draft_year", "drafted", "college_espn_id")
    return e.groupBy("draft_year", F.col("drafted").cast("int").alias("drafted")).agg(F.count("*").alias("n"), F.round(F.avg(clean_id("college_espn_id").isNotNull().cast("double")), 6).alias("match_rate"))


@book.query("""with w as (select * from orders), p as (select * from orders where year(o_orderdate) <= 1997 union all select * from orders where year(o_orderdate) > 1997),
d as (select (select count(*) from (select * from w except all select * from p)) as only_left, (select count(*) from (select * from p except all select * from w)) as only_right)
select *, case when only_left + only_right = 0 then 1 else 0 end as equal from d""")
def rollup_parity(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    year = F.year("o_orderdate")
    return audit.same_rows(o, union_all([o.where(year <= 1997), o.where(year > 1997)]))


@book.query("""with l as (select count(*) as a, sum(n) as b from (select o_orderkey, count(*) as n from lineitem join orders on l_orderkey = o_orderkey group by 1)), r as (select count(*) as c from lineitem)
select 'rows of orders add up' as check_name, cast(b as bigint) as found, c as expected, case when b = c then 'PASS' else 'FAIL' end as verdict from l, r
union all select 'every order has a customer', count(*), (select count(*) from orders), case when count(*) = (select count(*) from orders) then 'PASS' else 'FAIL' end from orders join customer on o_custkey = c_custkey""")
def consistency_table(spark: SparkSession, d: str) -> DataFrame:
    items, orders, customers = table(spark, d, "lineitem", "l_orderkey"), table(spark, d, "orders", "o_orderkey", "o_custkey"), table(spark, d, "customer", "c_custkey")
    per_order = items.groupBy("l_orderkey").agg(F.count("*").alias("n")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    pairs = [
        ("rows of orders add up", per_order.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("found")), items.agg(F.count("*").alias("expected"))),
        ("every order has a customer", orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi").agg(F.count("*").alias("found")), orders.agg(F.count("*").alias("expected"))),
    ]
    # each side is one aggregated row
    rows = [a.crossJoin(b).select(F.lit(n).alias("check_name"), "found", "expected", F.when(F.col("found") == F.col("expected"), "PASS").otherwise("FAIL").alias("verdict")) for n, a, b in pairs]
    return union_all(rows)


@book.query("""with r as (select year(o_orderdate) as y, count(*) as n from orders group by 1) select cast(y as int) as year, n, cast(sum(n) over () as bigint) as n_all, round(n / sum(n) over (), 6) as share from r""")
def source_summary(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, d, "orders", F.year("o_orderdate").alias("year")).groupBy("year").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row a year
    return o.select("year", "n", whole.alias("n_all"), F.round(F.col("n") / whole, 6).alias("share"))


@book.query("""select o_orderkey, status_changed from (select l_orderkey as o_orderkey, count(distinct l_linestatus) > 1 as status_changed from lineitem group by 1) where status_changed""")
def row_conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem", F.col("l_orderkey").alias("o_orderkey"), "l_linestatus").groupBy("o_orderkey").agg((F.countDistinct("l_linestatus") > 1).alias("status_changed"))
    return rows.where("status_changed")


@book.query(f"""with a as (select {sql_id('nba_player_id')} as player, draft_year, max(cast(drafted as int)) as drafted from draft_classification where {sql_id('nba_player_id')} is not null group by all),
m as (select {sql_id('nba_player_id')} as player, draft_year, round(avg(case when not isnan(wingspan) then wingspan end), 6) as wingspan from combine_anthro where {sql_id('nba_player_id')} is not null group by all)
select player, draft_year, drafted, wingspan, case when wingspan is null then 0 else 1 end as combine_available from a left join m using (player, draft_year)""")
def pip_two_stage(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "draft_classification", "nba_player_id", "draft_year", "drafted").withColumn("player", clean_id("nba_player_id")).where("player is not null")
    m = table(spark, d, "combine_anthro", "nba_player_id", "draft_year", "wingspan").withColumn("player", clean_id("nba_player_id")).where("player is not null")
    keys = ["player", "draft_year"]
    left = a.groupBy(*keys).agg(F.max(F.col("drafted").cast("int")).alias("drafted"))
    right = m.groupBy(*keys).agg(F.round(F.avg(F.when(~F.isnan("wingspan"), F.col("wingspan"))), 6).alias("wingspan"))
    return validated_join(left, right, keys, "one_to_one", grouped=["left", "right"]).withColumn("combine_available", F.col("wingspan").isNotNull().cast("int"))


@book.query(f"""select {sql_id('nba_player_id')} as player, draft_year, event_id from draft_classification where {sql_id('nba_player_id')} is not null qualify row_number() over (partition by {sql_id('nba_player_id')} order by draft_year, event_id) = 1""")
def draft_roster(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "draft_classification", "event_id", "nba_player_id", "draft_year").withColumn("player", clean_id("nba_player_id")).where("player is not null")
    return latest_per(e, ["player"], F.col("draft_year").asc(), F.col("event_id").asc()).select("player", "draft_year", "event_id")


_TYPED = "t as (select event_id, player_name || ' (' || organization || ')' as typed from draft_classification where player_name is not null and organization is not null)"


@book.query(f"""with {_TYPED}, q as (select event_id, trim(regexp_replace(typed, '\\s*\\([^()]*\\)\\s*$', '')) as base, regexp_extract(typed, '\\s*\\(([^()]*)\\)\\s*$', 1) as qualifier from t)
select event_id, base, {_NAME.format('base')} as base_compact, {_NAME.format('qualifier')} as qualifier_compact from q""")
def qualifier_split(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "draft_classification", "event_id", "player_name", "organization").dropna()
    return e.select("event_id", split_qualifier(F.concat("player_name", F.lit(" ("), "organization", F.lit(")"))).alias("q")).select("event_id", "q.*")


@book.query(f"""with {_TYPED}, e as (select d.event_id, {sql_id('college_espn_id')} as athlete, {_NAME.format('organization')} as q, {_NAME.format("regexp_replace(lower(organization), 'university|univ|state|tech', ' ', 'g')")} as short from draft_classification d join t using (event_id)),
b as (select distinct {sql_id('athlete_id')} as athlete, {_NAME.format('team_display_name')} as team from player_season_from_box where team_display_name is not null)
select event_id, bool_or((q <> '' and contains(team, q)) or (short <> '' and contains(team, short))) as any_alias from e join b using (athlete) group by event_id""")
def alias_match(spark: SparkSession, d: str) -> DataFrame:
    """Whether any alias of an event's organisation occurs in a team of its athlete."""
    e = table(spark, d, "draft_classification", "event_id", "college_espn_id", "player_name", "organization").where("organization is not null and player_name is not null")
    short = F.regexp_replace(F.lower("organization"), "university|univ|state|tech", " ")
    e = e.select("event_id", clean_id("college_espn_id").alias("athlete"), F.array(compact_name("organization"), compact_name(short)).alias("aliases"))
    b = table(spark, d, "player_season_from_box", "athlete_id", "team_display_name").where("team_display_name is not null")
    b = b.select(clean_id("athlete_id").alias("athlete"), compact_name("team_display_name").alias("team")).distinct()
    return e.join(b, "athlete").groupBy("event_id").agg(F.max(any_alias(F.col("team"), F.col("aliases"))).alias("any_alias"))


@book.query(f"""with r as (select event_id, {sql_id('nba_player_id')} as player, draft_year, cast(drafted as int) as drafted from draft_classification),
o as (select distinct player, draft_year from r where drafted = 1 and player is not null and draft_year is not null)
select r.draft_year, count(*) as n_rows, count(*) filter (where r.drafted is distinct from case when o.player is null then 0 else 1 end) as n_differing, cast(0 as bigint) as n_stray_outcomes
from r left join o on o.player = r.player and o.draft_year = r.draft_year group by r.draft_year""")
def target_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each year whose target differs from that of their player and year in any row."""
    rows = table(spark, d, "draft_classification", "event_id", "nba_player_id", "draft_year", F.col("drafted").cast("int").alias("drafted")).withColumn("player", clean_id("nba_player_id"))
    return audit.target_integrity(rows, rows.where("drafted = 1"), ["player", "draft_year"], "drafted", "draft_year")


def _checks() -> dict[str, tuple[str, str]]:
    """Check: (table, condition of a bad row), in an SQL that both engines read alike."""
    return {
        "season rows have an athlete": ("player_season_from_box", "athlete_id is null or trim(athlete_id) = ''"),
        "season rows have a season": ("player_season_from_box", "season is null"),
        "games started within games played": ("player_season_from_box", "games_started > games_played"),
        "field goals made within attempted": ("player_season_from_box", "field_goals_made > field_goals_attempted"),
        "three pointers made within attempted": ("player_season_from_box", "three_point_field_goals_made > three_point_field_goals_attempted"),
        "three pointers within field goals": ("player_season_from_box", "three_point_field_goals_attempted > field_goals_attempted"),
        "free throws made within attempted": ("player_season_from_box", "free_throws_made > free_throws_attempted"),
        "shares between 0 and 1": ("player_season_from_box", "fg_pct < 0 or fg_pct > 1 or ft_pct < 0 or ft_pct > 1"),
        "totals are not negative": ("player_season_from_box", "minutes < 0 or points < 0 or rebounds < 0 or assists < 0"),
        "body fat is a percentage": ("combine_anthro", "not isnan(body_fat_pct) and (body_fat_pct < 0 or body_fat_pct > 100)"),
        "measured players have an id": ("combine_anthro", "nba_player_id is null or trim(nba_player_id) = ''"),
        "targets are 0 or 1": ("draft_classification", "drafted is null or drafted not in (0, 1)"),
        "events have a time": ("draft_classification", "event_at is null"),
        "listed ages are plausible": ("player_core", "age < 14 or age > 45"),
    }


#: Checks whose failures are warnings.
TOLERATED = ("measured players have an id", "season rows have an athlete", "listed ages are plausible")


@book.query("\nunion all ".join(
    f"select '{name}' as check_name, (select count(*) from {t}) as n_rows, (select count(*) from {t} where {bad}) as n_bad, case when (select count(*) from {t} where {bad}) = 0 then 'PASS' else '{'WARN' if name in TOLERATED else 'FAIL'}' end as verdict"
    for name, (t, bad) in _checks().items()
))
def domain_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Checks of four tables with a verdict; each table is read once."""
    by_table: dict[str, dict] = {}
    for name, (t, bad) in _checks().items():
        by_table.setdefault(t, {})[name] = F.expr(bad)
    parts = []
    for t, checks in by_table.items():
        found = audit.violations(spark.read.parquet(f"{d}/{t}.parquet"), {f"c{i}": c for i, c in enumerate(checks.values())})
        names = F.create_map(*[F.lit(x) for i, name in enumerate(checks) for x in (f"c{i}", name)])
        parts.append(found.select(names[F.col("check")].alias("check_name"), "n_rows", "n_bad"))
    return audit.verdicts(union_all(parts), TOLERATED)


_FALLBACK = f"""e as (select event_id, {_NAME.format('player_name')} as name, {_NAME.format("coalesce(organization, '')")} as org from draft_classification where {sql_id('college_espn_id')} is null and player_name is not null),
c as (select distinct {_NAME.format('athlete_display_name')} as name, {sql_id('athlete_id')} as entity, {_NAME.format('team_display_name')} as team from player_season_from_box where athlete_display_name is not null),
m as (select event_id, entity, bool_or(coalesce(team <> '' and org <> '' and (contains(team, org) or contains(org, team)), false)) as fits from e join c using (name) where name <> '' and entity is not null group by all),
f as (select event_id, count(*) as n, count(*) filter (where fits) as n_fit, min(entity) as sole, min(entity) filter (where fits) as sole_fit from m group by 1)"""


def _fallback(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "draft_classification", "event_id", "player_name", "organization", "college_espn_id").where(clean_id("college_espn_id").isNull() & F.col("player_name").isNotNull())
    b = table(spark, d, "player_season_from_box", "athlete_id", "athlete_display_name", "team_display_name").where("athlete_display_name is not null")
    events = e.select("event_id", compact_name("player_name").alias("name"), compact_name(F.coalesce("organization", F.lit(""))).alias("org"))
    return name_fallback(events, b.select(compact_name("athlete_display_name").alias("name"), clean_id("athlete_id").alias("entity"), compact_name("team_display_name").alias("team")))


@book.query(f"with {_FALLBACK} select event_id, case when n = 1 then sole else sole_fit end as entity, case when n = 1 then 'unique_name' else 'unique_team_of_name' end as method from f where n = 1 or n_fit = 1")
def name_fallback_accepted(spark: SparkSession, d: str) -> DataFrame:
    return _fallback(spark, d)[0]


@book.query(f"with {_FALLBACK} select event_id, entity, n as n_candidates, n_fit as n_fitting from m join f using (event_id) where n <> 1 and n_fit <> 1")
def name_fallback_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    return _fallback(spark, d)[1]


_PLACE = "nullif(regexp_replace(replace(upper(trim({0}, ' ')), '/', '-'), ' *- *', '-', 'g'), '')"


@book.query(f"""with c as (select {sql_id('athlete_id')} as athlete, {_PLACE.format('position_abbreviation')} as p from player_core),
u as (select athlete, p from c where athlete is not null and p is not null group by athlete, p qualify row_number() over (partition by athlete order by count(*) desc, p) = 1),
e as (select event_id, {sql_id('college_espn_id')} as athlete, {_PLACE.format('position')} as position from draft_classification)
select event_id, e.position, u.p as listed from e join u using (athlete) where e.position is not null and e.position <> u.p""")
def position_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Events whose position differs from the usual listed one of their athlete."""
    core = table(spark, d, "player_core", clean_id("athlete_id").alias("athlete"), normal_position(F.col("position_abbreviation")).alias("listed"))
    usual = usual_mapping(core.withColumn("listed", F.nullif("listed", F.lit(""))), "athlete", "listed").select("athlete", "listed")
    e = table(spark, d, "draft_classification", "event_id", clean_id("college_espn_id").alias("athlete"), F.nullif(normal_position(F.col("position")), F.lit("")).alias("position"))
    return e.join(usual, "athlete").where(F.size(F.array_distinct(F.array_compact(F.array("position", "listed")))) > 1).select("event_id", "position", "listed")


@book.query("""with a as (select column_name as name from (describe player_season_from_box)), b as (select column_name as name from (describe player_core))
select 'only in the box table' as side, name from a where name not in (select name from b) union all select 'only in the core table', name from b where name not in (select name from a)""")
def dictionary_differences(spark: SparkSession, d: str) -> DataFrame:
    """Columns that only one of two tables names, both ways."""
    names = [spark.createDataFrame([(c,) for c in table(spark, d, t).columns], "name string") for t in ("player_season_from_box", "player_core")]
    sides = (("only in the box table", *names), ("only in the core table", *names[::-1]))
    return union_all([a.join(b, "name", "left_anti").select(F.lit(side).alias("side"), "name") for side, a, b in sides])


QUERIES, SQL = book.queries, book.sql
