"""Registration of queries with their SQL, and the frames that many of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.scalars import clean_id
from quillspan.operators.aggregates import TOTALS, collapse_seasons
from quillspan.operators.joins import latest_per
from quillspan.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """Queries by name with the SQL that must give the same rows."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def sql_id(column: str) -> str:
    text = f"regexp_replace(trim({column}), '[.]0$', '')"
    return f"case when lower({text}) not in ('', 'nan', 'none', '<na>') then {text} end"


def entity_seasons(spark: SparkSession, d: str) -> DataFrame:
    """Last known row of each (season, athlete, team)."""
    box = table(spark, d, "player_season_from_box", "box_row_id", "season", "athlete_id", "team_id", "team_display_name", "athlete_display_name", "athlete_position_abbreviation", "known_at", *TOTALS)
    box = box.withColumn("athlete", clean_id("athlete_id")).withColumn("team", F.coalesce(clean_id("team_id"), F.lit(""))).where("athlete is not null")
    return latest_per(box, ["season", "athlete", "team"], F.col("known_at").desc_nulls_last(), F.col("box_row_id").asc()).drop("athlete_id", "team_id")


SEASONS_SQL = f"""s as (
  select *, coalesce(tid, '') as team from (select *, {sql_id('athlete_id')} as athlete, {sql_id('team_id')} as tid from player_season_from_box)
  where athlete is not null
  qualify row_number() over (partition by season, athlete, coalesce(tid, '') order by known_at desc nulls last, box_row_id) = 1)"""


def athlete_seasons(spark: SparkSession, d: str) -> DataFrame:
    """Totals of each (athlete, season) over teams."""
    return collapse_seasons(entity_seasons(spark, d), ["athlete", "season"])


ATHLETE_SQL = f"{SEASONS_SQL},\nt as (select athlete, season, " + ", ".join(f"sum({c}) as {c}" for c in TOTALS) + " from s group by athlete, season)"


def anchors(spark: SparkSession, d: str) -> DataFrame:
    """(athlete, anchor): first draft year of each college athlete."""
    rows = table(spark, d, "draft_classification", "college_espn_id", "draft_year")
    return rows.select(clean_id("college_espn_id").alias("athlete"), "draft_year").dropna().groupBy("athlete").agg(F.min("draft_year").alias("anchor"))


ANCHORS_SQL = f"a as (select {sql_id('college_espn_id')} as athlete, min(draft_year) as anchor from draft_classification where {sql_id('college_espn_id')} is not null and draft_year is not null group by 1)"

RATES_SQL = {
    "fg_pct": "field_goals_made / nullif(field_goals_attempted, 0)",
    "three_pct": "three_point_field_goals_made / nullif(three_point_field_goals_attempted, 0)",
    "ft_pct": "free_throws_made / nullif(free_throws_attempted, 0)",
    "efg_pct": "(field_goals_made + 0.5 * three_point_field_goals_made) / nullif(field_goals_attempted, 0)",
    "ts_pct": "points / nullif(2 * (field_goals_attempted + 0.44 * free_throws_attempted), 0)",
    "assist_turnover_ratio": "assists / nullif(turnovers, 0)",
    "three_attempt_rate": "three_point_field_goals_attempted / nullif(field_goals_attempted, 0)",
    "free_throw_rate": "free_throws_attempted / nullif(field_goals_attempted, 0)",
    "minutes_per_game": "minutes / nullif(games_played, 0)",
    "start_rate": "games_started / nullif(games_played, 0)",
} | {f"{k}_per_40": f"40 * {v} / nullif(minutes, 0)" for k, v in {
    "points": "points", "rebounds": "rebounds", "assists": "assists", "steals": "steals", "blocks": "blocks", "turnovers": "turnovers", "fga": "field_goals_attempted", "tpa": "three_point_field_goals_attempted",
    "fta": "free_throws_attempted", "oreb": "offensive_rebounds", "dreb": "defensive_rebounds", "fouls": "fouls",
}.items()}
