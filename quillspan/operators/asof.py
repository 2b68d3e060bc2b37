"""Attributes as they were known at an event's time.

Changes and events are reduced to narrow rows (entity, time, id), put in one order per
entity, and the running count of changes is the version number of each row: a change gets
its own number, an event the number of the last change at or before it.  The attributes then
follow by equi-joins on (entity, number) and on the row id that this yields.

The running count is taken in two levels, so that no entity must fit one task: counts per
(entity, day) are aggregated before the shuffle and summed up along the days, and only rows
of one entity and day are ordered together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def versions(changes: DataFrame, probes: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Narrow rows of both inputs with their ``version``; ``is_change`` tells them apart.

    Both inputs hold ``entity``, ``at`` and ``ref`` (an id).  Equal times: changes count
    before probes, and of two changes at one time the one with the smaller ``ref`` gets the
    higher number, so it wins.  Rows with a null entity part or time are dropped.
    """
    keys = list(entity)
    rows = changes.select(*keys, "at", "ref", F.lit(1).alias("is_change")).unionByName(probes.select(*keys, "at", "ref", F.lit(0).alias("is_change")))
    rows = rows.dropna(subset=[*keys, "at"]).withColumn("_day", F.to_date("at"))
    days = rows.groupBy(*keys, "_day").agg(F.sum("is_change").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select(*keys, "_day", F.coalesce(before, F.lit(0)).alias("_before"))
    ordered = Window.partitionBy(*keys, "_day").orderBy(F.col("at").asc(), F.col("is_change").desc(), F.col("ref").desc())
    inside = F.sum("is_change").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    numbered = rows.withColumn("_inside", inside).join(days, [*keys, "_day"])
    return numbered.select(*keys, "ref", "is_change", (F.col("_before") + F.col("_inside")).cast("bigint").alias("version"))


def match_versions(changes: DataFrame, probes: DataFrame, entity: Sequence[str]) -> DataFrame:
    """(probe_ref, change_ref, version): the last change of its entity at or before each probe."""
    keys = [*entity, "version"]
    rows = versions(changes, probes, entity)
    found = rows.where("is_change = 0").withColumnRenamed("ref", "probe_ref").drop("is_change")
    known = rows.where("is_change = 1").withColumnRenamed("ref", "change_ref").drop("is_change")
    return found.join(known, keys).select("probe_ref", "change_ref", "version")


def as_known_at(events: DataFrame, attributes: DataFrame, entity: Sequence[str], event_id: str, event_time: str, row_id: str, known_at: str) -> DataFrame:
    """Each event with the attributes of its entity that were valid at its time.

    An event without an earlier change, or with a null entity or time, gives no row.  Of
    columns named alike in both inputs the event's is kept.  Only (entity, time, id) rows are
    ordered; the wide columns move once, for matched rows alone.
    """
    matched = match_versions(
        attributes.select(*entity, F.col(known_at).alias("at"), F.col(row_id).alias("ref")), events.select(*entity, F.col(event_time).alias("at"), F.col(event_id).alias("ref")), entity
    )
    clash = [c for c in attributes.columns if c in events.columns and c != row_id]
    wide = attributes.drop(*clash).withColumnRenamed(row_id, "change_ref")
    return events.join(matched.withColumnRenamed("probe_ref", event_id), event_id).join(wide, "change_ref").withColumnRenamed("change_ref", row_id)


def latest_season_as_known(events: DataFrame, seasons: DataFrame, back: int = 6) -> DataFrame:
    """event_id, row_id of the rows of the latest season known at each event.

    ``events``: event_id, entity, anchor (year), at.  ``seasons``: entity, season, team,
    known_at, row_id.  Seasons lie in [anchor - back, anchor]; of the seasons with a row
    known by then only the latest counts, and in it for each team the row known last (equal
    times: the smallest row_id).  A null team is a team of its own; a null id, entity, season,
    anchor or time gives no row.
    """
    events = events.dropna(subset=["event_id", "entity", "anchor", "at"]).select("event_id", "entity", "anchor", "at")
    seasons = seasons.dropna(subset=["entity", "season", "known_at", "row_id"]).withColumn("team", F.coalesce("team", F.lit("")))
    # narrow rows of entities that have events, and of no later time or season than these need
    wanted = events.groupBy("entity").agg(F.max("at").alias("_last"), F.max("anchor").alias("_high"), F.min("anchor").alias("_low"))
    in_reach = (F.col("known_at") <= F.col("_last")) & F.col("season").between(F.col("_low") - back, F.col("_high"))
    seasons = seasons.join(wanted, "entity").where(in_reach).select("entity", "season", "team", F.col("known_at").alias("at"), F.col("row_id").alias("ref"))
    teams = seasons.groupBy("entity", "season", "team").agg(F.min("at").alias("_first"))
    probes = events.join(teams, "entity").where(F.col("season").between(F.col("anchor") - back, F.col("anchor")) & (F.col("_first") <= F.col("at")))
    # an event has at most back + 1 seasons, each with the entity's few teams
    newest = F.max("season").over(Window.partitionBy("event_id"))
    probes = probes.withColumn("_newest", newest).where("season = _newest").select("entity", "season", "team", "at", F.col("event_id").alias("ref"))
    matched = match_versions(seasons, probes, ["entity", "season", "team"])
    return matched.select(F.col("probe_ref").alias("event_id"), F.col("change_ref").alias("row_id"))
