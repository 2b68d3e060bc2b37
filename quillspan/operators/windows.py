"""Ranks, shares and neighbours inside partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.scalars import half_up_count
from quillspan.session import cut_lineage


def _bucket(counts: DataFrame, order: str, parts: int) -> Column:
    """Place of a value among cut points taken over all rows; 0 for everything if there are few.

    The cut points are one row of ``parts`` numbers, whatever the size of the table.
    """
    shares = [i / parts for i in range(1, parts)]
    cuts = counts.agg(F.percentile_approx(order, shares, 10 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(order))) if cuts else F.lit(0)


def stretches(spark: SparkSession) -> int:
    """Number of stretches for running totals: four for each shuffle partition, 64 to 512."""
    return min(512, max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def running_totals(counts: DataFrame, by: Sequence[str], order: str, sums: dict[str, str], descending: bool = False, parts: int | None = None) -> DataFrame:
    """``counts`` with running totals along ``order`` (``sums``: total's name to summed column).

    Two levels: totals per stretch of values are summed up along the stretches, and only the
    rows of one stretch are ordered together, so neither a group nor the whole need fit a task.
    """
    parts = parts or stretches(counts.sparkSession)
    counts = counts.withColumn("_b", _bucket(counts, order, parts))
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    whole = counts.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t_{t}") for t, c in sums.items()])
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(direction("_b")).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*by, "_b", *[F.coalesce(F.sum(f"_t_{t}").over(before), F.lit(0)).alias(f"_s_{t}") for t in sums])
    inside = Window.partitionBy(*by, "_b").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = counts.withColumns({f"_i_{t}": F.sum(c).over(inside) for t, c in sums.items()}).alias("l")
    on = F.col("l._b") == F.col("r._b")
    for b in by:
        on = on & F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}"))
    joined = local.join(whole.alias("r"), on)
    return joined.select(*[F.col(f"l.{c}") for c in counts.columns if c != "_b"], *[(F.col(f"l._i_{t}") + F.col(f"r._s_{t}")).alias(t) for t in sums])


def group_totals(df: DataFrame, totals: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``df`` with the columns ``names`` of ``totals``, one row per group (null is a group)."""
    if not by:
        row = totals.first()  # a single row
        return df.withColumns({n: F.lit(row[n]) for n in names})
    on = F.lit(True)
    for b in by:
        on = on & F.col(f"l.{b}").eqNullSafe(F.col(f"g.{b}"))
    return df.alias("l").join(totals.alias("g"), on, "left").select("l.*", *[f"g.{n}" for n in names])


def average_rank(df: DataFrame, value: str, by: Sequence[str], name: str, percent: bool = False) -> DataFrame:
    """Ascending rank with tied values sharing the mean of their places; nulls stay null.

    Counts per value are aggregated first and summed up along the values in two levels.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = running_totals(counts, by, value, {"_upto": "_n"})
    rank = F.col("_upto") - (F.col("_n") - 1) / 2
    if percent:
        ranked = group_totals(ranked, counts.groupBy(*by).agg(F.sum("_n").alias("_all")), by, ["_all"])
        rank = rank / F.col("_all")
    left, right = df.alias("l"), ranked.withColumn(name, rank).alias("r")
    on = F.col(f"l.{value}") == F.col(f"r.{value}")
    for b in by:
        on = on & F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}"))
    return left.join(right, on, "left").select("l.*", f"r.{name}")


def group_medians(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """(by, name): exact median of the numbers of each group, nulls left out.

    Numbers are counted by value and the counts summed up in two levels: no task holds a group.
    """
    counts = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_n")))
    steps = running_totals(counts, by, "_x", {"_upto": "_n"})
    steps = group_totals(steps, counts.groupBy(*by).agg(F.sum("_n").alias("_all")), by, ["_all"])
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_x")))
    return steps.groupBy(*by).agg(((at(F.floor((F.col("_all") - 1) / 2)) + at(F.floor(F.col("_all") / 2))) / 2).alias(name))


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Median of each column's numbers, nulls left out; null for none."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("p")
    rows = group_medians(df.select(pairs).select("p.*"), ["column"], "x", "m").collect()  # a row a column
    return dict.fromkeys(columns) | {r["column"]: r["m"] for r in rows}


def _placed(df: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """``df`` with ``_b`` (its stretch of descending scores; -1 without one), the rows of its group before
    the stretch, in it and in all (``_before``, ``_n``, ``_all``)."""
    rows = df.withColumn("_b", F.when(F.col(score).isNull(), -1).otherwise(_bucket(df, score, stretches(df.sparkSession))))
    sizes = rows.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    # a group has as many rows here as there are stretches
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(group))
    on = F.col("l._b") == F.col("r._b")
    for b in by:
        on = on & F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}"))
    return rows.alias("l").join(sizes.alias("r"), on).select("l.*", "r._before", "r._n", "r._all")


def ordered_rank(df: DataFrame, by: Sequence[str], score: str, ties: Sequence[str], name: str) -> DataFrame:
    """``df`` with each row's place by descending score and then ``ties``, from 1, in its group; rows without
    a score come last.  Rows are ordered only inside a stretch of scores, whose rows before it are counted."""
    within = Window.partitionBy(*by, "_b").orderBy(F.col(score).desc(), *ties)
    return _placed(df, by, score).withColumn(name, F.col("_before") + F.row_number().over(within)).drop("_b", "_before", "_n", "_all")


def choose_top(df: DataFrame, by: Sequence[str], fraction: float, score: str, ties: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``name``: 1 for the first floor(fraction * n + 0.5) rows of each group by descending score
    and then ``ties``; rows without a score come last.

    Whole stretches of scores are taken or left by their counts; only the one that a group is cut in is ordered.
    """
    left = half_up_count(F.col("_all") * fraction) - F.col("_before")
    rows = _placed(df, by, score).withColumn("_left", left)
    cut = (F.col("_left") > 0) & (F.col("_left") < F.col("_n"))
    whole = rows.where(~cut).withColumn(name, (F.col("_left") > 0).cast("int"))
    within = Window.partitionBy(*by, "_b").orderBy(F.col(score).desc(), *ties)
    part = rows.where(cut).withColumn(name, (F.row_number().over(within) <= F.col("_left")).cast("int"))
    return whole.unionByName(part).drop("_b", "_before", "_n", "_all", "_left")


def repeated(keys: Sequence[str]) -> Column:
    """True on every row whose key occurs more than once."""
    return F.count("*").over(Window.partitionBy(*keys)) > 1


def with_previous(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Rows with ``<c>_delta`` to the previous row of their partition and the gap in ``order``."""
    w = Window.partitionBy(*by).orderBy(order)
    deltas = {f"{c}_delta": F.col(c) - F.lag(c).over(w) for c in columns}
    return df.withColumns(deltas | {f"{order}_gap": F.col(order) - F.lag(order).over(w)})
