"""Column quality profile by character-class masks.

Every cell is generalised to a mask: upper-case letters ``A``, other letters ``a``, ASCII
digits ``9``, other digits ``N``, white space other than a blank ``S``, all else as it is;
runs of one class carry the mark ``RUN``.  The masks that hold at least ``min_share`` of a
column's non-missing cells are its dominant patterns, all other masks are rare.  A mask that no usable
value can have makes its cells violations; only cells under other masks are put to the rule of values.
Patterns and loads are judged from counts that are aggregated before any shuffle, so
a load or mask holding a third of all rows costs one partial row per task.

Defined results: a null or blank cell is missing and has no mask; an empty table gives empty
results; a null load is reported as a load of its own; clashing names of extra columns do no
harm, since cells are first reduced to (case_id, load_id, column_name, value).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.session import cut_lineage

RUN = "⁺"

#: Masks (runs collapsed) that a usable position can have: letters, blanks and one kind of dash or slash.
PLACE_MASK = rf"^[Aa /{RUN}-]+$"

#: Masks (runs collapsed) of a plain number between optional outer blanks.
NUMBER_MASK = rf"^( {RUN}?)?9{RUN}?(\.9{RUN}?)?( {RUN}?)?$"

# The single positions of a court.
POSITIONS = ("PG", "SG", "SF", "PF", "C", "G", "F")
POSITION_PAIRS = tuple(f"{a}-{b}" for a in POSITIONS for b in POSITIONS if a != b)


def mask_of(value: Column) -> Column:
    """Character-class mask of a text; null stays null."""
    mask = F.regexp_replace(value, r"\p{Lu}", "A")
    mask = F.regexp_replace(mask, r"[\p{L}&&[^A]]", "a")
    mask = F.regexp_replace(mask, r"[0-9]", "9")
    mask = F.regexp_replace(mask, r"[\p{Nd}&&[^9]]", "N")
    mask = F.regexp_replace(mask, r"[\s&&[^ ]]", "S")
    return F.regexp_replace(mask, r"(?s)(.)\1+", f"$1{RUN}")


def masked_cells(df: DataFrame, case_id: str, load_id: str, columns: Sequence[str]) -> DataFrame:
    """One row per cell: case_id, load_id, column_name, value, missing, mask."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), df[c].cast("string").alias("value")) for c in columns])
    cells = df.select(df[case_id].alias("case_id"), df[load_id].alias("load_id"), F.explode(pairs).alias("cell")).select("case_id", "load_id", "cell.*")
    missing = F.coalesce(F.trim("value") == "", F.lit(True))
    return cells.withColumn("missing", missing).withColumn("mask", F.when(~missing, mask_of(F.col("value"))))


def mask_divergence(cells: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence (bits) of each load's masks from those of all other loads.

    Columns: column_name, load_id, cells, divergence.  A load whose column has no
    non-missing cell, or that is the only load, has no row.
    """
    by = cut_lineage(cells.where(~F.col("missing")).groupBy("column_name", "load_id", "mask").agg(F.count("*").cast("double").alias("n")))
    of_load = by.groupBy("column_name", "load_id").agg(F.sum("n").alias("n_load"))
    of_mask = by.groupBy("column_name", "mask").agg(F.sum("n").alias("n_mask"))
    of_all = by.groupBy("column_name").agg(F.sum("n").alias("n_all"))
    joined = by.join(of_load, F.expr("true") & (by.column_name == of_load.column_name) & by.load_id.eqNullSafe(of_load.load_id)).select(by["*"], "n_load")
    joined = joined.join(of_mask, ["column_name", "mask"]).join(of_all, "column_name").where("n_all > n_load")
    p, q = F.col("n") / F.col("n_load"), (F.col("n_mask") - F.col("n")) / (F.col("n_all") - F.col("n_load"))
    half = (p + q) / 2
    # a mask absent from the load adds q/2 to the divergence: together (1 - sum of q seen) / 2
    part = 0.5 * p * F.log2(p / half) + F.when(q > 0, 0.5 * q * F.log2(q / half)).otherwise(0.0)
    grouped = joined.groupBy("column_name", "load_id").agg(F.sum(part).alias("seen"), F.sum(q).alias("q_seen"), F.max("n_load").alias("cells"))
    return grouped.select("column_name", "load_id", F.col("cells").cast("bigint").alias("cells"), F.round(F.col("seen") + 0.5 * (1 - F.col("q_seen")), 6).alias("divergence"))


def normal_position(value: Column) -> Column:
    text = F.replace(F.upper(F.trim(value)), F.lit("/"), F.lit("-"))
    return F.regexp_replace(text, " *- *", "-")


def usable_height(value: Column, mask: Column, low: float = 60, high: float = 96) -> Column:
    """The number of a cell whose mask is a plain number and that lies in the range."""
    x = F.when(mask.rlike(NUMBER_MASK), F.trim(value).try_cast("double"))
    return F.when(x.between(low, high), x)


def usable_position(value: Column) -> Column:
    text = normal_position(value)
    return F.when(text.isin(*POSITIONS, *POSITION_PAIRS), text)


def patterns(cells: DataFrame, fits: Column, min_share: float = 0.005) -> DataFrame:
    """column_name, mask, n_cells, share, rare, fits: every pattern of every column.

    ``rare``: less than ``min_share`` of the column's non-missing cells; ``fits``: the columns' rule on masks.
    """
    counts = cells.where(~F.col("missing")).groupBy("column_name", "mask").agg(F.count("*").alias("n_cells"))
    counts = cut_lineage(counts)
    totals = counts.groupBy("column_name").agg(F.sum("n_cells").alias("total"))
    share = F.col("n_cells") / F.col("total")
    return counts.join(totals, "column_name").select("column_name", "mask", "n_cells", F.round(share, 9).alias("share"), (share < min_share).cast("int").alias("rare"), fits.cast("int").alias("fits"))


def fitting_mask(heights: Sequence[str], positions: Sequence[str]) -> Column:
    """Whether a cell under this mask can be usable at all."""
    return F.when(F.col("column_name").isin(*heights), F.col("mask").rlike(NUMBER_MASK)).when(F.col("column_name").isin(*positions), F.col("mask").rlike(PLACE_MASK)).otherwise(F.lit(True))


def judged_cells(cells: DataFrame, heights: Sequence[str], positions: Sequence[str]) -> DataFrame:
    """Masked cells with the usable ``number`` or ``label`` and ``violation``.

    The mask decides first: a cell under one that no usable value can have violates its column, whatever it
    says.  Cells under fitting masks are put to the exact rule of values.
    """
    fits = fitting_mask(heights, positions)
    height, place = F.col("column_name").isin(*heights), F.col("column_name").isin(*positions)
    cells = cells.withColumn("fits", fits)
    cells = cells.withColumn("number", F.when(height & F.col("fits"), usable_height(F.col("value"), F.col("mask"))))
    cells = cells.withColumn("label", F.when(place & F.col("fits"), usable_position(F.col("value"))))
    return cells.withColumn("violation", ~F.col("missing") & (~F.col("fits") | F.coalesce(F.col("number").cast("string"), F.col("label")).isNull()))


def load_figures(cells: DataFrame, positions: Sequence[str]) -> DataFrame:
    """Figures of each load and column: load_id, column_name, figure, value (null: undefined)."""
    grain = cells.groupBy("load_id", "column_name", "label").agg(
        F.count("*").alias("n"), F.count_if("missing").alias("missing"), F.count_if("violation").alias("bad"), F.sum("number").alias("total"), F.count("number").alias("numbers")
    )
    # a few dozen rows a load: all figures below start from these
    grain = cut_lineage(grain)
    whole = grain.groupBy("load_id", "column_name").agg(*[F.sum(c).alias(c) for c in ("n", "missing", "bad", "total", "numbers")], F.sum(F.when(F.col("label").isNotNull(), F.col("n"))).alias("labels"))
    figures = whole.select(
        "load_id",
        "column_name",
        F.explode(
            F.array(
                F.struct(F.lit("missing").alias("figure"), (F.col("missing") / F.col("n")).alias("value")),
                F.struct(F.lit("unusable").alias("figure"), (F.col("bad") / F.nullif(F.col("n") - F.col("missing"), F.lit(0))).alias("value")),
                F.struct(F.lit("mean").alias("figure"), (F.col("total") / F.nullif(F.col("numbers"), F.lit(0))).alias("value")),
            )
        ).alias("f"),
    ).select("load_id", "column_name", "f.*")
    every = F.explode(F.array(*[F.lit(p) for p in (*POSITIONS, *POSITION_PAIRS)])).alias("label")
    spine = whole.where(F.col("column_name").isin(*positions) & (F.col("labels") > 0)).select("load_id", "column_name", "labels", every)
    shares = spine.alias("s").join(grain.where("label is not null").alias("g"), F.expr("s.load_id <=> g.load_id and s.column_name = g.column_name and s.label = g.label"), "left")
    shares = shares.select("s.load_id", "s.column_name", F.concat(F.lit("share "), F.col("s.label")).alias("figure"), (F.coalesce(F.col("g.n"), F.lit(0)) / F.col("s.labels")).alias("value"))
    return figures.unionByName(shares)


def deviating_loads(figures: DataFrame, share_limit: float = 0.2, mean_limit: float = 1.5) -> DataFrame:
    """column_name, load_id of the loads with a figure off its median over all loads.

    One row per load and figure enters the medians: their number is that of the deliveries.
    """
    defined = figures.where("value is not null")
    medians = defined.groupBy("column_name", "figure").agg(F.median("value").alias("middle"))
    limit = F.when(F.col("figure") == "mean", F.lit(mean_limit)).otherwise(F.lit(share_limit))
    return defined.join(medians, ["column_name", "figure"]).where(F.abs(F.col("value") - F.col("middle")) > limit).select("column_name", "load_id").distinct()


def column_profile(cells: DataFrame) -> DataFrame:
    """Per column: rows, missing, distinct values, masks, value range and mode share."""
    values = cells.groupBy("column_name", "missing", "mask", "value").agg(F.count("*").alias("n"))
    return values.groupBy("column_name").agg(
        F.sum("n").cast("bigint").alias("n_rows"),
        F.sum(F.when(F.col("missing"), F.col("n")).otherwise(0)).cast("bigint").alias("n_missing"),
        F.count_if(~F.col("missing")).cast("bigint").alias("n_distinct"),
        F.countDistinct("mask").cast("bigint").alias("n_masks"),
        F.min(F.when(~F.col("missing"), F.col("value"))).alias("low"),
        F.max(F.when(~F.col("missing"), F.col("value"))).alias("high"),
        F.max(F.when(~F.col("missing"), F.col("n"))).cast("bigint").alias("n_top"),
    )


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column: count, null share, min, max, mean, deviation in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), df[c].cast("double").alias("x")) for c in columns])).alias("p")
    x = F.when(~F.isnan("x"), F.col("x"))
    stats = df.select(pairs).select("p.*").groupBy("column_name")
    return stats.agg(
        F.count("*").alias("n_rows"), F.count(x).alias("n_values"), F.min(x).alias("low"), F.max(x).alias("high"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("deviation")
    )
