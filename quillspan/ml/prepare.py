"""Preparation of model tables: coercion, exact medians, population scaling, one-hot columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.scalars import number
from quillspan.operators.windows import exact_medians


def prepare_table(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], keep: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Rows with a target; features coerced (``strict``: bad text fails), infinities null."""
    cast = {c: (F.col(c).cast("double") if strict else number(c)) for c in numeric}
    df = df.where(F.col(target).isNotNull())
    return df.select(*keep, F.col(target).cast("double").alias(target), *[v.alias(c) for c, v in cast.items()], *[F.col(c).cast("string").alias(c) for c in categorical])


@dataclass
class Preparation:
    """What was learned from the fit rows; ``features`` is the order of the vector."""

    numeric: list[str]
    medians: dict[str, float]
    means: dict[str, float] = field(default_factory=dict)
    deviations: dict[str, float] = field(default_factory=dict)
    indicators: list[str] = field(default_factory=list)
    levels: dict[str, list[str]] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *[f"{c}_missing" for c in self.indicators], *[f"{c}={v}" for c, vs in self.levels.items() for v in vs]]

    def apply(self, df: DataFrame, output: str = "features") -> DataFrame:
        """``df`` with the feature vector; an unseen category has zeros throughout."""
        parts = []
        for c in self.numeric:
            x = F.coalesce(F.col(c), F.lit(self.medians[c]))
            if self.means:
                x = (x - F.lit(self.means[c])) / F.lit(self.deviations[c] or 1.0)
            parts.append(x.cast("double"))
        parts += [F.col(c).isNull().cast("double") for c in self.indicators]
        parts += [F.coalesce((F.coalesce(F.col(c), F.lit("missing")) == v).cast("double"), F.lit(0.0)) for c, vs in self.levels.items() for v in vs]
        return df.withColumn(output, array_to_vector(F.array(*parts)))


def learn(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), scale: bool = True, indicators: bool = True, max_levels: int = 10_000) -> Preparation:
    """Medians, means, population deviations and category levels of the fit rows.

    Medians are exact and come from counts by value; levels are counted in full and refused beyond ``max_levels``.
    """
    stats = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"{c}|n") for c in numeric]).first()
    medians = {c: 0.0 if m is None else m for c, m in exact_medians(df, numeric).items()} if numeric else {}
    made = Preparation(list(numeric), medians)
    if scale and numeric:
        filled = [F.coalesce(F.col(c), F.lit(medians[c])) for c in numeric]
        row = df.agg(*[F.avg(x).alias(f"{c}|m") for c, x in zip(numeric, filled)], *[F.stddev_pop(x).alias(f"{c}|s") for c, x in zip(numeric, filled)]).first()
        made.means = {c: row[f"{c}|m"] or 0.0 for c in numeric}
        made.deviations = {c: row[f"{c}|s"] or 0.0 for c in numeric}
    if indicators:
        made.indicators = [c for c in numeric if stats[f"{c}|n"] < stats["n"]]
    for c in categorical:
        rows = df.select(F.coalesce(F.col(c), F.lit("missing")).alias("v")).distinct().orderBy("v").limit(max_levels + 1).collect()
        if len(rows) > max_levels:
            raise ValueError(f"{c} has more than {max_levels} levels")
        made.levels[c] = [r["v"] for r in rows]
    return made
