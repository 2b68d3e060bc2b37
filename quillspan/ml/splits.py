"""Chronological splits, expanding folds and group purging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.joins import purge_groups


@dataclass(frozen=True)
class SplitBounds:
    """Closed year ranges; ``train_end < validation_start <= validation_end < test_start <= test_end``."""

    column: str
    train_end: int
    validation_start: int
    validation_end: int
    test_start: int
    test_end: int

    def __post_init__(self) -> None:
        if not self.train_end < self.validation_start <= self.validation_end < self.test_start <= self.test_end:
            raise ValueError(f"split bounds overlap or are out of order: {self}")


def named_split(bounds: SplitBounds):
    """Column with the name of a row's split, null outside all of them."""
    year = F.col(bounds.column)
    return F.when(year <= bounds.train_end, "train").when(year.between(bounds.validation_start, bounds.validation_end), "validation").when(year.between(bounds.test_start, bounds.test_end), "test")


def chronological_split(df: DataFrame, bounds: SplitBounds) -> dict[str, DataFrame]:
    """The three parts; an empty part is an error."""
    marked = df.withColumn("_split", named_split(bounds))
    sizes = {r["_split"]: r["count"] for r in marked.groupBy("_split").count().collect()}  # at most four rows
    for name in ("train", "validation", "test"):
        if not sizes.get(name):
            raise ValueError(f"the {name} part is empty")
    return {name: marked.where(F.col("_split") == name).drop("_split") for name in ("train", "validation", "test")}


def expanding_folds(folds: Sequence[Mapping[str, int]], column: str, test_start: int) -> list[tuple[int, int, int]]:
    """(train_end, validation_start, validation_end) of each fold, checked."""
    out = []
    for fold in folds:
        end, first, last = fold["train_end"], fold["validation_start"], fold["validation_end"]
        if not end < first <= last:
            raise ValueError(f"fold out of order: {dict(fold)}")
        if last >= test_start:
            raise ValueError(f"fold reaches the test years: {dict(fold)}")
        if out and first <= out[-1][2]:
            raise ValueError(f"fold overlaps the one before: {dict(fold)}")
        out.append((end, first, last))
    if not out:
        raise ValueError("no folds")
    return out


def fold_parts(df: DataFrame, column: str, fold: tuple[int, int, int], group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Training rows up to the fold's end, without groups of its validation rows."""
    end, first, last = fold
    training, validation = df.where(F.col(column) <= end), df.where(F.col(column).between(first, last))
    return (purge_groups(training, validation, group) if group else training), validation
