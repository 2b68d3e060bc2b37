"""Access to the Parquet tables of one data directory."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[2])


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Enough where executors see the same path; a cluster without it gets the package by
    ``--py-files``.
    """
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


def table(spark: SparkSession, directory: str, name: str, *columns) -> DataFrame:
    """Read ``directory/name.parquet``; ``columns`` prunes the scan."""
    share_package(spark)
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    return df.select(*columns) if columns else df
