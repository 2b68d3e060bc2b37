"""Writing tables: overwrite, audits with header, mirrors, rollups, resumable collection."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.sources.files import Dataset, read_files, read_yearly
from quillspan.sources.paths import exists, remove, write_text


def write_table(df: DataFrame, path: str, compression: str = "zstd", allow_empty: bool = True, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet, replacing what is there; an empty table can be refused."""
    if not allow_empty and df.isEmpty():
        raise ValueError(f"no rows for {path}")
    writer = df.write.mode("overwrite").option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_audit(df: DataFrame, path: str) -> None:
    """CSV with a header in each part, and in the only one where no row exists."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_mirror(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def write_rollup(spark: SparkSession, data: Dataset, path: str, distinct: bool = False, season_column: str | None = None) -> None:
    """Yearly files as one; ``distinct`` drops repeated rows, so reruns change nothing."""
    df = read_yearly(spark, data)
    df = df.withColumn(season_column, F.col("source_year")) if season_column else df
    df = df.drop("source_file", "source_year")
    write_table(df.distinct() if distinct else df, path, allow_empty=False)


def collect_once(path: str, load: Callable[[], DataFrame], force: bool = False) -> str:
    """Write what ``load`` gives unless readable rows are there: written, kept or failed.

    A failure leaves ``<path>.failed.txt``, a later success removes it.
    """
    spark, marker = SparkSession.active(), f"{path}.failed.txt"
    if not force and exists(spark, path):
        try:
            if not read_files(spark, [path]).isEmpty():
                return "kept"
        except Exception:  # noqa: BLE001 - unreadable output is fetched again
            pass
    try:
        write_table(load(), path, allow_empty=False)
    except Exception as problem:  # noqa: BLE001 - the marker records whatever went wrong
        write_text(spark, marker, f"{type(problem).__name__}: {problem}")
        return "failed"
    remove(spark, marker)
    return "written"


def write_report(spark: SparkSession, path: str, report: Mapping) -> None:
    """Metrics, tuning results or a best configuration as one JSON text with sorted keys."""
    write_text(spark, path, json.dumps(report, indent=1, sort_keys=True, default=str))


def write_training(spark: SparkSession, folder: str, metrics: Mapping, predictions: DataFrame, importance: Sequence[tuple[str, float]], best_config: Mapping | None = None) -> None:
    """What a training run leaves: metrics.json, predictions and importance as CSV, best_config.json.

    Vectors and other nested columns of ``predictions`` are left out: CSV has no form for them.
    """
    write_report(spark, f"{folder}/metrics.json", metrics)
    flat = [f.name for f in predictions.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.UserDefinedType))]
    write_audit(predictions.select(*[F.col(f"`{c}`") for c in flat]), f"{folder}/predictions")
    # a row a feature
    write_audit(spark.createDataFrame([(i, n, float(v)) for i, (n, v) in enumerate(importance)], "place int, feature string, importance double").coalesce(1), f"{folder}/importance")
    if best_config is not None:
        write_report(spark, f"{folder}/best_config.json", best_config)


def with_retry(call: Callable, attempts: int = 6, first_wait: float = 2.0, most_wait: float = 90.0, sleep: Callable[[float], None] | None = None, jitter: Callable[[float], float] = lambda x: x):
    """Result of ``call``; failures are repeated after growing waits, the last one is raised."""
    import time

    for k in range(attempts):
        try:
            return call()
        except Exception:  # noqa: BLE001 - any failure may pass
            if k + 1 == attempts:
                raise
            (sleep or time.sleep)(jitter(min(most_wait, first_wait * 2**k)))
