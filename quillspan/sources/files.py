"""Files as tables: yearly partitions, rollups, drifting columns, workbooks, API responses."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.sources.paths import list_paths

PERIOD = r"((?:19|20)\d{2}(?:-\d{2})?)$"


def stem() -> Column:
    """Name of the row's file without its ending."""
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[A-Za-z0-9.]+$", "")


def period_of_file() -> Column:
    """Year or season at the end of the file's name; null without one."""
    return F.nullif(F.regexp_extract(stem(), PERIOD, 1), F.lit(""))


def year_of_file() -> Column:
    return F.substring(period_of_file(), 1, 4).try_cast("int")


def is_rollup(name: str) -> bool:
    return "_all" in Path(name).stem


@dataclass(frozen=True)
class Dataset:
    """Where a logical table lies: yearly files of a folder, and maybe a rollup file."""

    folder: str
    prefix: str
    suffix: str = ".parquet"

    def yearly(self, first: int | None = None, last: int | None = None) -> list[str]:
        """Paths of the yearly files in order; years outside the range are never opened."""
        out = []
        for p in self._files():
            m = re.search(PERIOD, Path(p).stem)
            if m and not is_rollup(p) and (first is None or int(m[1][:4]) >= first) and (last is None or int(m[1][:4]) <= last):
                out.append(p)
        return out

    def _files(self) -> list[str]:
        return list_paths(SparkSession.active(), f"{self.folder}/{self.prefix}*{self.suffix}")

    def rollup(self) -> str | None:
        found = [p for p in self._files() if is_rollup(p)]
        return found[0] if found else None


def read_files(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Parquet or CSV by ending; no path gives an empty table of ``schema``."""
    if not paths:
        return spark.createDataFrame([], schema or T.StructType([]))
    endings = {Path(p).suffix for p in paths}
    if endings == {".parquet"}:
        reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", "true")
        return reader.parquet(*paths)
    if endings <= {".csv", ".gz"}:
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(list(paths))
    raise ValueError(f"no reader for {sorted(endings)}")


def read_yearly(spark: SparkSession, data: Dataset, first: int | None = None, last: int | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Yearly files as one table with ``source_file`` and ``source_year`` from their names."""
    df = read_files(spark, data.yearly(first, last), schema)
    if not df.columns or not data.yearly(first, last):
        return df
    return df.select("*", F.col("_metadata.file_name").alias("source_file"), year_of_file().alias("source_year"))


def read_rollup_or_yearly(spark: SparkSession, data: Dataset, first: int | None = None, last: int | None = None) -> DataFrame:
    whole = data.rollup()
    return read_files(spark, [whole] if whole else data.yearly(first, last))


def read_tolerant(spark: SparkSession, paths: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """The asked columns as asked types; absent ones null; with source file and period."""
    df = read_files(spark, paths)
    have = {c.lower(): c for c in df.columns}
    cols = [F.col(have[c.lower()]).try_cast(t).alias(c) if c.lower() in have else F.lit(None).cast(t).alias(c) for c, t in columns.items()]
    return df.select(*cols, F.col("_metadata.file_name").alias("_source_file"), period_of_file().alias("_source_period"))


def sample_per_file(df: DataFrame, file: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """About ``share`` of each file's rows, the same for every run and partitioning."""
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(file), F.lit(seed)), F.lit(1_000_000))
    return df.where(draw < int(share * 1_000_000))


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(path, parent, format, period, bytes) of all files; their content is not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return df.select(
        "path", F.element_at(F.split("path", "/"), -2).alias("parent"), F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1).alias("format"),
        F.nullif(F.regexp_extract(F.regexp_replace(name, r"\.[A-Za-z0-9.]+$", ""), PERIOD, 1), F.lit("")).alias("period"), F.col("length").alias("bytes"),
    )


def parquet_footer(path: str) -> dict:
    """Rows, columns, types and null counts from a file's footer alone."""
    import pyarrow.fs
    import pyarrow.parquet as pq

    system, inner = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (None, path)
    meta = pq.read_metadata(inner, filesystem=system)
    schema = meta.schema.to_arrow_schema()
    nulls = dict.fromkeys(schema.names, 0)
    for g in range(meta.num_row_groups):
        for c in range(meta.num_columns):
            col = meta.row_group(g).column(c)
            name = col.path_in_schema.split(".")[0]
            if name in nulls and col.statistics and col.statistics.has_null_count:
                nulls[name] += col.statistics.null_count
    return {"rows": meta.num_rows, "columns": schema.names, "types": [str(t) for t in schema.types], "nulls": nulls}


def missing_by_file(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(source_file, feature, n_rows, n_missing); a column absent in a file is missing there."""
    df = read_files(spark, paths)
    columns = df.columns
    wide = df.select("*", F.col("_metadata.file_name").alias("source_file")).groupBy("source_file").agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    return wide.unpivot(["source_file", "n_rows"], columns, "feature", "n_missing")


def footers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, column, type, rows, nulls) of each column of each file; footers are read on the executors."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, c, t, foot["rows"], foot["nulls"][c]) for p in batch["path"] for foot in [parquet_footer(p)] for c, t in zip(foot["columns"], foot["types"])]
            yield pd.DataFrame(rows, columns=["path", "column", "type", "rows", "nulls"])

    named = spark.createDataFrame([(p,) for p in paths], "path string")
    return named.repartition(max(1, min(len(paths), 200)), "path").mapInPandas(read, "path string, column string, type string, rows long, nulls long")


def schema_variants(paths: Sequence[str]) -> dict[str, set[str]]:
    """Types of each column over the files, from their footers."""
    rows = footers(SparkSession.active(), paths).select("column", "type").distinct().collect()  # as many as columns have types
    out: dict[str, set[str]] = {}
    for r in rows:
        out.setdefault(r["column"], set()).add(r["type"])
    return out


RESULT_SETS = "resultSets array<struct<name: string, headers: array<string>, rowSet: array<array<string>>>>, resultSet struct<name: string, headers: array<string>, rowSet: array<array<string>>>"


def read_result_sets(spark: SparkSession, path: str) -> DataFrame:
    """(name, headers, values) of an API response kept as JSON, gzip or not; object or list form."""
    df = spark.read.schema(RESULT_SETS).option("multiLine", "true").json(path)
    every = F.coalesce("resultSets", F.when(F.col("resultSet").isNotNull(), F.array("resultSet")))
    found = df.select(F.explode(every).alias("s"))
    return found.select("s.name", "s.headers", F.explode_outer("s.rowSet").alias("values"))


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def workbook_cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, value) of a workbook: shared, inline and plain cells, gaps skipped."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        texts = []
        if "xl/sharedStrings.xml" in names:
            for item in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si"):
                texts.append("".join(t.text or "" for t in item.iter(f"{_NS}t")))
        titles = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet")]
        for i, title in enumerate(titles, 1):
            part = f"xl/worksheets/sheet{i}.xml"
            if part not in names:
                continue
            for at, row in enumerate(ET.fromstring(z.read(part)).iter(f"{_NS}row")):
                number = int(row.get("r") or at + 1)
                for c in row.iter(f"{_NS}c"):
                    letters = re.sub(r"[^A-Z]", "", c.get("r") or "")
                    column = 0
                    for ch in letters:
                        column = column * 26 + ord(ch) - 64
                    value, inline = c.find(f"{_NS}v"), c.find(f"{_NS}is")
                    if inline is not None:
                        yield title, number, column - 1, "".join(t.text or "" for t in inline.iter(f"{_NS}t"))
                    elif value is not None and value.text is not None:
                        yield title, number, column - 1, texts[int(value.text)] if c.get("t") == "s" else value.text


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """All cells of workbooks, long: path, sheet, row, column, value."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *cell) for p, content in zip(batch["path"], batch["content"]) for cell in workbook_cells(content)]
            yield pd.DataFrame(rows, columns=["path", "sheet", "row", "column", "value"]).astype({"row": "int32", "column": "int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, sheet string, row int, column int, value string")


def readable(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int | None, str]]:
    """(path, rows, error) of each path; an unreadable one is reported, not raised.

    Files are tried side by side: each is a job, and jobs of one session share its executors.
    """

    def attempt(p: str) -> tuple[str, int | None, str]:
        try:
            return p, read_files(spark, [p]).count(), ""
        except Exception as problem:  # noqa: BLE001 - whatever a broken file raises is the finding
            return p, None, type(problem).__name__

    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(attempt, paths))


@dataclass(frozen=True)
class Catalog:
    """Logical tables by name: each a Dataset of yearly files, maybe with a rollup."""

    tables: Mapping[str, Dataset]

    def load(self, spark: SparkSession, name: str, first: int | None = None, last: int | None = None, rollup: bool = True) -> DataFrame:
        """A table by name; an unknown one is an error that lists the known."""
        if name not in self.tables:
            raise KeyError(f"unknown table {name}; known: {', '.join(sorted(self.tables))}")
        read = read_rollup_or_yearly if rollup and first is None and last is None else read_yearly
        return read(spark, self.tables[name], first, last)

    def coverage(self, spark: SparkSession) -> DataFrame:
        """(name, n_files, first_year, last_year, has_rollup) from names alone."""
        rows = []
        for name, data in sorted(self.tables.items()):
            years = [int(re.search(PERIOD, Path(p).stem)[1][:4]) for p in data.yearly()]
            rows.append((name, len(years), min(years, default=None), max(years, default=None), data.rollup() is not None))
        return spark.createDataFrame(rows, "name string, n_files int, first_year int, last_year int, has_rollup boolean")
