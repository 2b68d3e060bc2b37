"""Drifting record schemas: edit scripts between files and one consistent table.

Records are JSON objects.  Each file's schema is an unordered tree of fields; the script from one file
to the next is that of the constrained tree edit distance: a field maps to a field whose parent its
own parent maps to, the children of two mapped fields are assigned to each other at least cost
(Hungarian method), and a field that is left over costs its deletion or addition with all below it.
Mapping costs the distance of the values, of the labels and of the places; a field that keeps its
label is questioned too, so a label that other values took over is no keep if the old values go on
elsewhere.  Fields left over under different parents are then assigned as moves.  The scripts of a feed, chained,
give every label of every file the column it belongs to: one projection a file, applied to its records.

Statistics of a file are aggregated before anything is gathered: a task that derives scripts
sees one row per (file, field), never records.

Defined results: a null or empty record adds nothing; of a record that is cut off the
complete members count, at any depth; an unlabelled ("") field is a field like any other; an empty table
gives empty results; a null feed or file counts as one more feed or file.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.session import cut_lineage

_MEMBER = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*')
_NUMBER = re.compile(r"-?[0-9]+(?:\.[0-9]+)?")
MEMBER_SCHEMA = "path array<string>, raw_label string, label string, place int, further boolean, kind string, text string, num double"


def normal_label(raw: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", raw.lower()).strip("_")


def _pairs(text: str) -> list[tuple[str, object]]:
    """Members of a record in file order; of a cut-off record those that are complete."""
    try:
        found = _DECODER.decode(text)
        return found.pairs if isinstance(found, _Object) else []
    except (ValueError, RecursionError):
        start = text.find("{")
        return _scanned(text, start + 1, 0) if start >= 0 else []


def _scanned(text: str, at: int, depth: int) -> list[tuple[str, object]]:
    """Complete members from ``at`` on; of the one that is cut off its label, or its own complete members."""
    out: list[tuple[str, object]] = []
    while m := _MEMBER.search(text, at):
        try:
            label = json.loads(f'"{m[1]}"', strict=False)
        except ValueError:
            label = m[1]
        try:
            value, at = _DECODER.raw_decode(text, m.end())
            if isinstance(value, (int, float)) and not isinstance(value, bool) and text[at : at + 64].lstrip()[:1] not in (",", "}", "]"):
                raise ValueError("a number may go on")
        except (ValueError, RecursionError):
            inner = text[m.end() : m.end() + 1] == "{" and depth < 100
            out.append((label, _Object(_scanned(text, m.end() + 1, depth + 1)) if inner else None))
            break
        out.append((label, value))
    return out


class _Object:
    def __init__(self, pairs: list[tuple[str, object]]):
        self.pairs = pairs


_DECODER = json.JSONDecoder(object_pairs_hook=_Object, strict=False)


def _kind(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "object" if isinstance(value, _Object) else "string" if isinstance(value, str) else "array"


def _plain(value: object) -> object:
    if isinstance(value, _Object):
        return {k: _plain(v) for k, v in value.pairs}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _number(value: object) -> float:
    if isinstance(value, bool) or value is None:
        return math.nan
    if isinstance(value, (int, float)):
        return float(value)
    m = _NUMBER.match(value.strip()) if isinstance(value, str) else None
    return float(m[0]) if m else math.nan


#: Objects nested deeper are values, not fields.
MOST_DEPTH = 60


def _dumped(value: object) -> str | None:
    try:
        return json.dumps(_plain(value))
    except RecursionError:
        return None


def _walk(pairs: list[tuple[str, object]], path: tuple[str, ...]) -> Iterator[tuple]:
    seen: set[str] = set()
    for place, (raw, value) in enumerate(pairs):
        label = normal_label(raw)
        kind = _kind(value)
        num = _number(value)
        deep = kind == "object" and len(path) >= MOST_DEPTH
        kind = "array" if deep else kind
        text = None if value is None or kind == "object" else value if isinstance(value, str) else _dumped(value)
        yield list(path), raw, label, place, label in seen, kind, text, None if math.isnan(num) else num
        if kind == "object" and label not in seen:
            yield from _walk(value.pairs, (*path, label))
        seen.add(label)


def members(records: DataFrame, record: str, *keep: str) -> DataFrame:
    """One row per member of each record: ``keep`` columns and MEMBER_SCHEMA."""
    columns = list(keep)
    kept = ", ".join(f"`{c}` {records.schema[c].dataType.simpleString()}" for c in columns)
    names = [x.split()[0] for x in MEMBER_SCHEMA.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*head, *member) for text, *head in zip(batch[record], *[batch[c] for c in columns]) if isinstance(text, str) for member in _walk(_pairs(text), ())]
            yield pd.DataFrame(rows, columns=[*columns, *names]).astype({"place": "int32", "further": "bool", "num": "float64"})

    return records.select(record, *columns).mapInPandas(parse, f"{kept}, {MEMBER_SCHEMA}")


def label_statistics(found: DataFrame, feed: str, file: str, order: str, row: str) -> DataFrame:
    """One row per (feed, file, path, label, raw label, further): types and value statistics.

    The only pass over the records; its size is that of the files' schemas, and it is cut off.
    """
    return cut_lineage(found.groupBy(feed, file, order, "path", "label", "raw_label", "further").agg(
        F.count("*").alias("n"), F.min(row).alias("first_row"), F.avg("place").alias("place"),
        F.count_if(F.col("kind") == "number").alias("numbers"), F.count_if(F.col("kind") == "string").alias("strings"),
        F.count_if(F.col("kind").isin("object", "array", "boolean")).alias("others"),
        F.count("num").alias("n_num"), F.sum("num").alias("s1"), F.sum(F.col("num") * F.col("num")).alias("s2"),
    ))


def file_schemas(labels: DataFrame, feed: str, file: str, order: str) -> DataFrame:
    """One row per (feed, file, path, label): the usual raw label of its first keys, statistics."""
    return labels.where(~F.col("further")).groupBy(feed, file, order, "path", "label").agg(
        F.max_by("raw_label", F.struct(F.col("n"), -F.col("first_row"))).alias("raw_label"),
        *[F.sum(c).alias(c) for c in ("n", "numbers", "strings", "others", "n_num", "s1", "s2")],
        (F.sum(F.col("place") * F.col("n")) / F.sum("n")).alias("place"),
    )


@lru_cache(maxsize=100_000)
def _grams(label: str) -> frozenset[str]:
    return frozenset(label[i : i + 2] for i in range(len(label) - 1)) or frozenset((label,))


def _value_kind(field: dict) -> str | None:
    if field["n_num"]:
        return "number"
    return "text" if field["strings"] else "other" if field["others"] else None


def value_distance(a: dict, b: dict) -> float:
    """Distance of the values of two fields: of numbers the means in pooled deviations, and the spreads.

    Fields of one kind without numbers (texts) say little: they have a fixed distance.
    """
    kinds = {k for x in (a, b) if (k := _value_kind(x))}
    if len(kinds) > 1:
        return 2.0
    if kinds != {"number"} or not (a["n_num"] and b["n_num"]):
        return 0.6
    m = [x["s1"] / x["n_num"] for x in (a, b)]
    v = [max(0.0, (x["s2"] - x["s1"] ** 2 / x["n_num"]) / max(1, x["n_num"] - 1)) for x in (a, b)]
    spread = math.sqrt((v[0] + v[1]) / 2) + 0.01 * (abs(m[0]) + abs(m[1])) / 2 + 1e-9
    # the distance that means of samples of this size keep by chance is taken off
    chance = 2 * math.sqrt(1 / a["n_num"] + 1 / b["n_num"])
    ratio = abs(math.log((math.sqrt(v[0]) + 1e-3) / (math.sqrt(v[1]) + 1e-3)))
    return max(0.0, abs(m[0] - m[1]) / spread - chance) + 0.5 * max(0.0, ratio - 0.9)


#: What a field that keeps its label can cost at most; less than deleting and adding it.
KEEP_AT_MOST = 0.9


def map_cost(a: dict, b: dict) -> float:
    """Cost of field ``a`` going on as field ``b``; adding plus deleting costs 2.

    Under the same label the values count half and up to KEEP_AT_MOST.  Under another one, labels
    without any common letter pair and a new place in the record add to the values' distance.
    """
    if a["label"] == b["label"]:
        return min(KEEP_AT_MOST, 0.5 * value_distance(a, b))
    x, y = _grams(a["label"]), _grams(b["label"])
    return value_distance(a, b) + 0.5 * (1 - len(x & y) / max(1, len(x | y))) + 0.5 * min(1.0, abs(a["place"] - b["place"]) / 3)


def assign(cost: list[list[float]], drop: list[float], add: list[float]) -> tuple[float, list[tuple[int, int]]]:
    """Least cost of pairing rows with columns, a row or column left over costing ``drop`` or ``add``; the pairs.

    Hungarian method on the matrix padded by the deletions and additions, started from the rows'
    minima and the pairs that are tight at once.
    """
    n, m = len(drop), len(add)
    size = n + m
    c = [[*cost[i], *[drop[i]] * n] for i in range(n)] + [[*add, *[0.0] * n] for _ in range(m)]
    u, v, p = [0.0, *[min(row) for row in c]], [0.0] * (size + 1), [0] * (size + 1)
    way, free = [0] * (size + 1), []
    for i in range(1, size + 1):
        j = next((j for j in range(1, size + 1) if not p[j] and c[i - 1][j - 1] == u[i]), 0)
        if j:
            p[j] = i
        else:
            free.append(i)
    for i in free:
        p[0], j0 = i, 0
        least, used = [math.inf] * (size + 1), [False] * (size + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = p[j0], math.inf, 0
            row, ui = c[i0 - 1], u[i0]
            for j in range(1, size + 1):
                if not used[j]:
                    cur = row[j - 1] - ui - v[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(size + 1):
                if used[j]:
                    u[p[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    pairs = sorted((p[j] - 1, j - 1) for j in range(1, m + 1) if 0 < p[j] <= n)
    kept_rows, kept_columns = {i for i, _ in pairs}, {j for _, j in pairs}
    total = sum(cost[i][j] for i, j in pairs) + sum(drop[i] for i in range(n) if i not in kept_rows) + sum(add[j] for j in range(m) if j not in kept_columns)
    return total, pairs


class _Trees:
    """Constrained edit distance between two schema trees given as {(path, label): statistics}."""

    def __init__(self, before: dict[tuple, dict], after: dict[tuple, dict], limit: float):
        self.before, self.after, self.half = before, after, limit / 2
        self.below = [self._children(before), self._children(after)]
        self.memo: dict[tuple, tuple[float, list]] = {}

    @staticmethod
    def _children(fields: dict[tuple, dict]) -> dict[tuple, list[tuple]]:
        out: dict[tuple, list[tuple]] = {}
        for key in fields:
            # a field whose parent has no row of its own (cut-off records) hangs on the nearest one that has
            path = key[0]
            while path and (path[:-1], path[-1]) not in fields:
                path = path[:-1]
            out.setdefault(path, []).append(key)
        return out

    def weight(self, side: int, key: tuple) -> float:
        """Cost of dropping or adding a field with all below it."""
        return self.half + sum(self.weight(side, k) for k in self.below[side].get((*key[0], key[1]), ()))

    def forests(self, old: tuple, new: tuple) -> tuple[float, list[tuple[tuple, tuple]]]:
        """Least cost and mapping of the fields below two paths."""
        got = self.memo.get((old, new))
        if got is None:
            a, b = self.below[0].get(old, ()), self.below[1].get(new, ())
            if not a and not b:
                return 0.0, []
            inner = {(i, j): self.forests((*x[0], x[1]), (*y[0], y[1])) for i, x in enumerate(a) for j, y in enumerate(b)}
            cost = [[map_cost(self.before[x], self.after[y]) + inner[i, j][0] for j, y in enumerate(b)] for i, x in enumerate(a)]
            total, pairs = assign(cost, [self.weight(0, x) for x in a], [self.weight(1, y) for y in b])
            got = self.memo[old, new] = total, [step for i, j in pairs for step in ((a[i], b[j]), *inner[i, j][1])]
        return got


def edit_script(before: dict[tuple, dict], after: dict[tuple, dict], limit: float = 2.0, move: float = 0.5) -> list[tuple[str, tuple | None, tuple | None]]:
    """Edits between two schema trees, parents before children: keep, rename, move, delete, add.

    The mapping is that of the constrained tree edit distance (``limit``: cost of a deletion and an
    addition).  Fields it leaves over are mapped to each other at least cost where that, with ``move``
    for the new parent, costs less than deleting and adding them.
    """
    _, mapping = _Trees(before, after, limit).forests((), ())
    done_old, done_new = {a for a, _ in mapping}, {b for _, b in mapping}
    gone, new = [k for k in before if k not in done_old], [k for k in after if k not in done_new]
    if gone and new:
        parents = {((*a[0], a[1]), (*b[0], b[1])) for a, b in mapping} | {((), ())}
        cost = [[limit * 2 if (a[0], b[0]) in parents else map_cost(before[a], after[b]) + move for b in new] for a in gone]
        mapping = mapping + [(gone[i], new[j]) for i, j in assign(cost, [limit / 2] * len(gone), [limit / 2] * len(new))[1]]
    mapping.sort(key=lambda x: (len(x[1][0]), x[1]))
    places = {((*a[0], a[1]), (*b[0], b[1])) for a, b in mapping} | {((), ())}
    kind = lambda a, b: "move" if (a[0], b[0]) not in places else "keep" if a[1] == b[1] else "rename"
    script: list[tuple[str, tuple | None, tuple | None]] = [(kind(a, b), a, b) for a, b in mapping]
    done_old, done_new = {a for a, _ in mapping}, {b for _, b in mapping}
    return script + [("delete", a, None) for a in before if a not in done_old] + [("add", None, b) for b in after if b not in done_new]


def _files(pdf: pd.DataFrame, file: str, order: str) -> list[tuple[str, dict]]:
    out = []
    # files without a year come last, one without a name is a file of its own
    parts = pdf.groupby([order, file], dropna=False)
    for (_, name), part in sorted(parts, key=lambda x: (pd.isna(x[0][0]), 0 if pd.isna(x[0][0]) else x[0][0], "" if pd.isna(x[0][1]) else x[0][1])):
        out.append((None if pd.isna(name) else name, {(tuple(r["path"]), r["label"]): r for r in part.sort_values(["place", "label"]).to_dict("records")}))
    return out


def _json_type(field: dict) -> str | None:
    if field["numbers"] + field["strings"] == 0:
        return None
    return "number" if field["numbers"] >= field["strings"] else "string"


def _dotted(path: tuple, label: str) -> str:
    return ".".join((*path, label))


def _changes(pdf: pd.DataFrame, file: str, order: str) -> Iterator[tuple]:
    """(file, change, raw label, column, normal label) along the files of one feed; with ``column`` also
    whether all values are numbers."""
    columns: dict[tuple, str] = {}
    types: dict[str, str | None] = {}
    before: dict[tuple, dict] = {}
    born: dict[str, int] = {}
    for at, (name, after) in enumerate(_files(pdf, file, order)):
        now: dict[tuple, str] = {}
        steps = edit_script(before, after) if at else [("first", None, k) for k in after]
        for kind, a, b in steps:
            if kind == "delete":
                yield name, "removed", _dotted(a[0], before[a]["raw_label"]), columns[a], _dotted(*a)
                continue
            field = after[b]
            numeric = bool(field["n_num"] == field["numbers"] + field["strings"] and not field["others"])
            raw, label = _dotted(b[0], field["raw_label"]), _dotted(*b)
            if a is None:
                column = label
                if column in born:  # another field once had this column
                    born[column] += 1
                    column = f"{column}#{born[column]}"
                else:
                    born[column] = 1
                if kind == "add":
                    yield name, "added", raw, column, label
            else:
                column = columns[a]
                if kind in ("rename", "move"):
                    yield name, "renamed" if kind == "rename" else "moved", raw, column, label
                elif before[a]["raw_label"] != field["raw_label"]:
                    yield name, "respelled", raw, column, label
            now[b] = column
            if a is not None and not field["n_num"] and not field["strings"]:  # a file of nulls: the values known before stand for it
                field |= {k: before[a][k] for k in ("n_num", "s1", "s2")}
            kind_now, kind_was = _json_type(field), types.get(column)
            if a is not None and kind_now and kind_was and kind_now != kind_was:
                yield name, "type_changed", raw, column, label
            types[column] = kind_now or (kind_was if a is not None else None)
            yield name, "column", raw, column, label, numeric
        before, columns = after, now


def _joined(label: str) -> Column:
    return F.array_join(F.concat("path", F.array(label)), ".")


def schema_changes(found: DataFrame, feed: str, file: str, order: str, row: str) -> DataFrame:
    """(feed, file, change, raw_label, column, label): every change, and with change ``column`` the
    place of each raw label in the consistent table; ``collision`` for further raw labels."""
    labels = label_statistics(found, feed, file, order, row)
    schemas = file_schemas(labels, feed, file, order)

    def scripts(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(pdf[feed].iloc[0], *x, *[None] * (6 - len(x))) for x in _changes(pdf, file, order)]
        return pd.DataFrame(rows, columns=[feed, file, "change", "raw_label", "column", "label", "numeric"])

    # a group is one feed's schemas: files times fields, no records
    changes = schemas.groupBy(feed).applyInPandas(scripts, f"{feed} string, {file} string, change string, raw_label string, column string, label string, numeric boolean")
    collisions = labels.where("further").select(feed, file, F.lit("collision").alias("change"), _joined("raw_label").alias("raw_label"), F.lit(None).cast("string").alias("column"), _joined("label").alias("label"), F.lit(None).cast("boolean").alias("numeric"))
    return changes.unionByName(collisions.distinct())


def parsed(records: DataFrame, record: str, *keep: str) -> DataFrame:
    """One row a record: ``keep`` columns and the dotted labels, texts and numbers of its first keys."""
    kept = ", ".join(f"`{c}` {records.schema[c].dataType.simpleString()}" for c in keep)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            labels, texts, numbers = [], [], []
            for text in batch[record]:
                found = [m for m in _walk(_pairs(text), ()) if not m[4] and m[5] != "object"] if isinstance(text, str) else []
                labels.append([_dotted(tuple(m[0]), m[2]) for m in found])
                texts.append([m[6] for m in found])
                numbers.append([m[7] for m in found])
            yield batch[list(keep)].assign(_labels=labels, _texts=texts, _numbers=numbers)

    return records.select(record, *keep).mapInPandas(parse, f"{kept}, _labels array<string>, _texts array<string>, _numbers array<double>")


def consistent_table(records: DataFrame, record: str, changes: DataFrame, feed: str, file: str, row_id: str) -> DataFrame:
    """One row a record: row_id, feed, file and a column for each field of any file.

    A file's scripts are one row, from each label to its column; joined to the file's records it
    projects them where they are, so no cell is moved.  A column all of whose values are or begin with numbers is
    a number, any other a text.  Only the names of columns, as many as fields, reach the driver; one that
    clashes with the first three ends in ``_in_record``.
    """
    places = changes.where("change = 'column'")
    columns = places.groupBy("column").agg(F.min("numeric").alias("numeric")).orderBy("column").collect()
    # one row a file: as many entries as it has fields
    projection = places.groupBy(feed, file).agg(F.collect_list(F.struct("label", "column")).alias("m"))
    projection = projection.select(F.struct(feed, file).alias("_file"), F.col("m.label").alias("_from"), F.col("m.column").alias("_to"))
    rows = parsed(records, record, row_id, feed, file).withColumn("_file", F.struct(feed, file)).join(projection, "_file", "left")
    rows = rows.withColumn("_columns", F.transform("_labels", lambda x: F.get("_to", F.array_position("_from", x).cast("int") - 1)))
    place = lambda c: F.nullif(F.array_position("_columns", F.lit(c)), F.lit(0)).cast("int") - 1
    names = {c["column"]: f"{c['column'] or 'unlabelled'}_in_record" if c["column"] in (row_id, feed, file) else c["column"] or "unlabelled" for c in columns}
    return rows.select(row_id, feed, file, *[F.get("_numbers" if c["numeric"] else "_texts", place(c["column"])).alias(names[c["column"]]) for c in columns])
