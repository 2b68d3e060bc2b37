"""Evaluation passages inside training texts, by MinHash containment of windows.

A leak is a run of ``run`` words in order, so an item is searched by all its windows of that
size and a document is partitioned into its windows of the same size.  Each window is a set of
``run - shingle + 1`` shingles of ``shingle`` words, and its signature is a band of ``rows`` minima
under as many hashes of its shingles.  Sets that are equal have equal minima, so no leak can be missed; several
minima keep a phrase that many texts share from making candidates of them all; and as
neighbouring windows mostly share their minima a document keeps few fingerprints.  A shared
fingerprint makes a candidate; the exact containment of a run of words decides.

Signatures of whole items, partitioned by size, cannot give this result: a leak may be 9 shingles of
an item in a document of thousands (figures in the README).  Partitioning by window size is what makes recall certain.

The items' fingerprints go to the tasks if their table is small (``max_item_bytes``, measured);
otherwise fingerprints of both sides are joined by a shuffle, and each document's words are
found once for all its candidates.  Nulls and texts of fewer than
``run`` words give no row; repeated texts each give their rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Maximal runs of letters or digits in lower case."""
    return _WORD.findall(text.lower())


class _Hasher:
    """64-bit hashes of words, remembered for the usual ones."""

    def __init__(self, limit: int = 500_000):
        self.known: dict[str, int] = {}
        self.limit = limit

    def __call__(self, words: list[str]) -> np.ndarray:
        known, out = self.known, []
        for w in words:
            h = known.get(w)
            if h is None:
                h = xxhash.xxh64_intdigest(w)
                if len(known) < self.limit:
                    known[w] = h
            out.append(h)
        return np.array(out, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def window_minima(hashes: np.ndarray, run: int, shingle: int, rows: int = 2) -> np.ndarray:
    """MinHash band of each window of ``run`` words: ``rows`` minima over its shingles of ``shingle`` words."""
    n = len(hashes) - run + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    m = len(hashes) - shingle + 1
    rolled = np.zeros(m, np.uint64)
    for k in range(shingle):
        rolled = rolled * _MULTIPLIER + hashes[k : k + m]
    width, band = run - shingle + 1, np.zeros(n, np.uint64)
    for row in range(rows):
        rolled = _mix(rolled + np.uint64((row + 1) * int(_MULTIPLIER) % 2**64))
        band = _mix(band) + np.lib.stride_tricks.sliding_window_view(rolled, width).min(axis=1)
    return band


def _runs(words: list[str], run: int) -> set[str]:
    return {" ".join(words[i : i + run]) for i in range(len(words) - run + 1)}


def _direct(docs: DataFrame, items: list[tuple[int, str]], run: int, shingle: int) -> DataFrame:
    """Search with the items' fingerprints in every task."""
    hasher = _Hasher()
    prints: dict[int, set[int]] = {}
    for at, (_, text) in enumerate(items):
        for f in np.unique(window_minima(hasher(words_of(text)), run, shingle)).tolist():
            prints.setdefault(f, set()).add(at)
    shared = docs.sparkSession.sparkContext.broadcast((np.array(sorted(prints), np.uint64), prints, [(i, _runs(words_of(t), run)) for i, t in items]))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sorted_prints, owners, wanted = shared.value
        own = _Hasher()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                words = words_of(text) if isinstance(text, str) else []
                if len(words) < run or not len(sorted_prints):
                    continue
                found = np.unique(window_minima(own(words), run, shingle))
                at = np.minimum(np.searchsorted(sorted_prints, found), len(sorted_prints) - 1)
                hits = found[sorted_prints[at] == found].tolist()
                if hits:
                    mine = _runs(words, run)
                    rows += [(doc, wanted[i][0]) for i in sorted({i for f in hits for i in owners[f]}) if not wanted[i][1].isdisjoint(mine)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id"], dtype="int64")

    return docs.mapInPandas(search, "doc_id long, item_id long")


def _fingerprints(texts: DataFrame, key: str, run: int, shingle: int) -> DataFrame:
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _Hasher()
        for batch in batches:
            rows = [(k, f) for k, t in zip(batch[key], batch["text"]) if isinstance(t, str) for f in np.unique(window_minima(own(words_of(t)), run, shingle)).view(np.int64).tolist()]
            yield pd.DataFrame(rows, columns=[key, "print"], dtype="int64")

    return texts.mapInPandas(emit, f"{key} long, print long")


def _joined(docs: DataFrame, items: DataFrame, run: int, shingle: int) -> DataFrame:
    """Search by a join on fingerprints; for item tables of any size."""
    pairs = _fingerprints(docs, "doc_id", run, shingle).join(_fingerprints(items, "item_id", run, shingle), "print").select("doc_id", "item_id").distinct()
    texts = pairs.join(docs, "doc_id").join(items.withColumnRenamed("text", "item_text"), "item_id")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, mine = None, set()
        for batch in batches:
            kept = []
            for doc, text, item in zip(batch["doc_id"], batch["text"], batch["item_text"]):
                if doc != last:  # a document's candidates follow one another
                    last, mine = doc, _runs(words_of(text), run)
                kept.append(not mine.isdisjoint(_runs(words_of(item), run)))
            yield batch.loc[kept, ["doc_id", "item_id"]]

    return texts.sortWithinPartitions("doc_id").mapInPandas(verify, "doc_id long, item_id long")


def leaked_items(docs: DataFrame, items: DataFrame, run: int = 13, shingle: int = 5, max_item_bytes: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id) that share a run of at least ``run`` words.

    ``docs``: doc_id, text; ``items``: item_id, text.
    """
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > max_item_bytes:
        return _joined(docs.where("text is not null"), items, run, shingle)
    return _direct(docs, [(r["item_id"], r["text"]) for r in items.collect()], run, shingle)
