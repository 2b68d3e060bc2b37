"""Filling containers of fixed capacity with texts by vector best fit.

Each item is a vector: tokens, one document, attention cost (tokens squared), each over the
container's capacity.  Items are dealt to blocks of a bounded number of tokens by hash; within
a block they are placed from the largest down, each into the open container that fits under
every constraint and leaves the smallest weighted residual norm (or has the largest weighted
dot product with the item).  Only a block's last containers are left partly empty, so the
unused space is bounded by about one container a block.

Defined results: a text above the token capacity is cut into full pieces and a rest, no other text
is cut; an item that alone exceeds the cost capacity has a container to itself; an empty text
is an item of 0 tokens and gets a container; a null text gets no container; repeated rows are
separate items; all is deterministic for given ids, so lost tasks are recomputed alike.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.session import cut_lineage

TOKENIZER_CONF = "spark.quillspan.tokenizer"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def shipped_tokenizer(spark: SparkSession, path: str | None = None) -> str:
    """Name under which the executors find the tokenizer's file; the driver's copy is sent to them."""
    path = path or spark.conf.get(TOKENIZER_CONF, TOKENIZER)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def token_counts(docs: DataFrame, doc_id: str, text: str, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) under a public tokenizer's file; null text: null."""
    name = shipped_tokenizer(docs.sparkSession, tokenizer)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(SparkFiles.get(name))
        made.encode_special_tokens = True
        made.no_truncation()
        for batch in batches:
            out: list[int | None] = []
            texts = batch[text].tolist()
            for i in range(0, len(texts), 64):
                part = [t if isinstance(t, str) else "" for t in texts[i : i + 64]]
                out += [len(e) for e in made.encode_batch_fast(part, add_special_tokens=False)]
            sizes = pd.array([n if isinstance(t, str) else None for n, t in zip(out, texts)], dtype="Int64")
            yield pd.DataFrame({"doc_id": batch[doc_id], "n_tokens": sizes})

    return docs.select(doc_id, text).mapInPandas(count, "doc_id long, n_tokens long")


def best_fit(sizes: np.ndarray, capacity: int, max_items: int, max_cost: float, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> np.ndarray:
    """Container index of each item; ``sizes`` in the order of placement."""
    cap = np.array([capacity, max_items, max_cost], float)
    w = np.array(weights)[:, None]
    out = np.full(len(sizes), -1, np.int64)
    room = np.zeros((3, 256))
    open_ids = np.zeros(256, np.int64)
    n_open = n_all = 0
    smallest = np.minimum.accumulate(sizes[::-1])[::-1] if len(sizes) else sizes
    for i, size in enumerate(sizes):
        item = np.array([size, 1.0, float(size) * size]) / cap
        pick = -1
        if item[2] > 1.0:  # it exceeds the cost alone: a container of its own
            out[i], n_all = n_all, n_all + 1
            continue
        if n_open:
            rest = room[:, :n_open] - item[:, None]
            fits = (rest >= -1e-12).all(axis=0)
            if fits.any():
                score = -(w * rest * rest).sum(axis=0) if rule == "norm" else (w * room[:, :n_open] * item[:, None]).sum(axis=0)
                pick = int(np.where(fits, score, -np.inf).argmax())
        if pick < 0:
            if n_open == room.shape[1]:
                room, open_ids = np.concatenate([room, np.zeros_like(room)], axis=1), np.concatenate([open_ids, np.zeros_like(open_ids)])
            pick, n_open = n_open, n_open + 1
            room[:, pick], open_ids[pick] = 1.0, n_all
            n_all += 1
        room[:, pick] -= item
        out[i] = open_ids[pick]
        # a container that not even the smallest later item fits into is closed
        if i + 1 < len(sizes) and (room[0, pick] * capacity < smallest[i + 1] - 1e-9 or room[1, pick] * max_items < 1 - 1e-9 or room[2, pick] * max_cost < float(smallest[i + 1]) ** 2 - 1e-6):
            n_open -= 1
            room[:, pick], open_ids[pick] = room[:, n_open], open_ids[n_open]
    return out


def pack(sizes: DataFrame, capacity: int = 2048, max_items: int = 1024, max_cost: float | None = None, block_tokens: int = 4_000_000, rule: str = "norm") -> DataFrame:
    """(doc_id, piece, n_pieces, n_tokens, container) of every item.

    ``sizes``: (doc_id, n_tokens).  ``max_cost`` bounds the sum of squared lengths of a
    container; without it only tokens and ``max_items`` can bind.
    """
    cost = float(capacity) ** 2 if max_cost is None else float(max_cost)
    if capacity < 1 or max_items < 1 or cost <= 0:
        raise ValueError("capacities must be positive")
    piece = int(capacity)
    sizes = cut_lineage(sizes)
    total, count = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-int(total) // block_tokens), -(-int(count) // 100_000))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / piece)).cast("int")
    items = sizes.where("n_tokens is not null").withColumn("n_pieces", parts).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    items = items.select("doc_id", "piece", "n_pieces", F.least(F.lit(piece), F.col("n_tokens") - F.col("piece") * piece).cast("int").alias("n_tokens"))
    items = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True])
        found = best_fit(pdf["n_tokens"].to_numpy(), capacity, max_items, cost, rule=rule)
        return pdf[["doc_id", "piece", "n_pieces", "n_tokens"]].assign(container=found + int(pdf["block"].iloc[0]) * 2**32)

    packed = items.groupBy("block").applyInPandas(fill, "doc_id long, piece int, n_pieces int, n_tokens int, container long")
    nulls = sizes.where("n_tokens is null").select("doc_id", F.lit(0).alias("piece"), F.lit(0).alias("n_pieces"), F.lit(None).cast("int").alias("n_tokens"), F.lit(None).cast("long").alias("container"))
    return packed.unionByName(nulls)
