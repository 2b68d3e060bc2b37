"""Splits that keep related records together.

Rows sharing any key form a component (also through other rows); whole components go to
splits.  Start: hashed assignment by share.  Then a swap search: components are dealt to
blocks of bounded size, each block is annealed by several chains side by side (moves and
exchanges of whole components that lower the deviation of sizes and of label counts), and of
each block the best chain is kept.  Components above ``1 / heavy_parts`` of all rows - at most
``heavy_parts`` of them, whatever the data - are placed first, and the blocks then aim at what
is left of each split.

Defined results: a row without any key is a component of its own; null labels count as 0;
repeated rows stay together by their keys; an empty table or plan gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.components import connected_components
from quillspan.session import cut_lineage


def group_members(rows: DataFrame, row_id: str, keys: Sequence[str]) -> DataFrame:
    """(group, row_id): ``group`` is the smallest row id of the row's component.

    A key's value is represented by the smallest row id that has it, so the graph's nodes are
    row ids and its edges (smallest of one key, smallest of the next key) of each row.
    """
    base = rows.select(F.col(row_id).alias("_id"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    for i in range(len(keys)):
        least = base.where(F.col(f"_k{i}").isNotNull()).groupBy(f"_k{i}").agg(F.min("_id").alias(f"_r{i}"))
        # rows without the key get a key of their own, else they would all meet in one task
        spread = F.coalesce(F.concat(F.lit("k"), F.col(f"_k{i}").cast("string")), F.concat(F.lit("i"), F.col("_id").cast("string")))
        base = base.withColumn("_j", spread).join(least.select(F.concat(F.lit("k"), F.col(f"_k{i}").cast("string")).alias("_j"), f"_r{i}"), "_j", "left").drop("_j")
    reps = [f"_r{i}" for i in range(len(keys))]
    base = cut_lineage(base.select("_id", F.array_compact(F.array(*reps)).alias("_reps")))
    linked = base.where("size(_reps) > 1").select(F.col("_reps")[0].alias("a"), F.explode(F.slice("_reps", 2, len(reps))).alias("b")).where("a <> b")
    found = connected_components(linked, "a", "b")
    first = base.select("_id", F.coalesce(F.get("_reps", F.lit(0)), F.col("_id")).alias("node"))
    return first.join(found, "node", "left").select(F.coalesce("component", "node").alias("group"), F.col("_id").alias(row_id))


def anneal(sizes: np.ndarray, labels: np.ndarray, start: np.ndarray, size_goal: np.ndarray, label_goal: np.ndarray, seed: int, sweeps: int = 12, label_weight: float = 0.5) -> tuple[np.ndarray, float]:
    """Best assignment found and its cost: squared deviation of sizes and label counts."""
    rng = np.random.default_rng(seed)
    k, n = len(size_goal), len(sizes)
    at = start.copy()
    s, p = [float(x) for x in np.bincount(at, sizes, k)], [float(x) for x in np.bincount(at, labels, k)]
    gs, gp = size_goal.tolist(), label_goal.tolist()
    ns, np_ = max(1.0, sum(gs)), max(1.0, sum(gp))

    def part(c: int, ds: float, dp: float) -> float:
        return ((s[c] + ds - gs[c]) / ns) ** 2 + label_weight * ((p[c] + dp - gp[c]) / np_) ** 2

    cost = sum(part(c, 0, 0) for c in range(k))
    best, best_cost, steps = at.copy(), cost, sweeps * n
    heat0 = max(cost / 10, 1e-9)
    draws = rng.integers(0, n, (steps, 2)).tolist() if n else []
    kinds, chances, splits = rng.random(steps).tolist(), rng.random(steps).tolist(), rng.integers(0, k, steps).tolist()
    sz, lb, where = sizes.tolist(), labels.tolist(), at.tolist()
    for t in range(steps):
        i, j = draws[t]
        a = where[i]
        if kinds[t] < 0.5:
            b, ds, dp, j = splits[t], sz[i], lb[i], -1
        else:
            b, ds, dp = where[j], sz[i] - sz[j], lb[i] - lb[j]
        if a == b:
            continue
        delta = part(a, -ds, -dp) + part(b, ds, dp) - part(a, 0, 0) - part(b, 0, 0)
        heat = heat0 * (1 - t / steps) ** 3
        if delta < 0 or heat > 0 and chances[t] < np.exp(-delta / heat):
            s[a], s[b], p[a], p[b] = s[a] - ds, s[b] + ds, p[a] - dp, p[b] + dp
            where[i] = b
            if j >= 0:
                where[j] = a
            cost += delta
            if cost < best_cost - 1e-15:
                best, best_cost = np.array(where), cost
    return best, float(best_cost)


def _search(groups: DataFrame, goals: pd.DataFrame, chains: int, seed: int) -> DataFrame:
    """(group, split) of each block's best chain; ``groups`` has block, group, n, label, u."""
    share = goals["share"].to_numpy()
    edges, label_share = np.cumsum(share)[:-1], goals["label_share"].to_numpy()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group")
        n, label = pdf["n"].to_numpy(float), pdf["label"].to_numpy(float)
        start = np.searchsorted(edges, pdf["u"].to_numpy(), side="right")
        chain = int(pdf["chain"].iloc[0])
        found, cost = anneal(n, label, start, share * n.sum(), label_share * label.sum(), seed + 7919 * chain + int(pdf["block"].iloc[0]))
        return pd.DataFrame({"block": pdf["block"], "chain": chain, "cost": cost, "group": pdf["group"], "split": found})

    tried = groups.withColumn("chain", F.explode(F.array(*[F.lit(c) for c in range(chains)]))).groupBy("block", "chain").applyInPandas(run, "block long, chain int, cost double, group long, split int")
    tried = cut_lineage(tried)
    best = tried.groupBy("block").agg(F.min(F.struct("cost", "chain")).alias("best")).select("block", F.col("best.chain").alias("chain"))
    return tried.join(best, ["block", "chain"]).select("group", "split")


def split_groups(members: DataFrame, row_id: str, label: DataFrame | None, plan: Sequence[tuple[str, float]], block_size: int = 4096, heavy_parts: int = 1000, chains: int = 4, seed: int = 17) -> DataFrame:
    """(group, row_id, split_name) by component swap search.

    ``members``: (group, row_id); ``label``: (row_id, label) or None; ``plan``: the splits with
    their shares, a handful of rows.
    """
    names, shares = [n for n, _ in plan], np.array([s for _, s in plan], float)
    if not names:
        return members.limit(0).withColumn("split_name", F.lit(None).cast("string"))
    if len(names) > 1000 or (shares < 0).any() or abs(shares.sum() - 1) > 1e-6:
        raise ValueError("a plan has at most 1000 splits, with shares that add up to 1")
    rows = members if label is None else members.join(label, row_id, "left")
    value = F.lit(0) if label is None else F.coalesce("label", F.lit(0))
    unit = (F.xxhash64("group", F.lit(seed)).cast("double") / F.lit(2.0**64)) + F.lit(0.5)
    groups = cut_lineage(rows.groupBy("group").agg(F.count("*").alias("n"), F.sum(value).alias("label")).withColumn("u", unit))
    n_groups, total, labels = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("label"), F.lit(0))).first()
    heavy = F.col("n") * heavy_parts > F.lit(int(total))
    goals = pd.DataFrame({"share": shares, "label_share": shares})
    first = cut_lineage(_search(groups.where(heavy).withColumn("block", F.lit(-1).cast("long")), goals, chains, seed))
    # what the heavy components took, per split: as many rows as the plan has
    taken = {r["split"]: (r["n"], r["label"]) for r in first.join(groups, "group").groupBy("split").agg(F.sum("n").alias("n"), F.sum("label").alias("label")).collect()}
    left = np.array([max(0.0, shares[i] * total - taken.get(i, (0, 0))[0]) for i in range(len(names))])
    left_label = np.array([max(0.0, shares[i] * labels - taken.get(i, (0, 0))[1]) for i in range(len(names))])
    goals = pd.DataFrame({"share": left / left.sum() if left.sum() else shares, "label_share": left_label / left_label.sum() if left_label.sum() else shares})
    blocks = max(1, -(-n_groups // block_size))
    light = groups.where(~heavy).withColumn("block", F.pmod(F.xxhash64("group", F.lit(seed + 1)), F.lit(blocks)))
    found = first.unionByName(_search(light, goals, chains, seed + 1))
    named = found.select("group", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("split") + 1).alias("split_name"))
    return members.join(named, "group")
