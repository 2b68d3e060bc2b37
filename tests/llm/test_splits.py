import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quillspan.llm.components import connected_components
from quillspan.llm.splits import anneal, group_members, split_groups

PLAN = [("test", 0.15), ("train", 0.7), ("validation", 0.15)]


def _roots(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def test_components_equal_union_find(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(1, 80)] + [(7, 7)]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df, "a", "b").collect()}
    want = _roots([e for e in edges if e[0] != e[1]])
    assert got == want


def test_groups_through_several_keys(spark):
    rows = [(1, "a", None), (2, "b", "x"), (3, "a", "x"), (4, None, None), (5, "c", "y"), (6, "c", "z"), (7, None, "z"), (8, "d", "w")]
    df = spark.createDataFrame(rows, "id long, k string, m string").withColumn("group", F.lit("clash")).withColumn("node", F.lit(0))
    got = {r["id"]: r["group"] for r in group_members(df, "id", ["k", "m"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5, 8: 8}


def test_annealing_improves_on_hashing():
    rng = np.random.default_rng(0)
    sizes, labels = rng.integers(1, 12, 400).astype(float), rng.integers(0, 2, 400).astype(float)
    share = np.array([0.15, 0.7, 0.15])
    start = np.searchsorted(np.cumsum(share)[:-1], rng.random(400))
    goal = share * sizes.sum()
    found, cost = anneal(sizes, labels, start, goal, share * labels.sum(), 3)
    off = np.abs(np.bincount(found, sizes, 3) - goal)
    assert off.max() <= 3 and off.sum() < np.abs(np.bincount(start, sizes, 3) - goal).sum() and cost >= 0


def test_splits_keep_groups_and_shares(spark):
    rnd = random.Random(2)
    rows, i = [], 0
    for g in range(600):
        for _ in range(400 if g == 0 else rnd.randint(1, 5)):
            rows.append((i, f"k{g}", rnd.randint(0, 1)))
            i += 1
    df = spark.createDataFrame(rows, "id long, k string, label int")
    out = split_groups(group_members(df, "id", ["k"]), "id", df.select("id", "label"), PLAN, block_size=256).collect()
    assert sorted(r["id"] for r in out) == list(range(i))
    by = defaultdict(set)
    for r in out:
        by[r["group"]].add(r["split_name"])
    assert all(len(v) == 1 for v in by.values())
    sizes = Counter(r["split_name"] for r in out)
    for name, share in PLAN:
        assert abs(sizes[name] / i - share) < 0.01


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, f"k{i // 3}") for i in range(300)], "id long, k string")
    a = split_groups(group_members(df, "id", ["k"]), "id", None, PLAN)
    b = split_groups(group_members(df.repartition(7), "id", ["k"]), "id", None, PLAN)
    assert a.exceptAll(b.select(a.columns)).count() == 0
