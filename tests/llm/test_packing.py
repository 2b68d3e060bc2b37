import random
from collections import defaultdict

import numpy as np
import pytest

from quillspan.llm.packing import best_fit, pack, token_counts


def _loads(rows):
    out = defaultdict(list)
    for r in rows:
        if r["container"] is not None:
            out[r["container"]].append(r["n_tokens"])
    return out


def test_constraints_and_whole_items(spark):
    rnd = random.Random(4)
    sizes = [(i, rnd.choice([0, 5, 90, 700, 2048, 2049, 7000, rnd.randint(1, 1500)])) for i in range(800)] + [(9001, None)]
    rows = pack(spark.createDataFrame(sizes, "doc_id long, n_tokens long"), max_items=6, block_tokens=200_000).collect()
    loads = _loads(rows)
    assert all(sum(v) <= 2048 and len(v) <= 6 for v in loads.values())
    total, pieces = defaultdict(int), defaultdict(int)
    for r in rows:
        total[r["doc_id"]] += r["n_tokens"] or 0
        pieces[r["doc_id"]] += 1
    assert all(total[i] == (n or 0) for i, n in sizes)
    assert all(pieces[i] == max(1, -(-(n or 0) // 2048)) for i, n in sizes)
    assert [r["container"] for r in rows if r["doc_id"] == 9001] == [None]


def test_little_unused_space(spark):
    rnd = random.Random(9)
    sizes = [(i, min(6000, int(rnd.lognormvariate(5.5, 1)))) for i in range(6000)]
    loads = _loads(pack(spark.createDataFrame(sizes, "doc_id long, n_tokens long")).collect())
    assert sum(map(sum, loads.values())) / (2048 * len(loads)) > 0.985


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_attention_cost_binds(rule):
    sizes = np.array([100] * 40)
    found = best_fit(sizes, 2048, 100, 50_000.0, rule=rule)
    assert np.bincount(found).max() == 5


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_three_capacities_bind(spark, rule):
    """No container exceeds a capacity, nothing that fits the tokens is cut, and few more containers are made
    than any packing needs."""
    rnd = random.Random(2)
    sizes = [(i, rnd.choice([3, 20, 60, 300, 700, 1010, 1400, 1900, 4100])) for i in range(3000)]
    cost = 2048**2 / 2
    rows = pack(spark.createDataFrame(sizes, "doc_id long, n_tokens long"), max_items=8, max_cost=cost, rule=rule, block_tokens=10_000_000).collect()
    loads = list(_loads(rows).values())
    assert all(sum(v) <= 2048 and len(v) <= 8 and (len(v) == 1 or sum(x * x for x in v) <= cost) for v in loads)
    assert all(r["n_pieces"] == 1 for r in rows if dict(sizes)[r["doc_id"]] <= 2048)
    assert any(len(v) == 8 or len(v) > 1 and sum(x * x for x in v) / cost > sum(v) / 2048 for v in loads)
    alone = sum(len(v) == 1 and v[0] ** 2 > cost for v in loads)
    rest = [x for v in loads if not (len(v) == 1 and v[0] ** 2 > cost) for x in v]
    least = alone + max(-(-sum(rest) // 2048), -(-len(rest) // 8), -(-sum(x * x for x in rest) // int(cost)))
    assert len(loads) <= 1.2 * least


def test_an_item_above_the_cost_is_whole_and_alone(spark):
    rows = pack(spark.createDataFrame([(1, 300), (2, 100), (3, 100)], "doc_id long, n_tokens long"), max_cost=50_000).collect()
    assert sorted((r["doc_id"], r["n_pieces"]) for r in rows) == [(1, 1), (2, 1), (3, 1)]
    assert len({r["container"] for r in rows}) == 2


def test_same_result_for_any_partitioning(spark):
    df = spark.createDataFrame([(i, (i * 37) % 900) for i in range(500)], "doc_id long, n_tokens long")
    a, b = pack(df, block_tokens=50_000), pack(df.repartition(7), block_tokens=50_000)
    assert a.exceptAll(b).count() == 0


def test_tokens_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    from quillspan.llm.packing import TOKENIZER

    texts = ["", "one two", "<|endoftext|> stays text", "Žluťoučký " * 3000, None]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").collect()}
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    assert got == {i: None if x is None else len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}
