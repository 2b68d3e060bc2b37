import random
import re

from quillspan.llm.leaks import leaked_items

WORDS = [f"w{i}" for i in range(60)]


def _brute(docs, items, run):
    words = lambda t: re.findall(r"[^\W_]+", t.lower()) if t else []
    grams = lambda t: {tuple(w[i : i + run]) for w in [words(t)] for i in range(len(w) - run + 1)}
    own = {i: grams(t) for i, t in items}
    return {(d, i) for d, t in docs for g in [grams(t)] for i, x in own.items() if g & x}


def test_both_ways_equal_brute_force(spark):
    rnd = random.Random(8)
    make = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    items = [(i, make(rnd.randint(10, 60))) for i in range(12)] + [(50, None), (51, ""), (52, "short one")]
    docs = []
    for d in range(120):
        text = make(rnd.randint(0, 80)).split()
        if d % 3:
            source = items[d % 12][1].split()
            n = rnd.randint(9, 16)
            a = rnd.randint(0, max(0, len(source) - n))
            text[3:3] = source[a : a + n]
        sep = rnd.choice([" ", ", ", "\n", "_", "—"])
        docs.append((d, sep.join(text).upper() if d % 2 else sep.join(text)))
    docs += [(500, None), (501, ""), (502, "x " * 50_000 + items[0][1])]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = _brute(docs, items, 13)
    assert {tuple(r) for r in leaked_items(a, b).collect()} == want and len(want) > 20
    assert {tuple(r) for r in leaked_items(a, b, max_item_bytes=0).collect()} == want
