"""The general data problems on small hand-made tables."""

import itertools
import json
import math
import random
from datetime import datetime

from quillspan.operators import asof, drift, profile


def _cells(spark, rows):
    df = spark.createDataFrame(rows, "id long, load int, h string, p string, mask string")
    return profile.masked_cells(df, "id", "load", ["h", "p"])


def test_masks(spark):
    rows = [("AbC 12", "AaA 9⁺"), ("82.25", "9⁺.9⁺"), ("８１", "N⁺"), ("a\tb", "aSa"), ("Straße", "Aa⁺"), ("--", "-⁺")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "v string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(profile.mask_of(F.col("v"))).collect()] == [m for _, m in rows]


def test_usable_cells(spark):
    heights = {"82": True, " 60.0 ": True, "96": True, "96.01": False, "59.9": False, "7.": False, ".7": False, "8..2": False, "+80": False, "8e1": False, "80\n": False, "８０": False, "080": True}
    places = {"pg": True, "PG / SG": True, "PG-PG": False, "PG-": False, "C-F": True, "PG-SG-SF": False, "P G": False, "PG–SG": False}
    rows = [(i, 1, h, None, "x") for i, h in enumerate(heights)] + [(100 + i, 1, None, p, "x") for i, p in enumerate(places)]
    judged = profile.judged_cells(_cells(spark, rows), ["h"], ["p"])
    bad = {(r["column_name"], r["value"]) for r in judged.where("violation").collect()}
    assert bad == {("h", h) for h, ok in heights.items() if not ok} | {("p", p) for p, ok in places.items() if not ok}


def test_blank_is_missing_and_ties_of_loads(spark):
    rows = [(i, i % 4, "70", " " if i % 4 == 0 else "PG", "m") for i in range(40)]
    cells = profile.judged_cells(_cells(spark, rows), ["h"], ["p"])
    assert cells.where("violation").count() == 0
    loads = profile.deviating_loads(profile.load_figures(cells, ["p"])).collect()
    assert {(r["column_name"], r["load_id"]) for r in loads} == {("p", 0)}


def test_mask_divergence_names_the_odd_load(spark):
    rows = [(i, i % 3, "aa" if i % 3 == 2 else "12", "PG", "m") for i in range(30)]
    found = {(r["column_name"], r["load_id"]): r["divergence"] for r in profile.mask_divergence(_cells(spark, rows)).collect()}
    assert found[("h", 2)] == 1.0 and found[("h", 0)] < 0.4 and found[("p", 1)] == 0.0


def _t(day, hour=0):
    return datetime(2020, 1, day, hour)


def test_as_known_at(spark):
    changes = spark.createDataFrame([(1, "a", _t(1), "x"), (2, "a", _t(3), "y"), (3, "a", _t(3), "z"), (4, None, _t(1), "n"), (5, "a", None, "n")], "row_id long, entity string, known timestamp_ntz, value string")
    events = spark.createDataFrame([(10, "a", _t(1)), (11, "a", _t(2, 5)), (12, "a", _t(3)), (13, "a", datetime(2019, 1, 1)), (14, None, _t(5)), (15, "a", None), (16, "b", _t(9))], "event_id long, entity string, at timestamp_ntz")
    got = {r["event_id"]: r["value"] for r in asof.as_known_at(events.withColumnRenamed("at", "known"), changes, ["entity"], "event_id", "known", "row_id", "known").collect()}
    assert got == {10: "x", 11: "x", 12: "y"}


def test_as_known_at_equals_brute_force(spark):
    import random

    rnd = random.Random(3)
    changes = [(i, rnd.choice("abc"), datetime(2020, 1, rnd.randint(1, 9), rnd.randint(0, 3))) for i in range(200)]
    events = [(i, rnd.choice("abcd"), datetime(2020, 1, rnd.randint(1, 9), rnd.randint(0, 3))) for i in range(150)]
    want = {}
    for e, k, t in events:
        known = [(u, -i) for i, key, u in changes if key == k and u <= t]
        if known:
            want[e] = -max(known)[1]
    c = spark.createDataFrame(changes, "ref long, k string, at timestamp_ntz")
    p = spark.createDataFrame(events, "ref long, k string, at timestamp_ntz")
    assert {r["probe_ref"]: r["change_ref"] for r in asof.match_versions(c, p, ["k"]).collect()} == want


def _raw(spark, files):
    rows, k = [], 0
    for year, records in files.items():
        for at, r in enumerate(records):
            k += 1
            rows.append((k, "f", f"f_{year}", year, at, r if isinstance(r, str) or r is None else json.dumps(r)))
    return spark.createDataFrame(rows, "record_id long, feed_id string, file_name string, file_year int, row_no int, record string")


def _records(spark, files):
    return drift.members(_raw(spark, files), "record", "record_id", "feed_id", "file_name", "file_year", "row_no")


def _changes(spark, files):
    found = _records(spark, files)
    return found, drift.schema_changes(found, "feed_id", "file_name", "file_year", "row_no")


def test_drift_of_flat_records(spark):
    base = [{"A": 80 + i, "WT": 200 + 3 * i, "N": "x"} for i in range(5)]
    files = {
        2001: base,
        2002: [{"a": 80 + i, "Weight (lb)": 201 + 3 * i, "N": "x"} for i in range(5)],
        2003: [{"a": str(81 + i), "Weight (lb)": 199 + 3 * i, "N": "x", "NEW": 9000 + i, "new ": 1} for i in range(5)],
        2004: [{"a": str(81 + i), "Weight (lb)": None, "N": "x"} for i in range(5)] + [None, "", "{", '{"a": "82", "N": "'],
        2005: [{"a": str(81 + i), "LB": 202 + 3 * i, "N": "x"} for i in range(5)],
    }
    _, changes = _changes(spark, files)
    got = {(r["file_name"], r["change"], r["raw_label"]) for r in changes.where("change <> 'column'").collect()}
    assert got == {
        ("f_2002", "respelled", "a"), ("f_2002", "renamed", "Weight (lb)"), ("f_2003", "type_changed", "a"), ("f_2003", "added", "NEW"), ("f_2003", "collision", "new "),
        ("f_2004", "removed", "NEW"), ("f_2005", "renamed", "LB"),
    }


def test_drift_of_nested_records(spark):
    files = {1: [{"p": {"x": 1 + i, "y": 50 + i}} for i in range(4)], 2: [{"p": {"x": 1 + i, "why": 51 + i}, "q": {"z": 9000 + i}} for i in range(4)], 3: [{"p": {"x": 1 + i}, "q": {"z": 9000 + i, "why": 51 + i}} for i in range(4)]}
    _, changes = _changes(spark, files)
    got = {(r["file_name"], r["change"], r["raw_label"]) for r in changes.where("change <> 'column'").collect()}
    assert got == {("f_2", "renamed", "p.why"), ("f_2", "added", "q"), ("f_2", "added", "q.z"), ("f_3", "moved", "q.why")}


def test_cut_off_records_keep_their_complete_members():
    pairs = lambda t: [(k, v if not isinstance(v, drift._Object) else dict(v.pairs)) for k, v in drift._pairs(t)]
    assert pairs('{"a":1,"n":{"x":1},"b":2,"c":"unf') == [("a", 1), ("n", {"x": 1}), ("b", 2), ("c", None)]
    assert pairs('{"a":[1,2],"n":{"x":1,"y":"un') == [("a", [1, 2]), ("n", {"x": 1, "y": None})]
    assert pairs('{"a":12') == [("a", None)] and pairs('{"a":12,') == [("a", 12)] and pairs("{") == [] and pairs('{"a') == []
    deep = '{"a":' * 5000
    assert drift._pairs(deep)[0][0] == "a"


def _field(label, mean, n=20, place=0, sd=1.0):
    return {"label": label, "raw_label": label, "place": place, "numbers": n, "strings": 0, "others": 0, "n_num": n, "s1": n * mean, "s2": n * mean * mean + (n - 1) * sd * sd}


def _brute(a_tree, b_tree, old=(), new=()):
    """Least cost of a mapping of the fields below two paths, over all injections."""
    a, b = [k for k in a_tree if k[0] == old], [k for k in b_tree if k[0] == new]
    weight = lambda tree, k: 1.0 + sum(weight(tree, c) for c in tree if c[0] == (*k[0], k[1]))
    best = math.inf
    for chosen in itertools.product([None, *range(len(b))], repeat=len(a)):
        used = [j for j in chosen if j is not None]
        if len(set(used)) < len(used):
            continue
        cost = sum(weight(b_tree, b[j]) for j in range(len(b)) if j not in used)
        for k, j in zip(a, chosen):
            cost += weight(a_tree, k) if j is None else drift.map_cost(a_tree[k], b_tree[b[j]]) + _brute(a_tree, b_tree, (*k[0], k[1]), (*b[j][0], b[j][1]))
        best = min(best, cost)
    return best


def test_tree_distance_equals_brute_force():
    rnd = random.Random(1)

    def tree():
        out = {}
        for path in [(), ("p",), ("q",), ("p", "r")][: rnd.randint(1, 4)]:
            for label in rnd.sample(["x", "yy", "yz", "w_t"], rnd.randint(1, 3)):
                out[path, label] = _field(label, rnd.choice([1, 2, 50, 52, 900]), place=rnd.randint(0, 3))
        for path in [(), ("p",)]:
            for label in ("p", "q", "r"):
                if any(k[0] == (*path, label) for k in out):
                    out[path, label] = {**_field(label, 0), "n_num": 0, "numbers": 0, "others": 5}
        return out

    for _ in range(60):
        a, b = tree(), tree()
        assert abs(drift._Trees(a, b, 2.0).forests((), ())[0] - _brute(a, b)) < 1e-9


def test_a_label_that_other_values_took_over_is_no_keep():
    before = {((), "a"): _field("a", 80), ((), "k"): _field("k", 5)}
    after = {((), "a"): _field("a", 9000), ((), "b"): _field("b", 80), ((), "k"): _field("k", 5)}
    assert set(drift.edit_script(before, after)) == {("keep", ((), "k"), ((), "k")), ("rename", ((), "a"), ((), "b")), ("add", None, ((), "a"))}


def test_consistent_table_keeps_every_value(spark):
    files = {1: [{"WT": 200 + i, "P.K": i, "N": "x", "record id": 7, "Q": {"Z": i}} for i in range(4)], 2: [{"LBS": f"{201 + i} lb", "p k": i, "N": "y", "q": {"z": i}} for i in range(4)]}
    df = _raw(spark, files)
    rows = drift.consistent_table(df, "record", _changes(spark, files)[1], "feed_id", "file_name", "record_id").collect()
    assert len(rows) == 8 and set(rows[0].asDict()) == {"record_id", "feed_id", "file_name", "wt", "p_k", "n", "record_id_in_record", "q", "q.z"}
    assert sorted(r["wt"] for r in rows) == [200.0, 201.0, 201.0, 202.0, 202.0, 203.0, 203.0, 204.0]
    assert {(r["record_id"], r["n"], r["record_id_in_record"], r["q.z"]) for r in rows} == {(i + 1, "xy"[i // 4], 7.0 if i < 4 else None, float(i % 4)) for i in range(8)}


def test_long_and_odd_records(spark):
    files = {1: [{"A": "x" * 200_000, "": 1, "é": True, "L": [1, 2]}], 2: ['[1, 2]', '"text"', '{"A": "y", "B": 1e3, "B": 2}', "null"]}
    _, changes = _changes(spark, files)
    got = {(r["file_name"], r["change"], r["raw_label"]) for r in changes.where("change <> 'column'").collect()}
    assert ("f_1", "collision", "é") in got and ("f_2", "added", "B") in got and ("f_2", "collision", "B") in got and ("f_2", "removed", "L") in got


def test_files_without_name_or_year(spark):
    rows = [(1, None, "b", 2, 0, '{"A": 1}'), (2, None, None, None, 0, '{"B": "x"}'), (3, None, "a", 1, 0, '{"A": 1}')]
    df = spark.createDataFrame(rows, "record_id long, feed_id string, file_name string, file_year int, row_no int, record string")
    found = drift.members(df, "record", "record_id", "feed_id", "file_name", "file_year", "row_no")
    changes = drift.schema_changes(found, "feed_id", "file_name", "file_year", "row_no")
    assert {(r["file_name"], r["change"], r["raw_label"]) for r in changes.where("change <> 'column'").collect()} == {(None, "added", "B"), (None, "removed", "A")}
    assert drift.consistent_table(df, "record", changes, "feed_id", "file_name", "record_id").count() == 3
