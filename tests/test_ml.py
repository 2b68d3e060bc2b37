"""Splits, folds, purging, coercion, metrics, calibration and tuning."""

import json
import math
import random
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspan.ml import metrics, tuning
from quillspan.ml.models import check_config, fit_calibrator, fit_classifier, fit_model, fit_regressor, importance, load_config, top_features
from quillspan.ml.prepare import learn, prepare_table
from quillspan.ml.splits import SplitBounds, chronological_split, expanding_folds, fold_parts
from quillspan.operators.audit import first_existing, leaking
from quillspan.operators.joins import purge_groups
from quillspan.operators.windows import average_rank, choose_top, exact_medians, group_medians, ordered_rank


def test_parts_follow_the_bounds(spark):
    rnd = random.Random(21)
    years = [rnd.randint(1990, 2009) for _ in range(300)]
    bounds = SplitBounds("season", 1999, 2001, 2003, 2005, 2008)
    parts = chronological_split(spark.createDataFrame([(y,) for y in years], "season int"), bounds)
    want = {"train": sum(y <= 1999 for y in years), "validation": sum(2001 <= y <= 2003 for y in years), "test": sum(2005 <= y <= 2008 for y in years)}
    assert {k: v.count() for k, v in parts.items()} == want
    with pytest.raises(ValueError):
        chronological_split(spark.createDataFrame([(1995,), (2002,)], "season int"), bounds)
    for wrong in ((2001, 2001, 2003, 2005, 2008), (1999, 2004, 2003, 2005, 2008), (1999, 2001, 2005, 2005, 2008), (1999, 2001, 2003, 2009, 2008)):
        with pytest.raises(ValueError):
            SplitBounds("season", *wrong)


def test_purge_equals_brute_force(spark):
    rnd = random.Random(5)
    earlier, later = ([(rnd.choice([None, *range(12)]), i) for i in range(n)] for n in (60, 8))
    seen = {g for g, _ in later if g is not None}
    got = purge_groups(spark.createDataFrame(earlier, "team int, i int"), spark.createDataFrame(later, "team int, i int"), "team").collect()
    assert sorted(r["i"] for r in got) == [i for g, i in earlier if g not in seen]


def test_folds_expand_and_purge(spark):
    rnd = random.Random(13)
    rows = [(rnd.randint(0, 40), rnd.randint(1980, 1992)) for _ in range(200)]
    df = spark.createDataFrame(rows, "team int, season int")
    spec = [{"train_end": e, "validation_start": e + 1, "validation_end": e + 2} for e in (1983, 1985, 1987)]
    for (end, first, last), part in zip(expanding_folds(spec, "season", 1991), spec):
        assert (end, first, last) == (part["train_end"], part["validation_start"], part["validation_end"])
        training, validation = fold_parts(df, "season", (end, first, last), "team")
        held = {t for t, y in rows if first <= y <= last}
        assert validation.count() == sum(first <= y <= last for _, y in rows)
        assert training.count() == sum(y <= end and t not in held for t, y in rows)
    for wrong in ([{"train_end": 1990, "validation_start": 1991, "validation_end": 1991}], [spec[1], spec[0]], []):
        with pytest.raises(ValueError):
            expanding_folds(wrong, "season", 1991)


def test_coercion_of_texts(spark):
    texts = {"7": 7.0, " 2.5 ": 2.5, "-1e2": -100.0, "seven": None, "": None, "nan": None, "-Infinity": None, None: None}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, reach string").withColumn("won", F.when(F.col("i") != 3, 1.0))
    rows = prepare_table(df, "won", ["reach"], [], keep=["i"]).collect()
    assert {r["i"]: r["reach"] for r in rows} == {i: v for i, v in enumerate(texts.values()) if i != 3}
    with pytest.raises(Exception):
        prepare_table(df.withColumn("won", F.lit(1.0)), "won", ["reach"], [], strict=True).collect()


def test_medians_and_ranks_equal_brute_force(spark):
    rnd = random.Random(17)
    rows = [(i, rnd.choice("abc"), rnd.choice([None, *[k / 4 for k in range(9)]])) for i in range(157)]
    df = spark.createDataFrame(rows, "i int, g string, x double")
    for g, m in ((r["g"], r["m"]) for r in group_medians(df, ["g"], "x", "m").collect()):
        assert m == statistics.median(x for _, k, x in rows if k == g and x is not None)
    assert exact_medians(df.where("g = 'a'").withColumn("none", F.lit(None).cast("double")), ["x", "none"]) == {"x": statistics.median(x for _, k, x in rows if k == "a" and x is not None), "none": None}
    want = {}
    for g in "abc":
        for place, (i, _, _) in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[0])), 1):
            want[i] = place
    assert {r["i"]: r["place"] for r in ordered_rank(df, ["g"], "x", ["i"], "place").collect()} == want
    for fraction in (0.0, 0.13, 1 / 3, 0.5, 1.0):
        size = {g: math.floor(fraction * sum(r[1] == g for r in rows) + 0.5) for g in "abc"}
        got = {r["i"]: r["top"] for r in choose_top(df, ["g"], fraction, "x", ["i"], "top").collect()}
        assert got == {i: int(want[i] <= size[g]) for i, g, _ in rows}


def test_null_and_unseen_categories(spark):
    rows = [(80.0, None, "G", 1), (None, 3.1, "F", 0), (78.0, 3.3, None, 1), (82.0, 3.0, "G", 0), (79.0, None, "G-F", 1)]
    df = spark.createDataFrame(rows, "height double, speed double, position string, y int")
    made = learn(df.limit(4), ["height", "speed"], ["position"])
    assert made.features == ["height", "speed", "height_missing", "speed_missing", "position=F", "position=G", "position=missing"]
    last = made.apply(df).collect()[-1]["features"].toArray()
    assert list(last[4:]) == [0.0, 0.0, 0.0] and last[3] == 1.0


def test_perfect_ranking_and_one_class(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.9), (0, 0.2), (1, 0.8)], "y int, p double")
    row = metrics.ranking(df, "y", "p").first()
    assert row["average_precision"] == 1.0 and row["roc_auc"] == 1.0
    row = metrics.ranking(df.where("y = 1"), "y", "p").first()
    assert row["roc_auc"] is None


def test_macro_normalized_ap_equals_brute_force(spark):
    rnd = random.Random(31)
    rows = [(rnd.randint(0, 1), rnd.randint(0, 9) / 9, 1990 + rnd.randint(0, 4)) for _ in range(150)] + [(1, 0.4, 2000), (1, 0.2, 2000)]
    gains = []
    for year in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == year]
        share = sum(y for y, _, _ in own) / len(own)
        if 0 < share < 1:
            ap = sum(sum(y for y, q, _ in own if q >= p) / sum(1 for _, q, _ in own if q >= p) for y, p, _ in own if y) / (share * len(own))
            gains.append((ap - share) / (1 - share))
    row = metrics.macro_normalized_ap(spark.createDataFrame(rows, "y int, p double, year int"), "y", "p", "year").first()
    assert math.isclose(row[0], sum(gains) / len(gains)) and row["n_years"] == len(gains)


def test_ranking_with_ties_equals_brute_force(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 1), rnd.randint(0, 6) / 7) for _ in range(80)]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap = sum(sum(y for y, q in rows if q >= p) / sum(1 for _, q in rows if q >= p) for y, p in rows if y) / len(pos)
    row = metrics.ranking(spark.createDataFrame(rows, "y int, p double"), "y", "p").first()
    assert math.isclose(row["roc_auc"], auc) and math.isclose(row["average_precision"], ap)


def test_average_rank_equals_pandas(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("ab"), rnd.choice([None, 1.0, 2.0, 2.0, 5.0])) for i in range(60)]
    want = pd.DataFrame(rows, columns=["i", "g", "x"]).groupby("g")["x"].rank(method="average", pct=True)
    got = average_rank(spark.createDataFrame(rows, "i int, g string, x double"), "x", ["g"], "r", percent=True).orderBy("i").collect()
    for r, w in zip(got, want):
        assert (r["r"] is None and pd.isna(w)) or math.isclose(r["r"], w)


def test_calibration_recovers_the_slope(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(4000):
        raw = rnd.random() * 0.9 + 0.05
        true = 1 / (1 + math.exp(-(0.5 * math.log(raw / (1 - raw)) - 0.7)))
        rows.append((int(rnd.random() < true), raw))
    df = spark.createDataFrame(rows, "y int, raw_model_score double")
    slope, intercept = fit_calibrator(df, "y", 1e6)
    assert abs(slope - 0.5) < 0.1 and abs(intercept + 0.7) < 0.1
    with pytest.raises(ValueError):
        fit_calibrator(df.where("y = 0"), "y")
    with pytest.raises(Exception, match="not finite"):
        fit_calibrator(df.withColumn("raw_model_score", F.lit(float("nan"))), "y")


CONFIG = {
    "target": "drafted", "numerical_features": ["x"], "categorical_features": [], "group_column": None,
    "split": {"column": "draft_year", "train_end": 2010, "validation_start": 2011, "validation_end": 2011, "test_start": 2012, "test_end": 2012},
    "model": {"name": "logistic_regression", "hyperparameters": {"C": 1.0}}, "probability_calibration": {"C": 1.0},
    "tuning": {"metric": "roc_auc", "search_space": {"C": [0.1, 1.0]}, "validation_folds": [{"train_end": 2010, "validation_start": 2011, "validation_end": 2011}]},
}


def _rows(spark, n=240):
    rnd = random.Random(1)
    return spark.createDataFrame([(i, 2010 + i % 3, (x := rnd.gauss(0, 1)), float(x + rnd.gauss(0, 1) > 0)) for i in range(n)], "event int, draft_year int, x double, drafted double")


def test_classifier_protocol(spark):
    made, parts = fit_classifier(_rows(spark), CONFIG)
    scored = made.decide(made.score(parts["test"]), "draft_year", "event")
    # one feature: the calibrated score must rank as the feature does
    auc = [metrics.ranking(scored, "drafted", c).first()["roc_auc"] for c in ("probability", "raw_model_score", "x")]
    assert auc[0] == auc[1] == auc[2] > 0.5 and scored.where("chosen = 1").count() > 0
    assert importance(made) and top_features(importance(made), 1, ["x"]) == ["x"]


def test_tuning(spark):
    tried = tuning.tune(_rows(spark), CONFIG)
    assert len(tried) == 2 and tried[0]["score"] >= tried[1]["score"]
    assert tuning.grid({"b": [1, 2], "a": [3]}) == [{"a": 3, "b": 1}, {"a": 3, "b": 2}]
    with pytest.raises(ValueError):
        tuning.grid({})
    with pytest.raises(ValueError):
        tuning.candidates({"a": [1]}, 0)
    some = tuning.candidates({"a": list(range(9)), "b": [1, 2]}, 5, 7)
    assert some == tuning.candidates({"a": list(range(9)), "b": [1, 2]}, 5, 7) and len(some) == 5
    assert len(tuning.candidates({"a": [1, 2]}, 50)) == 2
    assert tuning.candidates({"a": [1, 2]}, None, 1, [{"a": 2}]) == [{"a": 2}, {"a": 1}]
    before = dict(CONFIG["model"]["hyperparameters"])
    assert tuning.with_parameters(CONFIG, {"C": 9})["model"]["hyperparameters"] == {"C": 9} and CONFIG["model"]["hyperparameters"] == before


def test_regression_with_log_target(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(x := rnd.random() * 4, math.exp(x)) for _ in range(200)], "x double, y double")
    config = {"target": "y", "numerical_features": ["x"], "categorical_features": [], "model": {"name": "ridge", "hyperparameters": {"alpha": 0.1}}, "log_transform_target": True}
    scored = fit_model(df, config).score(df)
    assert scored.agg(metrics.regression(F.col("y"), F.col("predicted"))["r2"]).first()[0] > 0.95


def test_regression_workflow(spark):
    rnd = random.Random(12)
    df = spark.createDataFrame([(2000 + i % 12, (x := rnd.random() * 3), math.exp(x) + rnd.random()) for i in range(480)], "season int, x double, y double")
    config = {"target": "y", "numerical_features": ["x"], "categorical_features": [], "split": {"column": "season", "train_end": 2006, "validation_start": 2007, "validation_end": 2008, "test_start": 2009, "test_end": 2011}, "model": {"name": "ridge", "hyperparameters": {"alpha": 0.1}}}
    made, found = fit_regressor(df, config)
    assert set(found) == {"train", "validation", "test"} and all(m["r2"] > 0.9 for m in found.values()) and sum(m["n"] for m in found.values()) == 480 and made.log_target
    with pytest.raises(ValueError, match="above -1"):
        fit_regressor(df.withColumn("y", F.col("y") - 10), config)


def test_metric_of_a_search(spark):
    named = {**CONFIG, "tuning": {**CONFIG["tuning"], "metric": None, "selection_metric": "macro_normalized_average_precision"}}
    assert tuning.selection_metric(named) == "macro_normalized_ap" and tuning.selection_metric(CONFIG) == "roc_auc"
    with pytest.raises(ValueError):
        tuning.selection_metric({**CONFIG, "tuning": {"metric": "rmse"}})
    one = _rows(spark).where("draft_year <> 2011 or drafted = 1")
    with pytest.raises(ValueError, match="one class"):
        tuning.tune(one, CONFIG)


def test_pooled_scores_and_subset_of_features(spark):
    rnd = random.Random(6)
    df = spark.createDataFrame([(2000 + i % 6, (x := rnd.random() * 3), rnd.random(), 2 * x + rnd.random()) for i in range(240)], "season int, x double, noise double, y double")
    folds = [{"train_end": e, "validation_start": e + 1, "validation_end": e + 1} for e in (2001, 2002, 2003)]
    config = {"target": "y", "numerical_features": ["x", "noise"], "categorical_features": [], "split": {"column": "season", "test_start": 2005}, "model": {"name": "ridge", "hyperparameters": {"alpha": 0.1}}, "tuning": {"validation_folds": folds}}
    whole = tuning.score_candidate(df, config, {})
    assert whole["pooled_r2"] > 0.9 and abs(whole["score"] - whole["fold_mean"]) < 0.1 and whole["fold_deviation"] < 0.1
    made = fit_model(df, config)
    small = tuning.with_features(config, top_features(importance(made), 1, ["x", "noise"]))
    assert small["numerical_features"] == ["x"] and config["numerical_features"] == ["x", "noise"]
    assert tuning.score_candidate(df, small, {})["pooled_r2"] > 0.9
    with pytest.raises(ValueError):
        tuning.with_features(config, ["other"])


def test_first_existing_column(spark):
    df = spark.createDataFrame([], "Season int, team string")
    assert first_existing(df, "year", "season", "team") == "Season" and first_existing(df, "x") is None


def test_configuration_and_leaks(tmp_path):
    with pytest.raises(ValueError):
        check_config({**CONFIG, "numerical_features": ["x", "x"]})
    with pytest.raises(ValueError):
        check_config({**CONFIG, "numerical_features": ["overall_pick"]})
    with pytest.raises(ValueError):
        check_config({**CONFIG, "numerical_features": ["nba_minutes"]})
    with pytest.raises(ValueError):
        check_config({k: v for k, v in CONFIG.items() if k != "model"})
    with pytest.raises(ValueError):
        check_config({**CONFIG, "numerical_features": []})
    with pytest.raises(ValueError):
        check_config({**CONFIG, "numerical_features": "x"})
    found = leaking(["weight", "Organization", "has_college_data", "x_season", "some_name", "how_match_method", "combine_wingspan", "nba_anything"])
    assert set(found) == {"Organization", "has_college_data", "x_season", "some_name", "how_match_method", "nba_anything"} and found["x_season"] == "the calendar"
    (tmp_path / "a.json").write_text(json.dumps(CONFIG))
    with pytest.raises(ValueError, match="data_path"):
        load_config(tmp_path / "a.json")
    (tmp_path / "b.json").write_text(json.dumps({**CONFIG, "data_path": "x"}))
    assert load_config(tmp_path / "b.json")["target"] == "drafted"
    with pytest.raises(ValueError):
        tuning.protect_source(tmp_path / "a.json", tmp_path / "." / "a.json")
