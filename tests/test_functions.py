"""Scalar functions, audits and artifacts that no query covers."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspan.functions import scalars as S
from quillspan.ml.models import fit_model, save_artifact
from quillspan.operators import aggregates, audit, joins
from quillspan.sources import files


def _one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


@pytest.mark.parametrize(("text", "want"), [(" 12.0 ", "12"), ("nan", None), ("None", None), ("<NA>", None), ("", None), ("  ", None), ("1.00", "1.00"), ("7.0.0", "7.0"), (None, None), ("\t5\n", "5")])
def test_clean_id(spark, text, want):
    assert _one(spark, text, S.clean_id("x")) == want


@pytest.mark.parametrize(("text", "want"), [("José Núñez Jr.", "jose nunez"), ("Straße", "stra e"), ("O'Neal, III", "o neal"), ("Vi Ivan", "vi ivan"), (None, ""), ("é", "e")])
def test_normalize_name(spark, text, want):
    assert _one(spark, text, S.normalize_name("x")) == want


def test_times_and_sheets(spark):
    texts = ["1998-03-05T05:00Z", "1998-03-05 05:00:00", "1998-03-05", "bad", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(S.parse_time("x")).collect()]
    assert got[:3] == [datetime(1998, 3, 5, 5), datetime(1998, 3, 5, 5), datetime(1998, 3, 5)] and got[3:] == [None, None]
    assert _one(spark, "AB12", S.sheet_column_index("x")) == 27 and _one(spark, "A1", S.sheet_column_index("x")) == 0
    assert _one(spark, 2099, S.season_label("x"), "int") == "2099-00"


def test_numbers(spark):
    got = [r[0] for r in spark.createDataFrame([("1e3",), ("inf",), ("NaN",), ("x",), (None,)], "x string").select(S.number("x")).collect()]
    assert got == [1000.0, None, None, None, None]
    assert _one(spark, 0.0, S.safe_divide(F.lit(1), F.col("x")), "double") is None
    assert _one(spark, 0.0, F.round(S.clipped_logit("x"), 3), "double") == -13.816
    assert _one(spark, "ab", S.contains_either_way(F.col("x"), F.lit("xabx"))) and not _one(spark, None, S.contains_either_way(F.col("x"), F.lit("a")))
    bins = [r[0] for r in spark.createDataFrame([(0.0,), (1.0,), (5.0,), (5.1,), (None,)], "x double").select(S.right_closed_bins("x", [0, 1, 5], ["a", "b"])).collect()]
    assert bins == [None, "a", "b", None, None]


def test_model_table_checks(spark):
    good = spark.createDataFrame([("a", 2010, 1, 1.0), ("b", 2010, 0, None)], "p string, y int, t int, x double")
    audit.validate_model_table(good, ["p", "y"], "t", ["x"])
    for bad, key, features in ((good.union(good), ["p", "y"], ["x"]), (good.withColumn("t", F.lit(2)), ["p", "y"], ["x"]), (good.withColumn("p", F.lit(None).cast("string")), ["p"], ["x"]), (good.withColumn("nba_x", F.lit(1.0)), ["p", "y"], ["nba_x"])):
        with pytest.raises(ValueError):
            audit.validate_model_table(bad, key, "t", features)


def test_columns_and_samples(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "b")], "k long, e string, f string")
    assert audit.drop_empty_columns(df).columns == ["k", "f"]
    big = spark.range(4000).select(F.col("id").alias("k"), F.when(F.col("id") < 3000, "x").otherwise("y").alias("f"))
    a = files.sample_per_file(big, "f", "k", 0.1)
    b = files.sample_per_file(big.repartition(5), "f", "k", 0.1)
    assert a.exceptAll(b).count() == 0 and 200 < a.where("f = 'x'").count() < 400 and 60 < a.where("f = 'y'").count() < 140
    assert aggregates.union_all([df.select("k"), df.select("f")]).where("k is null").count() == 2
    assert audit.same_rows(df, df.limit(1)).first()["equal"] == 0


def test_mirror_parity(spark):
    table = spark.createDataFrame([(1, "x")], "A long, B string")
    mirror = spark.createDataFrame([("S", ["A", "B"], ["1", "x"])], "name string, headers array<string>, values array<string>")
    assert audit.mirror_parity(table, mirror).first()["verdict"] == "PASS"
    assert audit.mirror_parity(table.drop("B"), mirror).first()["verdict"] == "FAIL"


def test_bands_and_memberships_with_nulls(spark):
    anchors = spark.createDataFrame([("a", 2010), (None, 2010), ("b", None)], "e string, y int")
    rows = spark.createDataFrame([("a", 2004, 1), ("a", 2003, 2), ("a", 2010, 3), ("a", 2011, 4), (None, 2010, 5), ("b", 2010, 6), ("a", None, 7)], "e string, s int, v int")
    assert sorted(r["v"] for r in joins.band_join(anchors, rows, ["e"], "y", "s", -6, 0).collect()) == [1, 3]
    assert joins.band_join(anchors, rows.limit(0), ["e"], "y", "s", -6, 0, "left").count() == 3
    both = joins.key_membership({"l": anchors, "r": rows}, ["e"]).collect()
    assert {(r["e"], r["l"], r["r"], r["sources_present"]) for r in both} == {("a", 1, 1, 2), ("b", 1, 1, 2)}


def test_artifact(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 7), "ab"[i % 2], float(i % 2)) for i in range(60)], "x double, c string, y double")
    config = {"target": "y", "numerical_features": ["x"], "categorical_features": ["c"], "model": {"name": "logistic_regression"}}
    save_artifact(fit_model(df, config), str(tmp_path / "m"), config)
    side = json.loads((tmp_path / "m" / "artifact.json").read_text())
    assert side["schema_version"] == 3 and side["features"] == ["x", "c=a", "c=b"] and (tmp_path / "m" / "model").exists()
