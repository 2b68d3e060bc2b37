"""Sources, sinks, streaming, collection and pipelines on temporary files and frames."""

import gzip
import json
import zipfile
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspan.operators import joins
from quillspan.plans import pipelines
from quillspan.sources import files, paths, sinks
from quillspan.sources.collect import Step, collect_all, collect_endpoint
from quillspan.sources.tables import share_package
from quillspan.streaming import arrivals


def _yearly(spark, tmp_path):
    one = lambda rows, schema, name: spark.createDataFrame(rows, schema).toPandas().to_parquet(tmp_path / name)
    one([(1, "a")], "k long, v string", "stats_2019.parquet")
    one([(2, "b"), (2, "b")], "k long, v string", "stats_2020.parquet")
    one([(3, 7.0)], "k long, w double", "stats_2021.parquet")
    one([(9, "all")], "k long, v string", "stats_all.parquet")
    return files.Dataset(str(tmp_path), "stats")


def test_yearly_files(spark, tmp_path):
    data = _yearly(spark, tmp_path)
    assert [Path(p).name for p in data.yearly(2020)] == ["stats_2020.parquet", "stats_2021.parquet"]
    rows = files.read_yearly(spark, data).orderBy("k").collect()
    assert [(r["k"], r["v"], r["w"], r["source_year"]) for r in rows] == [(1, "a", None, 2019), (2, "b", None, 2020), (2, "b", None, 2020), (3, None, 7.0, 2021)]
    assert files.read_rollup_or_yearly(spark, data).collect()[0]["k"] == 9
    assert files.read_yearly(spark, files.Dataset(str(tmp_path), "none")).count() == 0
    rows = files.read_tolerant(spark, data.yearly(), {"K": "bigint", "absent": "double"}).collect()
    assert len(rows) == 4 and all(r["absent"] is None and r["_source_period"] for r in rows)
    missing = {(r["source_file"], r["feature"]): r["n_missing"] for r in files.missing_by_file(spark, data.yearly()).collect()}
    assert missing[("stats_2021.parquet", "v")] == 1 and missing[("stats_2019.parquet", "w")] == 1
    assert files.parquet_footer(data.yearly()[1])["rows"] == 2
    assert files.schema_variants(data.yearly())["k"] == {"int64"}
    assert files.inventory(spark, str(tmp_path)).where("format = 'parquet' and period = '2020'").count() == 1
    sinks.write_rollup(spark, files.Dataset(str(tmp_path), "stats_20"), str(tmp_path / "out"), distinct=True)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    (tmp_path / "broken_2022.parquet").write_text("no parquet")
    found = files.readable(spark, [data.yearly()[0], str(tmp_path / "broken_2022.parquet")])
    assert found[0][1] == 1 and found[1][1] is None and found[1][2]


def test_csv_json_and_audits(spark, tmp_path):
    (tmp_path / "t_2001.csv").write_text("a,b\n1,x\n,y\n")
    assert files.read_files(spark, [str(tmp_path / "t_2001.csv")]).where("a is null").count() == 1
    with pytest.raises(ValueError):
        files.read_files(spark, [str(tmp_path / "t.xyz")])
    body = {"resultSets": [{"name": "S", "headers": ["A", "B"], "rowSet": [[1, "x"], [2, None]]}]}
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        json.dump(body, f)
    rows = files.read_result_sets(spark, str(tmp_path / "r.json.gz")).collect()
    assert [r["values"] for r in rows] == [["1", "x"], ["2", None]]
    (tmp_path / "one.json").write_text(json.dumps({"resultSet": {"name": "T", "headers": ["A"], "rowSet": [[5]]}}))
    assert files.read_result_sets(spark, str(tmp_path / "one.json")).first()["values"] == ["5"]
    sinks.write_audit(spark.createDataFrame([], "a int, b string"), str(tmp_path / "audit"))
    assert next((tmp_path / "audit").glob("*.csv")).read_text().strip() == "a,b"
    with pytest.raises(ValueError):
        sinks.write_table(spark.createDataFrame([], "a int"), str(tmp_path / "no"), allow_empty=False)
    sinks.write_json_mirror(spark.range(3), str(tmp_path / "mirror"))
    assert spark.read.json(str(tmp_path / "mirror")).count() == 3


def test_catalog_and_reports(spark, tmp_path):
    catalog = files.Catalog({"stats": _yearly(spark, tmp_path), "none": files.Dataset(str(tmp_path / "absent"), "x")})
    assert catalog.load(spark, "stats").first()["k"] == 9 and catalog.load(spark, "stats", 2020, 2020).count() == 2
    assert {tuple(r) for r in catalog.coverage(spark).collect()} == {("stats", 3, 2019, 2021, True), ("none", 0, None, None, False)}
    with pytest.raises(KeyError):
        catalog.load(spark, "other")
    scored = spark.createDataFrame([(1, 0.25, [1.0])], "event int, probability double, features array<double>")
    sinks.write_training(spark, str(tmp_path / "run"), {"roc_auc": 0.5}, scored, [("x", 0.75), ("y", 0.25)], {"model": {"name": "ridge"}})
    assert json.loads((tmp_path / "run/metrics.json").read_text()) == {"roc_auc": 0.5} and json.loads(paths.read_text(spark, str(tmp_path / "run/best_config.json")))["model"]["name"] == "ridge"
    back = spark.read.option("header", True).csv(str(tmp_path / "run/predictions"))
    assert back.columns == ["event", "probability"] and spark.read.option("header", True).csv(str(tmp_path / "run/importance")).count() == 2
    sinks.write_audit(spark.range(10).repartition(3), str(tmp_path / "parts"))
    assert spark.read.option("header", True).csv(str(tmp_path / "parts")).count() == 10


def test_workbook(spark, tmp_path):
    share_package(spark)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="First" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>sp</t></r><r><t>lit</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>1</v></c></row><row r="3"><c r="B3"><v>4.5</v></c><c r="C3" t="inlineStr"><is><t>in</t></is></c><c r="D3"/></row></sheetData></worksheet>')
    rows = {tuple(r)[1:] for r in files.read_workbooks(spark, str(tmp_path / "b.xlsx")).collect()}
    assert rows == {("First", 1, 0, "name"), ("First", 1, 27, "split"), ("First", 3, 1, "4.5"), ("First", 3, 2, "in")}


def test_resumable_collection(spark, tmp_path):
    path = str(tmp_path / "out.parquet")
    calls = []

    def load():
        calls.append(1)
        if len(calls) == 1:
            raise OSError("down")
        return spark.range(2)

    assert sinks.collect_once(path, load) == "failed" and Path(f"{path}.failed.txt").exists()
    assert sinks.collect_once(path, load) == "written" and not Path(f"{path}.failed.txt").exists()
    assert sinks.collect_once(path, load) == "kept" and sinks.collect_once(path, load, force=True) == "written"
    waits = []
    with pytest.raises(ValueError):
        sinks.with_retry(lambda: int("x"), attempts=4, sleep=waits.append)
    assert waits == [2.0, 4.0, 8.0]


def test_api_source(spark, tmp_path):
    share_package(spark)
    assert collect_endpoint(spark, "draft", 2001, 2003, "api_stand_in:fetch", str(tmp_path / "draft"), wait=0.0) == "written"
    rows = spark.read.parquet(str(tmp_path / "draft")).orderBy("year").collect()
    assert [(r["year"], r["values"]) for r in rows] == [(y, ["draft", str(y)]) for y in (2001, 2002, 2003)]


def test_whole_collection(spark, tmp_path):
    share_package(spark)
    steps = (Step("draft"), Step("nothing"), Step("crosswalk", beyond=2))
    found = collect_all(spark, 2001, 2002, "api_stand_in:sometimes", str(tmp_path), steps, wait=0.0).collect()
    assert [(r["endpoint"], r["last"], r["status"]) for r in found] == [("draft", 2002, "written"), ("nothing", 2002, "failed"), ("crosswalk", 2004, "skipped")]
    found = collect_all(spark, 2001, 2002, "api_stand_in:sometimes", str(tmp_path), steps, wait=0.0, keep_going=True).collect()
    assert [r["status"] for r in found] == ["kept", "failed", "written"] and spark.read.parquet(str(tmp_path / "crosswalk.parquet")).count() == 4


def test_arrivals(spark, tmp_path):
    events = [(i, datetime(2024, 1, 1, i % 3, i % 60), "a" if i % 2 else "b", 1.0) for i in range(60)]
    df = spark.createDataFrame([*events, events[0], (99, datetime(2024, 1, 3), "a", 1.0)], "id long, ts timestamp_ntz, kind string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = arrivals.arriving(spark, str(tmp_path / "in"), df.schema)
    arrivals.run_available(arrivals.deduplicated(stream, "id", "ts"), str(tmp_path / "dedup"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "dedup")).count() == 61
    arrivals.run_available(arrivals.windowed_counts(stream, "ts", "kind", "value"), str(tmp_path / "win"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "win")).agg(F.sum("n")).first()[0] == 61
    spark.createDataFrame([(100, datetime(2024, 1, 3), "a", 1.0)], df.schema).write.mode("append").parquet(str(tmp_path / "in"))
    arrivals.run_available(arrivals.deduplicated(arrivals.arriving(spark, str(tmp_path / "in"), df.schema), "id", "ts"), str(tmp_path / "dedup"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "dedup")).count() == 62


def test_validated_join(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), spark.createDataFrame([(1, 5)], "k int, w int")
    assert joins.validated_join(a, b, ["k"], "many_to_one").count() == 2
    with pytest.raises(Exception, match="not unique"):
        joins.validated_join(a, b, ["k"], "one_to_one").collect()


def test_measurement_sources(spark):
    raw = spark.createDataFrame([("1.0", 2010, "PG", "80", "x", "1", 5.0), ("1", 2010, "SG", "82", None, "3", None), ("2", 2010, "pg", "bad", None, None, 6.0), ("nan", 2010, "C", "1", None, None, 1.0)], "PLAYER_ID string, YEAR int, POSITION string, `HEIGHT W` string, NOTE string, `height_w` string, NAN_NAME double")
    made = pipelines.measurement_source(raw, "PLAYER_ID", "YEAR", "POSITION")
    rows = {r["player"]: (r["combine_height_w"], r["position"]) for r in made.table.collect()}
    assert rows == {"1": (81.0, "PG"), "2": (None, "PG")}
    assert made.collisions == [("height_w", "HEIGHT W", "height_w")] and {d[0] for d in made.dropped} == {"NAN_NAME", "combine_note"}
    other = spark.createDataFrame([("1", 2010, "SF", 3.0), ("3", 2011, "C", 4.0)], "player string, year int, position string, drill double")
    chosen = spark.createDataFrame([("1", 2010)], "player string, year int")
    table, membership, conflicts = pipelines.cohort({"anthro": made.table, "drills": other}, chosen)
    assert [(r["player"], r["position"], r["drafted"]) for r in table.collect()] == [("1", "PG", 1)]
    assert {r["player"] for r in membership.collect()} == {"2", "3"} and conflicts.count() == 1


def test_outcomes_and_history(spark):
    roster = spark.createDataFrame([("1", 2010), ("2", 2010)], "player string, year int")
    seasons = spark.createDataFrame([("1", 2009, 1, 9.0, 9.0, 0.1), ("1", 2010, 2, 10.0, 20.0, 0.5), ("1", 2012, 1, 30.0, 10.0, 0.9), ("1", 2013, 5, 99.0, 99.0, 0.2)], "player string, season int, gp int, minutes double, points double, ts double")
    rows = {r["player"]: r for r in pipelines.outcomes(roster, seasons, ["points"]).collect()}
    assert (rows["1"]["nba_gp_3y"], rows["1"]["nba_points_3y"], rows["1"]["nba_points_per_36_3y"], rows["1"]["nba_reached_3y"]) == (3, 30.0, 27.0, 1)
    assert (rows["2"]["nba_gp_3y"], rows["2"]["nba_points_per_36_3y"], rows["2"]["nba_reached_3y"]) == (0, None, 0)
    assert pipelines.weighted_outcomes(roster, seasons, ["ts"]).first()["nba_ts_3y_weighted"] == pytest.approx((0.5 * 10 + 0.9 * 30) / 40)
    stats = spark.createDataFrame([(2010, "t", "FGA", "50"), (2010, "t", "FGA", "70"), (2010, "u", "PTS", "x"), (2010, "t", "PTS", "60"), (2010, "t", "junk", "1")], "season int, team string, stat_name string, value string")
    names = {"FGA": "field_goals_attempted", "PTS": "points", "OREB": "offensive_rebounds", "TO": "turnovers", "FTA": "free_throws_attempted", "FGM": "field_goals_made", "TPM": "three_point_field_goals_made", "AST": "assists"}
    assert set(pipelines.team_features(stats, names).columns) >= {"college_team_rating", "college_team_rating_pct"}


def test_history_features(spark):
    base = {c: 10.0 for c in ("minutes", "points")}
    rows = [("a", 2008, "t", "Guard", 100.0, 50.0), ("a", 2010, "t", "Guard", 200.0, 150.0), ("a", 2001, "t", "C", 1.0, 1.0), ("a", 2011, "t", "C", 1.0, 1.0)]
    from quillspan.operators.aggregates import TOTALS

    box = spark.createDataFrame(rows, "athlete string, season int, team string, position string, minutes double, points double")
    box = box.select("*", *[F.lit(1.0).alias(c) for c in TOTALS if c not in base])
    born = spark.createDataFrame([("a", 2009, None), ("a", 2008, datetime(1989, 7, 1, 5))], "athlete string, season int, date_of_birth timestamp_ntz")
    out, rejected = pipelines.history_features(spark.createDataFrame([("a", 2010), ("b", 2010)], "athlete string, anchor int"), pipelines.college_seasons(box), born)
    got = {r["athlete"]: r for r in out.collect()}
    assert got["a"]["college_last_points_per_40"] == 30.0 and got["a"]["college_development_points_per_40"] == 10.0 and got["a"]["college_span"] == 3 and got["a"]["college_seasons"] == 2
    assert got["a"]["college_career_points_per_40"] == pytest.approx(40 * 200 / 300) and got["a"]["college_position"] == "G" and got["b"]["has_college_data"] == 0
    assert got["a"]["college_age_on_july_1"] == pytest.approx(7669 / 365.2425) and rejected.count() == 0


def test_names_and_crosswalk(spark):
    df = spark.createDataFrame([("1", "2010", "Al Bo (UNC)"), ("1", "2010", "Al Bo"), ("2", "2010", "Cy"), ("2", "2010", "Di"), (None, "2010", "X")], "p string, y string, n string")
    names, several = pipelines.event_names(df, "p", "y", "n")
    assert {r["player"]: r["name"] for r in names.collect()}["1"] == "albo" and [r["player"] for r in several.collect()] == ["2"]
    walk = spark.createDataFrame([("1", "9"), ("1", "9"), ("1", "8"), ("2", "7"), ("2", "6"), ("3", "nan")], "nba_player_id string, espn_athlete_id string")
    assert {tuple(r) for r in pipelines.crosswalk_or_empty(walk).collect()} == {("1", "9"), ("2", "6")}
    assert pipelines.crosswalk_or_empty(spark.range(2)).count() == 0
