"""Queries over splits, preparation, decisions, metrics and models.

The score is a function of the data with ties: the combine weight in steps of five.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.ml import metrics
from quillspan.ml.models import fit_calibrator, fit_classifier, fit_model, importance
from quillspan.ml.prepare import learn, prepare_table
from quillspan.ml.splits import SplitBounds, named_split
from quillspan.ml.tuning import candidates
from quillspan.operators.windows import choose_top, ordered_rank
from quillspan.plans.base import Book
from quillspan.sources.tables import table

book = Book()
BOUNDS = SplitBounds("draft_year", 2010, 2011, 2013, 2014, 2018)
NUMERIC = ["combine_height_wo_shoes", "combine_weight", "combine_wingspan", "college_age_on_july_1"]
_SCORED = "x as (select event_id, draft_year, cast(drafted as int) as y, least(0.95, greatest(0.05, floor(combine_weight / 5) / 50 - 3.6)) as p from draft_classification where combine_weight is not null and drafted is not null)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "draft_classification", "event_id", "draft_year", "drafted", "combine_weight").dropna(subset=["combine_weight", "drafted"])
    p = F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.floor(F.col("combine_weight") / 5).cast("double") / 50 - 3.6))
    return e.select("event_id", "draft_year", F.col("drafted").cast("int").alias("y"), p.alias("p"))


@book.query("select case when draft_year <= 2010 then 'train' when draft_year between 2011 and 2013 then 'validation' when draft_year between 2014 and 2018 then 'test' end as part, count(*) as n, cast(sum(cast(drafted as int)) as bigint) as positives from draft_classification group by 1")
def chrono_split_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "draft_classification", "draft_year", "drafted")
    return e.groupBy(named_split(BOUNDS).alias("part")).agg(F.count("*").alias("n"), F.sum(F.col("drafted").cast("int")).alias("positives"))


@book.query("\nunion all ".join(f"select {i} as fold, count(*) filter (where draft_year <= {e}) as n_train, count(*) filter (where draft_year between {a} and {b}) as n_validation from draft_classification" for i, (e, a, b) in enumerate([(2006, 2007, 2008), (2008, 2009, 2010), (2010, 2011, 2013)])))
def expanding_folds(spark: SparkSession, d: str) -> DataFrame:
    from quillspan.ml.splits import expanding_folds as folds

    e, y = table(spark, d, "draft_classification", "draft_year"), F.col("draft_year")
    made = folds([{"train_end": 2006, "validation_start": 2007, "validation_end": 2008}, {"train_end": 2008, "validation_start": 2009, "validation_end": 2010}, {"train_end": 2010, "validation_start": 2011, "validation_end": 2013}], "draft_year", 2014)
    row = e.agg(*[F.count_if(y <= end).alias(f"t{i}") for i, (end, _, _) in enumerate(made)], *[F.count_if(y.between(a, b)).alias(f"v{i}") for i, (_, a, b) in enumerate(made)])
    each = F.array(*[F.struct(F.lit(i).alias("fold"), F.col(f"t{i}").alias("n_train"), F.col(f"v{i}").alias("n_validation")) for i in range(len(made))])
    return row.select(F.explode(each).alias("x")).select("x.*")


_FIT = "draft_year <= 2010"


@book.query("with f as (select " + ", ".join(f"median({c}) as m{i}, avg(coalesce({c}, (select median({c}) from draft_classification where {_FIT}))) as a{i}, stddev_pop(coalesce({c}, (select median({c}) from draft_classification where {_FIT}))) as s{i}" for i, c in enumerate(NUMERIC[:3])) + f" from draft_classification where {_FIT}) select event_id, " + ", ".join(f"round((coalesce({c}, m{i}) - a{i}) / s{i}, 4) as z_{c}" for i, c in enumerate(NUMERIC[:3])) + ", cast(combine_weight is null as double) as combine_weight_missing, cast(coalesce(position, 'missing') = 'PG' as double) as is_pg from draft_classification, f")
def impute_scale_onehot(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    e = table(spark, d, "draft_classification", "event_id", "draft_year", "position", *NUMERIC[:3])
    made = learn(e.where(_FIT), NUMERIC[:3], ["position"])
    out = made.apply(e).withColumn("v", vector_to_array("features"))
    at = {n: i for i, n in enumerate(made.features)}
    return out.select("event_id", *[F.round(F.col("v")[at[c]], 4).alias(f"z_{c}") for c in NUMERIC[:3]], F.col("v")[at["combine_weight_missing"]].alias("combine_weight_missing"), F.col("v")[at["position=PG"]].alias("is_pg"))


_STEPS = "c as (select draft_year, p, sum(y) as pos, count(*) as n from x group by all), r as (select *, sum(pos) over w as tp, sum(n) over w as seen, sum(pos) over (partition by draft_year) as ap, sum(n) over (partition by draft_year) as an from c window w as (partition by draft_year order by p desc))"


@book.query(f"with {_SCORED}, {_STEPS} select draft_year, p as score, round(tp / seen, 6) as precision, round(tp / nullif(ap, 0), 6) as recall from r")
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return metrics.precision_recall(_scored(spark, d), "y", "p", ["draft_year"])


@book.query(f"""with {_SCORED}, {_STEPS},
l as (select draft_year, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) as log_loss, avg((p - y) * (p - y)) as brier from x group by 1)
select draft_year, cast(sum(n) as bigint) as n, round(case when max(ap) > 0 then sum(pos * tp / seen) / max(ap) end, 6) as average_precision,
 round(case when max(ap) > 0 and max(an) > max(ap) then sum(pos * ((an - ap) - (seen - tp) + (n - pos) / 2)) / (max(ap) * (max(an) - max(ap))) end, 6) as roc_auc, round(max(log_loss), 6) as log_loss, round(max(brier), 6) as brier from r join l using (draft_year) group by draft_year""")
def ap_auc_logloss_brier(spark: SparkSession, d: str) -> DataFrame:
    x = _scored(spark, d)
    losses = x.groupBy("draft_year").agg(*[F.round(v, 6).alias(k) for k, v in metrics.probability_losses(F.col("y"), F.col("p")).items()])
    ranked = metrics.ranking(x, "y", "p", ["draft_year"])
    return ranked.select("draft_year", "n", F.round("average_precision", 6).alias("average_precision"), F.round("roc_auc", 6).alias("roc_auc")).join(losses, "draft_year")


@book.query(f"""with {_SCORED}, {_STEPS}, g as (select draft_year, sum(pos * tp / seen) / max(ap) as a, max(ap) / max(an) as s from r group by 1 having max(ap) > 0 and max(ap) < max(an))
select round(avg((a - s) / (1 - s)), 6) as macro_normalized_ap, count(*) as n_years from g""")
def macro_norm_ap(spark: SparkSession, d: str) -> DataFrame:
    return metrics.macro_normalized_ap(_scored(spark, d), "y", "p", "draft_year").withColumn("macro_normalized_ap", F.round("macro_normalized_ap", 6))


@book.query(f"""with {_SCORED}, c as (select y = 1 as y, p >= 0.5 as c from x),
k as (select count(*) filter (where y and c) as tp, count(*) filter (where not y and c) as fp, count(*) filter (where y and not c) as fn, count(*) filter (where not y and not c) as tn from c)
select tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) as balanced_accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision,
 round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from k""")
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    found = metrics.confusion(F.col("y"), (F.col("p") >= 0.5).cast("int"))
    return _scored(spark, d).agg(*[(v if k in ("tp", "fp", "fn", "tn") else F.round(v, 6)).alias(k) for k, v in found.items()])


@book.query(f"with {_SCORED} select event_id, draft_year, cast(p >= 0.5 as int) as chosen, case when row_number() over (partition by draft_year order by p desc, event_id) <= floor(0.6 * count(*) over (partition by draft_year) + 0.5) then 1 else 0 end as chosen_of_year, row_number() over (partition by draft_year order by p desc, event_id) as rank_within_year from x")
def prediction_table(spark: SparkSession, d: str) -> DataFrame:
    x = choose_top(_scored(spark, d), ["draft_year"], 0.6, "p", ["event_id"], "chosen_of_year")
    x = ordered_rank(x, ["draft_year"], "p", ["event_id"], "rank_within_year")
    return x.select("event_id", "draft_year", (F.col("p") >= 0.5).cast("int").alias("chosen"), "chosen_of_year", F.col("rank_within_year").cast("bigint").alias("rank_within_year"))


_REG = "z as (select core_row_id, season, weight as y, 5.0 * height - 190.0 as p from player_core where weight is not null and height between 60 and 96)"


def _regressed(spark: SparkSession, d: str) -> DataFrame:
    core = table(spark, d, "player_core", "core_row_id", "season", "height", "weight").where(F.col("weight").isNotNull() & F.col("height").between(60, 96))
    return core.select("core_row_id", "season", F.col("weight").alias("y"), (5.0 * F.col("height") - 190.0).alias("p"))


@book.query(f"with {_REG} select season, round(avg((y - p) * (y - p)), 4) as mse, round(sqrt(avg((y - p) * (y - p))), 6) as rmse, round(1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(y), 0), 6) as r2 from z group by season")
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    found = metrics.regression(F.col("y"), F.col("p"))
    return _regressed(spark, d).groupBy("season").agg(F.round(found["mse"], 4).alias("mse"), F.round(found["rmse"], 6).alias("rmse"), F.round(found["r2"], 6).alias("r2"))


@book.query(f"with {_REG} select core_row_id, round(y - p, 6) as residual from z order by abs(y - p) desc, core_row_id limit 20")
def residual_topk(spark: SparkSession, d: str) -> DataFrame:
    r = _regressed(spark, d).select("core_row_id", F.round(F.col("y") - F.col("p"), 6).alias("residual"))
    return r.orderBy(F.abs("residual").desc(), "core_row_id").limit(20)


@book.query("""with r as (select height as x, weight as y from player_core where weight is not null and height between 60 and 96), m as (select avg(x) as mx, avg(y) as my, var_pop(x) * count(*) as sxx, covar_pop(x, y) * count(*) as sxy from r)
select round(sxy / (sxx + 1.0), 4) as slope, round(my - sxy / (sxx + 1.0) * mx, 2) as intercept from m""")
def ridge_fit(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    from quillspan.ml.models import ridge

    rows = table(spark, d, "player_core", "height", "weight").where(F.col("weight").isNotNull() & F.col("height").between(60, 96))
    size = rows.agg(F.count("*").alias("n"), F.stddev_pop("weight").alias("s")).first()
    made = ridge(1.0, size["n"], size["s"], "weight").fit(VectorAssembler(inputCols=["height"], outputCol="features").transform(rows))
    return spark.range(1).select(F.lit(round(float(made.coefficients[0]), 4)).alias("slope"), F.lit(round(float(made.intercept), 2)).alias("intercept"))


@book.query("select event_id, cast(drafted as double) as drafted, combine_weight, case when isfinite(try_cast(college_age_on_july_1 as double)) then college_age_on_july_1 end as college_age_on_july_1, position from draft_classification where drafted is not null")
def prepared_table(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "draft_classification", "event_id", "drafted", "combine_weight", "college_age_on_july_1", "position")
    return prepare_table(e, "drafted", ["combine_weight", "college_age_on_july_1"], ["position"], ["event_id"])


@book.query("select cast(row_number() over (order by a, b) - 1 as int) as place, a as depth, cast(b as double) as rate from (values (1), (2), (3)) x(a), (values (0.05), (0.1)) y(b)")
def param_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = [(i, c["depth"], c["rate"]) for i, c in enumerate(candidates({"rate": [0.05, 0.1], "depth": [1, 2, 3]}))]
    return spark.createDataFrame(rows, "place int, depth int, rate double")


def _config(model: str, params: dict) -> dict:
    return {
        "target": "drafted", "numerical_features": NUMERIC, "categorical_features": ["position"], "id_columns": ["event_id"], "group_column": "nba_player_id",
        "split": {"column": "draft_year", "train_end": 2010, "validation_start": 2011, "validation_end": 2013, "test_start": 2014, "test_end": 2018},
        "model": {"name": model, "hyperparameters": params}, "probability_calibration": {"method": "sigmoid", "C": 1.0},
    }


def _model_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "draft_classification", "event_id", "nba_player_id", "draft_year", "drafted", "position", *NUMERIC)
    return prepare_table(e, "drafted", NUMERIC, ["position"], ["event_id", "nba_player_id", "draft_year"])


@book.query()
def logit_fit(spark: SparkSession, d: str) -> DataFrame:
    """Calibrated logistic classifier: scores and decisions on the test years."""
    made, parts = fit_classifier(_model_rows(spark, d), _config("logistic_regression", {"C": 1.0}))
    return made.decide(made.score(parts["test"]), "draft_year", "event_id").select("event_id", "draft_year", "raw_model_score", "probability", "chosen")


@book.query()
def gbt_fit(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees with missing indicators: scores on the test years."""
    made, parts = fit_classifier(_model_rows(spark, d), _config("gbt_classifier", {"n_estimators": 5, "max_depth": 2}))
    return made.score(parts["test"]).select("event_id", "draft_year", "raw_model_score", "probability")


@book.query()
def model_importance(spark: SparkSession, d: str) -> DataFrame:
    """Importance per raw feature of boosted trees."""
    made = fit_model(_model_rows(spark, d).where("draft_year <= 2010"), _config("gbt_classifier", {"n_estimators": 5, "max_depth": 2}))
    return spark.createDataFrame(importance(made), "feature string, importance double")


@book.query()
def platt_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Slope and intercept of the calibrator on the tied score."""
    slope, intercept = fit_calibrator(_scored(spark, d).withColumnRenamed("p", "raw_model_score"), "y")
    return spark.range(1).select(F.lit(slope).alias("slope"), F.lit(intercept).alias("intercept"))


QUERIES, SQL = book.queries, book.sql
