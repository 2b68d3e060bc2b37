"""Estimators, calibration and the fit protocol of the two model families."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.scalars import clipped_logit
from quillspan.ml.metrics import regression
from quillspan.ml.prepare import Preparation, learn
from quillspan.ml.splits import SplitBounds, chronological_split
from quillspan.operators.audit import leaking
from quillspan.operators.joins import purge_groups
from quillspan.operators.windows import choose_top
from quillspan.session import cut_lineage

# What a configuration must name.
REQUIRED = ("target", "numerical_features", "categorical_features", "split", "model")


def check_config(config: Mapping) -> dict:
    """The configuration with defaults; missing, repeated or leaking entries are errors."""
    lost = [k for k in REQUIRED if k not in config]
    if lost:
        raise ValueError(f"configuration lacks {lost}")
    lists = (config["numerical_features"], config["categorical_features"])
    if any(isinstance(x, str) or not isinstance(x, Sequence) or not all(isinstance(f, str) for f in x) for x in lists):
        raise ValueError("features must be lists of names")
    features = [*lists[0], *lists[1]]
    if not features:
        raise ValueError("no features")
    if len(set(features)) < len(features):
        raise ValueError("a feature is named twice")
    if config["target"] in features:
        raise ValueError("the target is among the features")
    if leaks := leaking(features):
        raise ValueError(f"features that must not be used: {leaks}")
    SplitBounds(**config["split"])
    return {"numerical_missing_strategy": "median", "probability_calibration": None, "refit_on_train_validation": True, "log_transform_target": True} | dict(config)


def load_config(path: str | Path) -> dict:
    """A checked configuration; a file must also say where its table lies (``data_path``)."""
    config = json.loads(Path(path).read_text())
    if not config.get("data_path"):
        raise ValueError(f"{path} lacks data_path")
    return check_config(config)


def ridge(alpha: float, n: int, target_deviation: float, target: str) -> LinearRegression:
    """Least squares with penalty ``alpha`` on the squared weights, intercept free."""
    return LinearRegression(featuresCol="features", labelCol=target, solver="normal", elasticNetParam=0.0, standardization=False, regParam=alpha * target_deviation / n)


def logistic(c: float, n: int, target: str, max_iter: int = 200) -> LogisticRegression:
    """Logistic regression with inverse penalty ``c`` as summed loss, not mean loss."""
    return LogisticRegression(featuresCol="features", labelCol=target, elasticNetParam=0.0, standardization=False, regParam=1.0 / (c * n), maxIter=max_iter, tol=1e-8)


def estimator(name: str, params: Mapping, target: str, n: int, deviation: float = 1.0):
    """``ridge``, ``logistic_regression``, ``gbt_classifier`` or ``gbt_regressor``."""
    if name == "ridge":
        return ridge(params.get("alpha", 1.0), n, deviation, target)
    if name == "logistic_regression":
        return logistic(params.get("C", 1.0), n, target, params.get("max_iter", 200))
    common = {"featuresCol": "features", "labelCol": target, "maxIter": params.get("n_estimators", 20), "maxDepth": params.get("max_depth", 3), "stepSize": params.get("learning_rate", 0.1), "seed": params.get("random_state", 42), "subsamplingRate": params.get("subsample", 1.0)}
    if name == "gbt_classifier":
        return GBTClassifier(**common)
    if name == "gbt_regressor":
        return GBTRegressor(**common)
    raise ValueError(f"unknown model {name}")


@dataclass
class Fitted:
    """Preparation, model, optional calibrator and decision of a fit."""

    preparation: Preparation
    model: object
    target: str
    calibrator: tuple[float, float] | None = None
    rule: dict | None = None
    log_target: bool = False

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``raw_model_score`` and ``probability`` or ``predicted``."""
        out = self.model.transform(self.preparation.apply(df))
        if "probability" in out.columns:
            out = out.withColumn("raw_model_score", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction", "features")
            return out.withColumn("probability", self.calibrated(F.col("raw_model_score")))
        value = F.expm1("prediction") if self.log_target else F.col("prediction")
        return out.withColumn("predicted", value).drop("prediction", "features")

    def calibrated(self, raw: Column) -> Column:
        if self.calibrator is None:
            return raw
        slope, intercept = self.calibrator
        return 1.0 / (1.0 + F.exp(-(F.lit(slope) * clipped_logit(raw) + F.lit(intercept))))

    def decide(self, scored: DataFrame, year: str, *ties: str) -> DataFrame:
        """``chosen`` by threshold or by the top fraction of each year."""
        rule = self.rule or {"type": "threshold", "threshold": 0.5}
        if rule["type"] == "threshold":
            return scored.withColumn("chosen", (F.col("probability") >= rule["threshold"]).cast("int"))
        return choose_top(scored, [year], rule["fraction"], "probability", ties, "chosen")


def fit_calibrator(scored: DataFrame, target: str, c: float = 1.0) -> tuple[float, float]:
    """Slope and intercept of a logistic regression on the logit of the raw score."""
    classes = scored.agg(F.count("*").alias("n"), F.countDistinct(target).alias("k")).first()
    if classes["k"] < 2:
        raise ValueError("calibration needs both classes")
    data = scored.select(F.col(target).cast("double").alias(target), array_to_vector(F.array(clipped_logit("raw_model_score"))).alias("features"))
    made = logistic(c, classes["n"], target).fit(data)
    return float(made.coefficients[0]), float(made.intercept)


def fit_model(training: DataFrame, config: Mapping) -> Fitted:
    """Preparation and estimator fitted on the given rows."""
    target, name = config["target"], config["model"]["name"]
    trees = name.startswith("gbt")
    # medians, deviations and the optimiser go over the rows again and again
    training = cut_lineage(training.select(*dict.fromkeys([*config["numerical_features"], *config["categorical_features"], target])))
    prep = learn(training, config["numerical_features"], config["categorical_features"], scale=not trees, indicators=config.get("numerical_missing_indicators", trees))
    log_target = bool(config.get("log_transform_target")) and name in ("ridge", "gbt_regressor")
    if log_target and not training.where(F.col(target) <= -1).isEmpty():
        raise ValueError(f"the logarithm of 1 + {target} needs targets above -1")
    rows = training.withColumn(target, F.log1p(target)) if log_target else training
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.stddev_pop(target), F.lit(1.0)).alias("s")).first()
    made = estimator(name, config["model"].get("hyperparameters", {}), target, size["n"], size["s"]).fit(cut_lineage(prep.apply(rows).select(target, "features")))
    return Fitted(prep, made, target, log_target=log_target)


def fit_classifier(df: DataFrame, config: Mapping) -> tuple[Fitted, dict[str, DataFrame]]:
    """Purge, fit on training rows, calibrate on validation rows, choose the rule, refit."""
    config = check_config(config)
    df = cut_lineage(df)  # its parts are read by the fits, the scores and the metrics
    parts = chronological_split(df, SplitBounds(**config["split"]))
    group, target = config.get("group_column"), config["target"]
    purge = lambda a, b: purge_groups(a, b, group) if group else a
    first = fit_model(purge(parts["train"], parts["validation"]), config)
    scored = first.score(parts["validation"])
    calibrator = fit_calibrator(scored, target, config["probability_calibration"].get("C", 1.0)) if config["probability_calibration"] else None
    share = parts["validation"].agg(F.avg(F.col(target).cast("double"))).first()[0]
    rule = config.get("decision_rule_fitted") or {"type": "annual_top_fraction", "fraction": share}
    final = first
    if config["refit_on_train_validation"]:
        final = fit_model(purge(parts["train"].unionByName(parts["validation"]), parts["test"]), config)
    final.calibrator, final.rule = calibrator, rule
    return final, parts


def fit_regressor(df: DataFrame, config: Mapping) -> tuple[Fitted, dict[str, dict[str, float]]]:
    """Fit on training rows, refit with the validation rows if configured; metrics of each part.

    Validation metrics are those of the first fit, test metrics those of the last.
    """
    config = check_config(config)
    df = cut_lineage(df)  # its parts are read by the fits, the scores and the metrics
    parts = chronological_split(df, SplitBounds(**config["split"]))
    group = config.get("group_column")
    purge = lambda a, b: purge_groups(a, b, group) if group else a

    def measured(made: Fitted, rows: DataFrame) -> dict[str, float]:
        scores = regression(F.col(config["target"]), F.col("predicted"))
        return made.score(rows).agg(F.count("*").alias("n"), *[v.alias(k) for k, v in scores.items()]).first().asDict()

    first = fit_model(purge(parts["train"], parts["validation"]), config)
    found = {"train": measured(first, parts["train"]), "validation": measured(first, parts["validation"])}
    final = fit_model(purge(parts["train"].unionByName(parts["validation"]), parts["test"]), config) if config["refit_on_train_validation"] else first
    return final, found | {"test": measured(final, parts["test"])}


def importance(fitted: Fitted) -> list[tuple[str, float]]:
    """(raw feature, importance), largest first; one-hot columns summed to their feature."""
    model = fitted.model
    values = model.featureImportances.toArray() if hasattr(model, "featureImportances") else abs(model.coefficients.toArray())
    totals: dict[str, float] = {}
    for name, value in zip(fitted.preparation.features, values):
        raw = name.split("=")[0].removesuffix("_missing")
        totals[raw] = totals.get(raw, 0.0) + float(value)
    return sorted(totals.items(), key=lambda kv: (-kv[1], kv[0]))


def top_features(ranked: Sequence[tuple[str, float]], n: int, allowed: Sequence[str]) -> list[str]:
    return [name for name, _ in ranked if name in set(allowed)][:n]


def save_artifact(fitted: Fitted, path: str, config: Mapping) -> None:
    """Model folder with a JSON sidecar that names features, calibrator and rule."""
    fitted.model.write().overwrite().save(f"{path}/model")
    prep = fitted.preparation
    side = {"schema_version": 3, "target": fitted.target, "features": prep.features, "medians": prep.medians, "levels": prep.levels, "calibrator": fitted.calibrator, "rule": fitted.rule, "config": dict(config)}
    Path(path, "artifact.json").write_text(json.dumps(side, indent=1, sort_keys=True))
