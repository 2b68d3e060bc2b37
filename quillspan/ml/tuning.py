"""Search over parameter grids with expanding folds."""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Mapping, Sequence
from copy import deepcopy
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.ml.metrics import macro_normalized_ap, ranking, regression
from quillspan.ml.models import fit_model
from quillspan.ml.splits import expanding_folds, fold_parts


def grid(space: Mapping[str, Sequence]) -> list[dict]:
    """All combinations; keys in sorted order, the last varies fastest."""
    if not space or any(len(v) == 0 for v in space.values()):
        raise ValueError("the search space is empty")
    keys = sorted(space)
    return [dict(zip(keys, values)) for values in itertools.product(*[space[k] for k in keys])]


def candidates(space: Mapping[str, Sequence], n_iter: int | None = None, seed: int = 42, fixed: Sequence[Mapping] = ()) -> list[dict]:
    """Fixed candidates first, then the grid or a seeded sample of it, without repeats."""
    every = grid(space)
    if n_iter is not None:
        if n_iter < 1:
            raise ValueError("n_iter must be positive")
        every = random.Random(seed).sample(every, min(n_iter, len(every)))
    seen, out = set(), []
    for c in [*map(dict, fixed), *every]:
        key = json.dumps(c, sort_keys=True)
        if key not in seen:
            seen.add(key)
            out.append(c)
    return out


def with_parameters(config: Mapping, parameters: Mapping) -> dict:
    """A copy of the configuration with other hyperparameters."""
    made = deepcopy(dict(config))
    made["model"]["hyperparameters"] = made["model"].get("hyperparameters", {}) | dict(parameters)
    return made


def with_features(config: Mapping, names: Sequence[str]) -> dict:
    """A copy of the configuration with only those of its features that are named; none left is an error."""
    made, keep = deepcopy(dict(config)), set(names)
    for kind in ("numerical_features", "categorical_features"):
        made[kind] = [f for f in made[kind] if f in keep]
    if not made["numerical_features"] and not made["categorical_features"]:
        raise ValueError("none of the named features is in the configuration")
    return made


def protect_source(source: str | Path, target: str | Path) -> None:
    """Refuse to write over the configuration that is being tuned."""
    if Path(source).resolve() == Path(target).resolve():
        raise ValueError(f"{target} is the source configuration")


# Other names of the metrics in configurations.
METRIC_NAMES = {"macro_normalized_average_precision": "macro_normalized_ap", "pooled_rmse": "rmse"}


def selection_metric(config: Mapping) -> str:
    """The metric that candidates are ranked by; ``rmse`` for regressions where none is named."""
    named = config["tuning"].get("selection_metric") or config["tuning"].get("metric")
    classifier = config["model"]["name"] in ("logistic_regression", "gbt_classifier")
    named = METRIC_NAMES.get(named, named) or ("macro_normalized_ap" if classifier else "rmse")
    if named not in ("rmse", "macro_normalized_ap", "average_precision", "roc_auc") or classifier == (named == "rmse"):
        raise ValueError(f"metric {named} does not suit {config['model']['name']}")
    return named


def score_candidate(df: DataFrame, config: Mapping, parameters: Mapping) -> dict:
    """Pooled out-of-fold score and the mean and spread over folds."""
    made = with_parameters(config, parameters)
    column, metric = config["split"]["column"], selection_metric(config)
    folds = expanding_folds(config["tuning"]["validation_folds"], column, config["split"]["test_start"])
    scored = []
    for i, fold in enumerate(folds):
        training, validation = fold_parts(df, column, fold, config.get("group_column"))
        scored.append(fit_model(training, made).score(validation).withColumn("fold", F.lit(i)))
    pooled = reduce(DataFrame.unionByName, scored)
    y, more = F.col(config["target"]), {}
    if metric == "rmse":
        measures = regression(y, F.col("predicted"))
        each = [r[0] for r in pooled.groupBy("fold").agg(measures["rmse"].alias("m")).select("m").collect()]
        value, r2 = pooled.agg(measures["rmse"], measures["r2"]).first()
        more = {"pooled_r2": r2}
    elif metric == "macro_normalized_ap":
        value = macro_normalized_ap(pooled, config["target"], "probability", column).first()["macro_normalized_ap"]
        each = [value]
    else:
        value = ranking(pooled, config["target"], "probability").first()[metric]
        each = [r[metric] for r in ranking(pooled, config["target"], "probability", ["fold"]).collect()]
    if value is None or None in each:
        raise ValueError(f"{metric} is undefined: validation rows of one class only")
    mean = sum(each) / len(each)
    return more | {"parameters": dict(parameters), "score": value, "fold_mean": mean, "fold_deviation": (sum((x - mean) ** 2 for x in each) / len(each)) ** 0.5}


def tune(df: DataFrame, config: Mapping) -> list[dict]:
    """All candidates, best first; of equal scores the earlier stays ahead."""
    t = config["tuning"]
    tried = [score_candidate(df, config, p) for p in candidates(t["search_space"], t.get("n_iter"), t.get("random_state", 42), t.get("fixed_candidates", ()))]
    return sorted(tried, key=lambda r: r["score"] if selection_metric(config) == "rmse" else -r["score"])
