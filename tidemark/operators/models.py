"""Walk-forward ridge and logistic models on purged folds.

Medians, means and deviations come from the train rows of a fold only. They and
the coefficients are a few numbers per fold and feature and travel through the
driver as plan constants; rows never do. All ridge models come from one moment
matrix a fold, gathered in one pass. All logistic models take their Newton steps
together: a pass yields the gradient and Hessian of every fold and model.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import melt
from tidemark.operators import linear
from tidemark.operators.curve import bear_flattening
from tidemark.operators.ordering import medians

#: Newton steps at most, and the largest change of a coefficient that ends them.
NEWTON_STEPS, NEWTON_CHANGE = 12, 1e-10


@dataclass
class FoldScaling:
    """Train-only statistics of one fold."""

    rows: int
    target_mean: float
    target_deviation: float
    median: dict[str, float] = field(default_factory=dict)
    mean: dict[str, float] = field(default_factory=dict)
    deviation: dict[str, float] = field(default_factory=dict)

    def scaled(self, feature: str) -> Column:
        """Filled with the train median, centred and divided by the train deviation."""
        spread = self.deviation[feature] or 1.0
        filled = F.coalesce(F.col(feature).cast("double"), F.lit(self.median[feature]))
        return (filled - F.lit(self.mean[feature])) / F.lit(spread)

    def usable(self, features: Sequence[str]) -> list[str]:
        """Features with at least one train value."""
        return [f for f in features if f in self.median]


@dataclass
class LinearFit:
    features: list[str]
    intercept: float
    weights: list[float]

    def score(self) -> Column:
        """Linear predictor over already scaled columns."""
        out = F.lit(self.intercept)
        for f, w in zip(self.features, self.weights, strict=True):
            out = out + F.col(f) * F.lit(w)
        return out


def with_targets(df: DataFrame, ret: str = "forward_return_5") -> DataFrame:
    """Binary direction (NULL where the return is unknown) and the curve flag."""
    up = F.when(F.col(ret).isNotNull(), (F.col(ret) > 0).cast("double"))
    return df.withColumn("target_up_5d", up).withColumn("bear_flattening", bear_flattening())


def all_features(models: Mapping[str, Sequence[str]]) -> list[str]:
    return list(dict.fromkeys(f for fs in models.values() for f in fs))


def fold_scalings(tagged: DataFrame, features: Sequence[str], target: str) -> dict[str, FoldScaling]:
    """Median, and mean and population deviation of the median-filled values, per fold.

    Filling ``k`` missing values with the median moves mean and variance in
    closed form, so one long pass over the known values is enough.
    """
    train = tagged.filter((F.col("role") == "train") & F.col(target).isNotNull())
    targets = train.groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(target).alias("mean"), F.stddev_pop(target).alias("deviation")
    )
    out = {r["fold"]: FoldScaling(r["rows"], r["mean"], r["deviation"]) for r in targets.collect()}
    cells = F.array(*[F.col(f).cast("double") for f in features])
    long = train.select("fold", F.posexplode(cells).alias("feature", "value")).filter(F.col("value").isNotNull())
    group = ["fold", "feature"]
    known = long.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance")
    )
    for r in known.join(medians(long, group, "value"), group).collect():
        fold, f, n, middle = out[r["fold"]], features[r["feature"]], r["n"], r["median"]
        gaps = fold.rows - n
        mean = (n * r["mean"] + gaps * middle) / fold.rows
        variance = (n * (r["variance"] + (r["mean"] - mean) ** 2) + gaps * (middle - mean) ** 2) / fold.rows
        fold.median[f], fold.mean[f], fold.deviation[f] = middle, mean, math.sqrt(variance)
    return out


def _train_rows(tagged: DataFrame, scalings: Mapping[str, FoldScaling], features: Sequence[str], target: str, made) -> DataFrame:
    """Train rows of all folds: fold, y, one, a scaled column z0, z1, ... a feature, and ``made(fold)``.

    Each fold is a scan of its own range; a feature without train values is all zero.
    """
    parts = []
    for fold, scaling in scalings.items():
        rows = tagged.filter((F.col("fold") == fold) & (F.col("role") == "train") & F.col(target).isNotNull())
        scaled = [(scaling.scaled(f) if f in scaling.median else F.lit(0.0)).alias(f"z{i}") for i, f in enumerate(features)]
        placed = rows.select("fold", F.col(target).cast("double").alias("y"), F.lit(1.0).alias("one"), *scaled)
        parts.append(made(fold, placed))
    return reduce(DataFrame.unionByName, parts)


def _plans(models: Mapping[str, Sequence[str]], scalings: Mapping[str, FoldScaling], features: Sequence[str], first: int) -> list[tuple]:
    """(fold, model, places of the model's usable features among the matrix columns)."""
    return [(fold, m, [features.index(f) + first for f in scaling.usable(fs)]) for fold, scaling in scalings.items() for m, fs in models.items()]


def fit_ridge(tagged, models, scalings, target: str = "forward_return_5", alpha: float = 1.0) -> dict[tuple[str, str], LinearFit]:
    """Ridge on scaled features: one moment matrix a fold, an elimination of its sub-matrix a model.

    Scaled columns have mean zero over the train rows, so the intercept is the target's mean.
    """
    features = all_features(models)
    columns = [f"z{i}" for i in range(len(features))]

    def made(fold: str, rows: DataFrame) -> DataFrame:
        return rows.withColumn("y", F.col("y") - F.lit(scalings[fold].target_mean))

    rows = _train_rows(tagged, scalings, features, target, made)
    moments = linear.moments(rows, "fold", [*columns, "y"]).drop("name")
    plans = tagged.sparkSession.createDataFrame(_plans(models, scalings, features, 1), "fold string, model string, places array<int>")
    right = F.transform("places", lambda p: F.element_at(F.element_at("moments", p), len(columns) + 1))
    matrix = linear.picked(F.col("moments"), F.col("places"), F.transform("places", lambda p: F.lit(float(alpha))))
    solved = plans.join(moments, "fold").select("fold", "model", linear.solution(matrix, right).alias("weights"))
    return {
        (r["fold"], r["model"]): LinearFit(scalings[r["fold"]].usable(models[r["model"]]), scalings[r["fold"]].target_mean, list(r["weights"]))
        for r in solved.collect()
    }


def _newton_sums(plans: list[tuple], weights: dict[tuple[str, str], list[float]]) -> linear.Product:
    """Hessian and slope of every model of a fold over some rows: (one, z0, z1, ..., y)."""

    def sums(fold: str, values: np.ndarray) -> dict[str, np.ndarray]:
        out = {}
        for _, model, places in (p for p in plans if p[0] == fold):
            x = values[:, places]
            chance = 1.0 / (1.0 + np.exp(-(x @ np.array(weights[fold, model]))))
            slope = x.T @ (values[:, -1] - chance)
            out[model] = np.column_stack([x.T @ (x * (chance * (1.0 - chance))[:, None]), slope])
        return out

    return sums


def fit_logistic(tagged, models, scalings, target: str = "target_up_5d", inverse_penalty: float = 1.0) -> dict[tuple[str, str], LinearFit]:
    """Penalised logistic models of all folds by joint Newton steps, the intercept without penalty.

    Every pass over the train rows gives each model's gradient and Hessian; the steps are
    solved in the same job and only coefficients reach the driver. Without convergence
    after ``NEWTON_STEPS`` passes it raises.
    """
    features = all_features(models)
    columns = ["one", *[f"z{i}" for i in range(len(features))], "y"]
    plans = [(fold, m, [0, *places]) for fold, m, places in _plans(models, scalings, features, 1)]
    rows = _train_rows(tagged, scalings, features, target, lambda fold, rows: rows)
    spark = tagged.sparkSession
    weights = {(fold, m): [0.0] * len(places) for fold, m, places in plans}
    for _ in range(NEWTON_STEPS):
        sums = linear.moments(rows, "fold", columns, _newton_sums(plans, dict(weights)))
        state = [(fold, m, [0.0 if p == 0 else 1.0 / inverse_penalty for p in places], weights[fold, m]) for fold, m, places in plans]
        table = spark.createDataFrame(state, "fold string, name string, pull array<double>, weights array<double>")
        # the Hessian and, behind it, the slope; both with the penalty
        own = F.transform(
            "moments", lambda row, i: F.transform(row, lambda x, j: x + F.when(i == j, F.element_at("pull", i + 1)).when(j == F.size("pull"), -F.element_at("pull", i + 1) * F.element_at("weights", i + 1)).otherwise(0.0))
        )
        step = F.transform(linear.eliminated(own, F.size("pull")), lambda row: F.element_at(row, -1))
        steps = table.join(sums, ["fold", "name"]).select("fold", F.col("name").alias("model"), step.alias("step")).collect()
        most = 0.0
        for r in steps:
            weights[r["fold"], r["model"]] = [w + d for w, d in zip(weights[r["fold"], r["model"]], r["step"], strict=True)]
            most = max(most, *map(abs, r["step"]))
        if most < NEWTON_CHANGE:
            break
    else:
        raise ArithmeticError(f"logistic models still move by {most} after {NEWTON_STEPS} Newton steps")
    return {(fold, m): LinearFit(scalings[fold].usable(models[m]), w[0], w[1:]) for (fold, m), w in weights.items()}


def _scored(tagged: DataFrame, scalings: Mapping[str, FoldScaling], models, target: str, keep, cells) -> DataFrame:
    """Validation rows of each fold with its own scaling; folds are disjoint row sets."""
    parts = []
    for fold, scaling in scalings.items():
        rows = tagged.filter(
            (F.col("fold") == fold) & (F.col("role") == "validation") & F.col(target).isNotNull()
        )
        usable = scaling.usable(all_features(models))
        scaled = rows.select(*keep, *[scaling.scaled(f).alias(f"_z_{f}") for f in usable])
        named = scaled.select(*[c for c in scaled.columns if not c.startswith("_z_")], *[F.col(f"_z_{f}").alias(f) for f in usable])
        parts.append(named.select(*[c for c in scaled.columns if not c.startswith("_z_")], *cells(fold, scaling)))
    return reduce(DataFrame.unionByName, parts)


def ridge_predictions(tagged: DataFrame, fits, scalings, models: Mapping[str, Sequence[str]], target: str = "forward_return_5") -> DataFrame:
    """Long validation rows (fold, model, actual, prediction) of all models and both baselines."""
    names = ["naive_mean", "zero_return", *models]

    def cells(fold: str, scaling: FoldScaling):
        return [
            F.lit(scaling.target_mean).alias("naive_mean"),
            F.lit(0.0).alias("zero_return"),
            *[fits[fold, m].score().alias(m) for m in models],
        ]

    keep = ["fold", "symbol", "market_date", F.col(target).alias("actual")]
    wide = _scored(tagged, scalings, models, target, keep, cells)
    return melt(wide, ["fold", "symbol", "market_date", "actual"], names, "model", "prediction")


def logistic_predictions(tagged: DataFrame, fits, scalings, models: Mapping[str, Sequence[str]], target: str = "target_up_5d") -> DataFrame:
    """Wide validation rows, one probability column per model."""

    def cells(fold: str, scaling: FoldScaling):
        return [
            F.lit(scaling.target_mean).alias("base_probability"),
            *[
                (F.lit(1.0) / (F.lit(1.0) + F.exp(-fits[fold, m].score()))).alias(m.replace("_logistic", "_probability"))
                for m in models
            ],
        ]

    keep = ["symbol", "market_date", "fold", F.col(target).cast("int").alias("actual_up"), F.col("forward_return_5").alias("forward_return_5")]
    return _scored(tagged, scalings, models, target, keep, cells)


def long_predictions(wide: DataFrame, models: Mapping[str, Sequence[str]]) -> DataFrame:
    """(fold, model, probability, actual_up, ...) rows including the base rate."""
    named = {"base_rate": "base_probability", **{m: m.replace("_logistic", "_probability") for m in models}}
    keep = ["symbol", "market_date", "fold", "actual_up", "forward_return_5"]
    renamed = wide.select(*keep, *[F.col(c).alias(m) for m, c in named.items()])
    return melt(renamed, keep, list(named), "model", "probability")
