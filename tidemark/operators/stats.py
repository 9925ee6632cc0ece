"""Outcome summaries, correlations, calibration, model metrics and HAC inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.catalog import HORIZONS
from tidemark.functions.scalars import correlation, melt, ratio, share, two_sided_normal_p
from tidemark.operators import panel
from tidemark.operators.ordering import masked_ranks, medians, ordinals, quantiles, with_ranks
from tidemark.session import materialize

QUINTILE_LABELS = ("Q1_lowest", "Q2", "Q3", "Q4", "Q5_highest")


# --------------------------------------------------------------- outcomes


def _horizon_long(df: DataFrame, keys: Sequence[str], horizons: Sequence[int]) -> DataFrame:
    returns = F.array(*[F.col(f"forward_return_{h}").cast("double") for h in horizons])
    numbers = F.array(*[F.lit(h) for h in horizons])
    long = df.select(*keys, F.posexplode(returns).alias("_at", "_ret"))
    return long.select(*keys, F.element_at(numbers, F.col("_at") + 1).alias("horizon"), "_ret")


def outcome_statistics(df: DataFrame, keys: Sequence[str], horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Long table per (keys, horizon): rows, n, mean, median, std, standard error, CI, hit rate."""
    keys = list(keys)
    long = _horizon_long(df, keys, horizons)
    group = [*keys, "horizon"]
    ret = F.col("_ret")
    base = long.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(ret).alias("n"),
        F.avg(ret).alias("mean"),
        F.stddev_samp(ret).alias("std"),
        share(ret > 0, ret).alias("positive_rate"),
    )
    middle = medians(long.filter(ret.isNotNull()), group, "_ret")
    error = F.when(F.col("n") > 1, F.col("std") / F.sqrt("n"))
    return (
        base.join(middle, group, "left")
        .withColumn("se", error)
        .withColumn("ci95_low", F.col("mean") - 1.96 * F.col("se"))
        .withColumn("ci95_high", F.col("mean") + 1.96 * F.col("se"))
    )


def _widen(long: DataFrame, keys: Sequence[str], count: str, columns: dict[str, str], horizons: Sequence[int]) -> DataFrame:
    """One row per key; ``columns`` maps a name pattern with ``{h}`` to a long column."""
    cells = [
        F.max(F.when(F.col("horizon") == h, F.col(source))).alias(pattern.format(h=h))
        for h in horizons
        for pattern, source in columns.items()
    ]
    return long.groupBy(*keys).agg(F.max("rows").alias(count), *cells)


def score_summary(scored: DataFrame, score: str = "directional_score", horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Forward returns after each score value."""
    columns = {
        "n_{h}": "n",
        "mean_return_{h}": "mean",
        "median_return_{h}": "median",
        "std_return_{h}": "std",
        "se_return_{h}": "se",
        "ci95_low_{h}": "ci95_low",
        "ci95_high_{h}": "ci95_high",
        "positive_rate_{h}": "positive_rate",
    }
    known = scored.filter(F.col(score).isNotNull())
    return _widen(outcome_statistics(known, [score], horizons), [score], "observations", columns, horizons)


_REGIME_COLUMNS = {
    "n_{h}d": "n",
    "mean_return_{h}d": "mean",
    "median_return_{h}d": "median",
    "positive_rate_{h}d": "positive_rate",
}


def regime_summary(df: DataFrame, regime: str = "treasury_regime", horizons: Sequence[int] = HORIZONS) -> DataFrame:
    return _widen(outcome_statistics(df, [regime], horizons), [regime], "observations", _REGIME_COLUMNS, horizons)


def episode_summary(starts: DataFrame, regime: str = "treasury_regime", horizons: Sequence[int] = HORIZONS) -> DataFrame:
    known = starts.filter(F.col(regime) != "unclassified")
    return _widen(outcome_statistics(known, [regime], horizons), [regime], "episodes", _REGIME_COLUMNS, horizons)


def unconditional_baseline(df: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """One row: mean and hit rate of every horizon over all rows."""
    cells = []
    for h in horizons:
        ret = F.col(f"forward_return_{h}")
        cells += [F.avg(ret).alias(f"baseline_mean_{h}d"), share(ret > 0, ret).alias(f"baseline_positive_rate_{h}d")]
    return df.agg(*cells)


def with_excess(summary: DataFrame, baseline: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Regime means minus the one-row baseline."""
    joined = summary.crossJoin(F.broadcast(baseline))
    excess = []
    for h in horizons:
        excess += [
            (F.col(f"mean_return_{h}d") - F.col(f"baseline_mean_{h}d")).alias(f"excess_return_{h}d"),
            (F.col(f"positive_rate_{h}d") - F.col(f"baseline_positive_rate_{h}d")).alias(f"excess_positive_rate_{h}d"),
        ]
    return joined.select(*summary.columns, *excess)


def sign_conditional_means(df: DataFrame, by: str, target: str) -> DataFrame:
    x, y = F.col(by), F.col(target)
    return df.agg(
        F.count_if(x > 0).alias("positive_events"),
        F.count_if(x < 0).alias("negative_events"),
        F.avg(F.when(x > 0, y)).alias("mean_after_positive"),
        F.avg(F.when(x < 0, y)).alias("mean_after_negative"),
    )


# ----------------------------------------------------------- relationships


def pair_rows(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Long (feature, target, x, y) rows complete in both, pairs named by position.

    One row becomes features x targets rows, so the rows are first dealt out
    evenly: a task then expands a small share instead of a whole input split.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    xs = F.array(*[F.col(f).cast("double") for f in features])
    ys = F.array(*[F.col(t).cast("double") for t in targets])
    whole = F.xxhash64(*dict.fromkeys([*features, *targets]))
    dealt = df.select(whole.alias("_row_hash"), xs.alias("_xs"), ys.alias("_ys")).repartition(width)
    by_target = dealt.select("_row_hash", "_xs", F.posexplode("_ys").alias("target", "y"))
    pairs = by_target.filter(F.col("y").isNotNull()).select(
        "_row_hash", "target", "y", F.posexplode("_xs").alias("feature", "x")
    )
    return pairs.filter(F.col("x").isNotNull())


def _named(table: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Positions back to names, on the aggregated table."""
    f = F.array(*[F.lit(n) for n in features])
    t = F.array(*[F.lit(n) for n in targets])
    rest = [c for c in table.columns if c not in ("feature", "target")]
    return table.select(
        F.element_at(f, F.col("feature") + 1).alias("feature"),
        F.element_at(t, F.col("target") + 1).alias("target"),
        *rest,
    )


def pearson_table(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    table = (
        pair_rows(df, features, targets)
        .groupBy("feature", "target")
        .agg(F.count(F.lit(1)).alias("observations"), correlation("x", "y").alias("pearson"))
    )
    return _named(table, features, targets)


def _weighted_correlation(x: str, y: str, n: str) -> Column:
    """Pearson correlation of rows that stand for ``n`` rows each; NULL for a constant input.

    Meant for columns centred near their mean, whose raw moments lose no digits.
    """
    rows, a, b = F.sum(n), F.sum(F.col(n) * F.col(x)), F.sum(F.col(n) * F.col(y))
    aa = F.sum(F.col(n) * F.col(x) * F.col(x)) - a * a / rows
    bb = F.sum(F.col(n) * F.col(y) * F.col(y)) - b * b / rows
    ab = F.sum(F.col(n) * F.col(x) * F.col(y)) - a * b / rows
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    zero = F.lit(0.0)
    return F.when(varies, F.try_divide(ab, F.sqrt(F.greatest(aa, zero)) * F.sqrt(F.greatest(bb, zero))))


def _pair_correlations(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Pearson on the values and Spearman on average ranks, ranked inside each complete pair.

    Equal rows are one row with its count. A row is copied once a feature and once a target, not once a
    pair: each column is ordered once and carries a rank for every partner, counted over the rows in
    which that partner is there. Both sides then meet on the row, at most features x targets pairs each.
    """
    columns = [
        *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)],
        *[F.col(t).cast("double").alias(f"_y{i}") for i, t in enumerate(targets)],
    ]
    names = [f"_x{i}" for i in range(len(features))], [f"_y{i}" for i in range(len(targets))]
    counted = df.select(*columns).groupBy(*names[0], *names[1]).agg(F.count(F.lit(1)).alias("_n"))
    # the ids are written with their rows, so all branches see the same ones
    rows = materialize(
        counted.select(
            F.monotonically_increasing_id().alias("_row"), "_n", F.array(*names[0]).alias("_xs"), F.array(*names[1]).alias("_ys")
        )
    )

    def side(own: str, other: str, position: str, value: str, partners: int) -> DataFrame:
        seen = F.transform(other, lambda cell: cell.isNotNull()).alias("_seen")
        long = rows.select("_row", "_n", seen, F.posexplode(own).alias(position, value)).filter(F.col(value).isNotNull())
        return masked_ranks(long, position, value, "_seen", partners, "_n", f"_ranks_{value}").drop("_seen")

    xs = side("_xs", "_ys", "feature", "x", len(targets))
    ys = side("_ys", "_xs", "target", "y", len(features)).drop("_n")
    pairs = xs.join(ys, "_row").select(
        "feature",
        "target",
        "_n",
        "x",
        "y",
        F.get("_ranks_x", F.col("target")).alias("_rank_x"),
        F.get("_ranks_y", F.col("feature")).alias("_rank_y"),
    )
    table = pairs.groupBy("feature", "target").agg(
        F.sum("_n").alias("observations"),
        _weighted_correlation("x", "y", "_n").alias("pearson"),
        _weighted_correlation("_rank_x", "_rank_y", "_n").alias("spearman"),
    )
    return _named(table, features, targets)


def relationships(df: DataFrame, features: Sequence[str], targets: Sequence[str], least: int = 3) -> DataFrame:
    """Every feature against every target, pairs with fewer than ``least`` rows left out."""
    return (
        _pair_correlations(df, features, targets)
        .filter(F.col("observations") >= least)
        .select("*", F.abs("pearson").alias("abs_pearson"), F.abs("spearman").alias("abs_spearman"))
    )


def event_correlations(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Relationships with the number of distinct feature values."""
    distinct = _named(
        pair_rows(df, features, [target])
        .groupBy("feature", "target", "x")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("feature", "target")
        .agg(F.count(F.lit(1)).alias("unique_feature_values")),
        features,
        [target],
    ).drop("target")
    return (
        relationships(df, features, [target], least=1)
        .join(distinct, "feature")
        .select("feature", "observations", "unique_feature_values", "pearson", "spearman")
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both correlations for all column pairs over complete rows."""
    complete = df.select(*columns).dropna()
    return relationships(complete, columns, columns, least=2).select(
        F.col("feature").alias("row"), F.col("target").alias("column"), "pearson", "spearman"
    )


def describe_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles and max per column."""
    long = melt(df, [], list(columns), "feature", "_value").filter(F.col("_value").isNotNull())
    value = F.col("_value")
    base = long.groupBy("feature").agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    quarter = (
        quantiles(long, ["feature"], "_value", [0.25, 0.5, 0.75])
        .groupBy("feature")
        .agg(
            *[
                F.max(F.when(F.col("q") == q, F.col("quantile"))).alias(name)
                for q, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))
            ]
        )
    )
    return base.join(quarter, "feature")


# -------------------------------------------------- probability diagnostics


def with_quintile(
    predictions: DataFrame,
    keys: Sequence[str] = ("model",),
    probability: str = "probability",
    date: str = "market_date",
    name: str = "symbol",
) -> DataFrame:
    """Equal-count fifths by position; ties in probability go by date, then name.

    A row without a probability has no bucket and doesn't count.
    """
    keys = list(keys)
    missing = predictions.filter(F.col(probability).isNull()).withColumn("probability_bucket", F.lit(None).cast("string"))
    known = predictions.filter(F.col(probability).isNotNull())
    placed = ordinals(known, keys, probability, date, name, "_at")
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    number = F.ceil(F.col("_at") * 5 / F.col("_size")).cast("int")
    label = F.element_at(F.array(*[F.lit(q) for q in QUINTILE_LABELS]), number)
    return (
        placed.join(F.broadcast(sizes), keys)
        .withColumn("probability_bucket", label)
        .drop("_at", "_size")
        .unionByName(missing)
    )


def quintile_summary(
    predictions: DataFrame, keys: Sequence[str] = ("model",), ret: str = "forward_return_5"
) -> DataFrame:
    group = [*keys, "probability_bucket"]
    # read for the counts and again for the medians
    bucketed = materialize(with_quintile(predictions, keys).select(*group, "probability", "actual_up", ret))
    base = bucketed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("observations"),
        F.avg("probability").alias("mean_predicted_probability"),
        F.avg("actual_up").alias("actual_positive_rate"),
        F.avg(ret).alias(f"mean_{ret}"),
    )
    return base.join(medians(bucketed, group, ret, f"median_{ret}"), group, "left")


CALIBRATION_EDGES = tuple(k * 0.1 for k in range(11))


def calibration_bin(probability: str = "probability") -> Column:
    """Number of the right-closed tenth; zero belongs to the first, outside is NULL."""
    p = F.col(probability)
    out = F.lit(None).cast("int")
    for k in range(10, 0, -1):
        out = F.when(p <= CALIBRATION_EDGES[k], F.lit(k)).otherwise(out)
    return F.when(p >= 0, out)


def calibration_label(number: Column) -> Column:
    labels = ["(-0.001, 0.1]", *[f"({k / 10}, {(k + 1) / 10}]" for k in range(1, 10)]]
    return F.element_at(F.array(*[F.lit(x) for x in labels]), number)


def calibration(predictions: DataFrame, keys: Sequence[str] = ("model",), ret: str = "forward_return_5") -> DataFrame:
    """Predicted against realised rates in ten equal-width bins; empty bins do not appear."""
    return (
        predictions.withColumn("_bin", calibration_bin())
        .filter(F.col("_bin").isNotNull())
        .groupBy(*keys, calibration_label(F.col("_bin")).alias("calibration_bucket"))
        .agg(
            F.count(F.lit(1)).alias("observations"),
            F.avg("probability").alias("mean_predicted_probability"),
            F.avg("actual_up").alias("actual_positive_rate"),
            F.avg(ret).alias(f"mean_{ret}"),
        )
    )


# ------------------------------------------------------------ model metrics


def regression_metrics(predictions: DataFrame, keys: Sequence[str] = ("fold", "model")) -> DataFrame:
    """MAE, RMSE, R² and directional accuracy of (``actual``, ``prediction``) rows.

    An all-zero forecast has no direction: its accuracy is NULL.
    """
    y, p = F.col("actual"), F.col("prediction")
    gap = y - p
    return predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("validation_rows"),
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.avg(gap * gap), F.var_pop(y))).alias("r2"),
        F.when(F.max(F.abs(p)) > 0, F.avg((F.signum(y) == F.signum(p)).cast("double"))).alias("directional_accuracy"),
    )


def roc_auc(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mann-Whitney AUC from exact average ranks."""
    known = predictions.filter(F.col("probability").isNotNull() & F.col("actual_up").isNotNull())
    salted = known.withColumn("_row_hash", F.xxhash64(*known.columns))
    ranked = with_ranks(salted, keys, {"probability": "_rank"}, salt="_row_hash")
    up = F.sum("actual_up").cast("double")
    down = F.sum(1 - F.col("actual_up")).cast("double")
    wins = F.sum(F.when(F.col("actual_up") == 1, F.col("_rank"))) - up * (up + 1) / 2
    return ranked.groupBy(*keys).agg(F.try_divide(wins, up * down).alias("roc_auc"))


def classification_metrics(predictions: DataFrame, keys: Sequence[str] = ("fold", "model")) -> DataFrame:
    """AUC, Brier score, log loss, accuracy and balanced accuracy at 0.5."""
    keys = list(keys)
    p, y = F.col("probability"), F.col("actual_up")
    tiny = 2.220446049250313e-16
    clipped = F.greatest(F.lit(tiny), F.least(F.lit(1 - tiny), p))
    said_up = (p >= 0.5).cast("int")
    caught_up = F.avg(F.when(y == 1, said_up.cast("double")))
    caught_down = F.avg(F.when(y == 0, (1 - said_up).cast("double")))
    base = predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("validation_rows"),
        F.avg(y.cast("double")).alias("validation_up_rate"),
        F.avg((p - y) * (p - y)).alias("brier_score"),
        F.avg(-F.when(y == 1, F.log(clipped)).otherwise(F.log(F.lit(1.0) - clipped))).alias("log_loss"),
        F.avg((said_up == y).cast("double")).alias("accuracy"),
        ((F.coalesce(caught_up, caught_down) + F.coalesce(caught_down, caught_up)) / 2).alias("balanced_accuracy"),
    )
    return base.join(roc_auc(predictions, keys), keys)


def average_over_folds(metrics: DataFrame, columns: Sequence[str], sort: str, descending: bool = False) -> DataFrame:
    mean = metrics.groupBy("model").agg(*[F.avg(c).alias(c) for c in columns])
    return mean.orderBy(F.desc(sort) if descending else F.asc(sort))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("observations"))


def age_histogram(df: DataFrame, age: str) -> DataFrame:
    return df.groupBy(age).agg(F.count(F.lit(1)).alias("observations"))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


# ------------------------------------------------------------ HAC inference


def _lag_products(df: DataFrame, regime: str, horizons: Sequence[int]) -> DataFrame:
    """Sums of y_t and y_(t−l) products per (horizon, lag, regime now, regime then).

    These few rows are enough for the Newey-West matrix of every regime, so the
    panel is read once for all regimes and horizons. Lags are taken inside a
    symbol over rows whose target is known.
    """
    means = df.agg(*[F.avg(f"forward_return_{h}").alias(f"_mean_{h}") for h in horizons])
    centred = df.crossJoin(F.broadcast(means)).select(
        "symbol",
        "market_date",
        F.col(regime).alias("_now"),
        *[(F.col(f"forward_return_{h}") - F.col(f"_mean_{h}")).alias(f"forward_return_{h}") for h in horizons],
    )
    long = _horizon_long(centred, ["symbol", "market_date", "_now"], horizons).filter(
        F.col("_ret").isNotNull() & F.col("_now").isNotNull()
    )
    by = ["symbol", "horizon"]
    frame = panel.spread(panel.index_rows(long, by), back=max(horizons))
    w = panel.window(by)
    past = [
        F.struct(
            F.lit(l).alias("lag"),
            F.lag("_now", l).over(w).alias("_then") if l else F.col("_now").alias("_then"),
            F.lag("_ret", l).over(w).alias("_past") if l else F.col("_ret").alias("_past"),
        )
        for l in range(max(horizons) + 1)
    ]
    lagged = panel.settle(frame.withColumn("_lags", F.array(*past)))
    return (
        lagged.select("horizon", "_now", "_ret", F.inline("_lags"))
        .filter((F.col("lag") <= F.col("horizon")) & F.col("_then").isNotNull())
        .groupBy("horizon", "lag", "_now", "_then")
        .agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.sum("_ret").alias("s"),
            F.sum("_past").alias("s_past"),
            F.sum(F.col("_ret") * F.col("_past")).alias("ss"),
        )
    )


def hac_regime_effects(
    df: DataFrame, regime: str = "treasury_regime", horizons: Sequence[int] = HORIZONS
) -> DataFrame:
    """Mean return difference inside/outside a regime with Newey-West errors.

    OLS of the forward return on a constant and the regime indicator; Bartlett
    weights 1 − l/(h+1) with h lags, no small-sample factor, normal p-value.
    """
    products = _lag_products(df, regime, horizons)
    at_zero = products.filter("lag = 0")
    cells = at_zero.select("horizon", F.col("_now").alias(regime), "n", "s")
    whole = cells.groupBy("horizon").agg(F.sum("n").alias("_n"), F.sum("s").alias("_s"))
    effects = (
        cells.filter(F.col(regime) != "unclassified")
        .join(whole, "horizon")
        .select(
            "horizon",
            regime,
            F.col("n").alias("n1"),
            (F.col("_n") - F.col("n")).alias("n0"),
            ratio("s", "n").alias("m1"),
            ratio(F.col("_s") - F.col("s"), F.col("_n") - F.col("n")).alias("m0"),
        )
    )
    joined = effects.join(products, "horizon")
    now, then = F.col("_now") == F.col(regime), F.col("_then") == F.col(regime)
    mean_now = F.when(now, F.col("m1")).otherwise(F.col("m0"))
    mean_then = F.when(then, F.col("m1")).otherwise(F.col("m0"))
    residuals = F.col("ss") - mean_then * F.col("s") - mean_now * F.col("s_past") + F.col("n") * mean_now * mean_then
    bartlett = F.lit(1.0) - F.col("lag") / (F.col("horizon") + 1)
    weight = F.when(F.col("lag") == 0, F.lit(1.0)).otherwise(bartlett)
    # second row of (X'X)^-1 is (-1/n0, n/(n0 n1)) = 1/n1 inside the regime, -1/n0 outside
    load_now = F.when(now, 1 / F.col("n1")).otherwise(F.try_divide(F.lit(-1.0), F.col("n0")))
    load_then = F.when(then, 1 / F.col("n1")).otherwise(F.try_divide(F.lit(-1.0), F.col("n0")))
    doubled = F.when(F.col("lag") == 0, F.lit(1.0)).otherwise(F.lit(2.0))
    variance = F.sum(doubled * weight * load_now * load_then * residuals)
    out = (
        joined.groupBy(regime, F.col("horizon").alias("horizon_days"))
        .agg(
            F.first("n1").alias("_n1"),
            F.first("n0").alias("_n0"),
            F.first(F.col("m1") - F.col("m0")).alias("coefficient"),
            F.sqrt(F.greatest(variance, F.lit(0.0))).alias("hac_standard_error"),
        )
        .withColumn("t_stat", ratio("coefficient", "hac_standard_error"))
    )
    return out.select(
        regime,
        "horizon_days",
        (F.col("_n1") + F.col("_n0")).cast("long").alias("observations"),
        F.col("_n1").cast("long").alias("regime_observations"),
        "coefficient",
        "hac_standard_error",
        "t_stat",
        two_sided_normal_p(F.col("t_stat")).alias("p_value"),
        (F.col("coefficient") - 1.96 * F.col("hac_standard_error")).alias("ci_95_low"),
        (F.col("coefficient") + 1.96 * F.col("hac_standard_error")).alias("ci_95_high"),
    )
