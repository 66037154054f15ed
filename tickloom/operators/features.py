"""Feature statistics against a forward target, studies and listings of their results."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.expressions import corr_guarded, ratio
from tickloom.sources.catalog import stored


def feature_table(bars: DataFrame, horizon: int = 5) -> DataFrame:
    """(symbol, time, feature values, target) for the statistics below. Features know only bars up to their own."""
    from tickloom.operators import indicators as I

    bars = I.returns(I.forward_target(bars, horizon), 10)
    bars = bars.withColumn("gap", ratio(F.col("close"), I.sma(F.col("close"), 20)) - 1)
    return I.volatility_regime(bars).select("symbol", "time", "ret", "gap", F.col("roc").alias("roc10"), "vol", "regime", "target")


def information(rows: DataFrame, feature: str, target: str, by: list[str]) -> DataFrame:
    """ic: correlation of feature and target in each group; n: rows that have both."""
    x, y = F.col(feature), F.col(target)
    return rows.groupBy(*by).agg(F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias("n"), corr_guarded(x, y).alias("ic"))


def average_rank(x: Column, by: list[str]) -> Column:
    """Ranks from 1; equal values share the mean of theirs."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2.0


def rank_information(rows: DataFrame, feature: str, target: str, by: list[str]) -> DataFrame:
    """Correlation of average ranks of feature and target over rows that have both."""
    both = rows.dropna(subset=[feature, target])
    ranked = both.withColumns({"__x": average_rank(F.col(feature), by), "__y": average_rank(F.col(target), by)})
    return information(ranked, "__x", "__y", by).withColumnRenamed("ic", "rank_ic")


def mutual_information(rows: DataFrame, feature: str, target: str, by: list[str], bins: int = 5) -> DataFrame:
    """Plug-in estimate in nats from equally filled bins of both (ties by time): sum of p ln(p / (px py))."""
    both = rows.dropna(subset=[feature, target])
    w = Window.partitionBy(*by)
    cut = both.withColumns({"__x": F.ntile(bins).over(w.orderBy(feature, "time")), "__y": F.ntile(bins).over(w.orderBy(target, "time"))})
    cells = cut.groupBy(*by, "__x", "__y").agg(F.count("*").alias("n"))
    total = F.sum("n").over(w)
    nx, ny = F.sum("n").over(Window.partitionBy(*by, "__x")), F.sum("n").over(Window.partitionBy(*by, "__y"))
    cells = cells.withColumns({"p": F.col("n") / total, "lift": F.col("n") * total / (nx * ny)})
    return cells.groupBy(*by).agg(F.sum(F.col("p") * F.ln("lift")).alias("mutual_info"))


def stability(rows: DataFrame, feature: str, target: str, by: list[str], fold: Column) -> DataFrame:
    """Mean over deviation of the fold-wise ic (null where it does not vary or there is one fold)."""
    folds = information(rows.withColumn("fold", fold), feature, target, [*by, "fold"])
    return folds.groupBy(*by).agg(F.count("ic").alias("folds"), F.avg("ic").alias("mean_ic"), ratio(F.avg("ic"), F.stddev_samp("ic")).alias("stability"))


def heatmap(rows: DataFrame, features: list[str], target: str, by: list[str]) -> DataFrame:
    """(feature, metric, value): n, ic and standard deviation of each feature over all rows, unpivoted."""
    stats = [F.struct(F.lit(f).alias("feature"), F.count(F.col(f)).cast("double").alias("n"), corr_guarded(F.col(f), F.col(target)).alias("ic"), F.stddev_samp(f).alias("sd")) for f in features]
    wide = rows.agg(F.array(*stats).alias("s")).select(F.inline("s"))
    return wide.unpivot("feature", ["n", "ic", "sd"], "metric", "value")


def top_ranked(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows in a total order, with rank from 1. Each task keeps that many before they meet."""
    return rows.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def ranked(rows: DataFrame, order: list[Column], most: int | None = None) -> DataFrame:
    """Rows with rank from 1 in a total order; with most, the first so many of them only.

    All rows are dealt by ranges of the order and stored, so that a range stays what it is; a row's rank is its place
    in its range after the sizes of the ranges before. No task sorts more than a range."""
    if most is not None:
        return top_ranked(rows, order, most)
    stretch, before = F.col("__range"), F.col("__before")
    dealt = stored(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))  # a row for each partition
    sizes = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy(stretch).orderBy(*order))
    return dealt.withColumn("__place", place).join(F.broadcast(sizes), "__range").withColumn("rank", (F.col("__place") + before).cast("long")).drop("__range", "__place", "__before")


def composite_scores(rows: DataFrame, weights: dict[str, float], key: str, most: int | None = None) -> DataFrame:
    """score: weighted sum (a missing part counts 0), and all rows' rank by it, ties by key; with most, the highest."""
    score = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return ranked(rows.withColumn("score", F.round(score, 9)), [F.desc("score"), F.col(key)], most)


#: Degrees of freedom from which on the normal distribution stands for Student's (they differ by less than 1e-6 there).
MANY = 200_000


def paired_delta(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n complete pairs, mean of b - a, Cohen's d (mean over deviation), t and its two-sided p by Student's
    distribution of n - 1 degrees of freedom (null below 1, or where the differences do not vary)."""
    d = F.col(b) - F.col(a)
    out = pairs.agg(F.count(d).alias("n"), F.avg(d).alias("mean_delta"), ratio(F.avg(d), F.stddev_samp(d)).alias("cohens_d"))
    out = out.withColumn("t", F.col("cohens_d") * F.sqrt("n"))
    return out.withColumn("p_value", student_p(F.col("t"), F.col("n") - 1))


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of t with a whole number of degrees of freedom, by the finite sums of Abramowitz and Stegun 26.7.3-4:
    powers of cos(theta), theta = atan(|t| / sqrt(df)), with products of even over odd numbers (odd df) or odd over even."""
    theta = F.atan(F.abs(t) / F.sqrt(df))
    odd = df % 2 == 1
    square = F.pow(F.cos(theta), F.lit(2))
    first = F.when(odd, F.cos(theta)).otherwise(F.lit(1.0))
    k_from = F.when(odd, 1).otherwise(0)
    terms = F.greatest(F.floor((df - k_from) / 2), F.lit(0)).cast("int")
    grow = lambda k: F.when(odd, 2.0 * k / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k))
    start = F.struct(F.lit(0.0).alias("sum"), first.alias("term"))
    step = lambda acc, k: F.struct((acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * square * grow(k)).alias("term"))
    total = F.aggregate(F.slice(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), F.lit(1), terms), start, step, lambda acc: acc["sum"])
    inside = F.when(odd, (theta + F.sin(theta) * total) * (2 / math.pi)).otherwise(F.sin(theta) * total)
    exact = F.greatest(1 - inside, F.lit(0.0))
    return F.when((df >= 1) & t.isNotNull(), F.when(df > MANY, 2 * (1 - normal_cdf(F.abs(t)))).otherwise(exact))


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun's rational approximation 26.2.17 (error below 7.5e-8), for z >= 0."""
    k = 1 / (1 + 0.2316419 * z)
    # fixed values of the published formula
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    return 1 - F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def moments(rows: DataFrame, x: str, by: list[str]) -> DataFrame:
    """n, mean, sd, skew and excess kurtosis (population moments; null where x does not vary), and the sample's Sharpe
    ratio. Spark's own moments are updated around the running mean, so values far from 0 lose nothing."""
    c = F.col(x)
    varies = F.var_pop(c) > 0
    agg = rows.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.when(varies, F.skewness(c)).alias("skew"), F.when(varies, F.kurtosis(c)).alias("kurtosis"))
    return agg.withColumn("sharpe", ratio(F.col("mean"), F.col("sd")))


EULER = 0.5772156649015329


def expected_maximum(trials: int) -> float:
    """What the best of so many independent standard normal trials comes to on average (Bailey and Lopez de Prado 2014)."""
    if trials < 2:
        return 0.0
    z = NormalDist().inv_cdf
    return (1 - EULER) * z(1 - 1 / trials) + EULER * z(1 - 1 / (trials * math.e))


def deflated_sharpe(stats: DataFrame, trials: int) -> DataFrame:
    """stats (as moments gives them, a row for each trial's returns) with dsr: the probability that the Sharpe ratio
    exceeds what the best of `trials` trials without skill would show, given the spread of the rows' ratios and the
    returns' skew and kurtosis. Null where a moment is, or the spread of fewer than two rows."""
    spread = stats.agg(F.stddev_samp("sharpe").alias("__spread"))  # one row
    sr, skew, kurt = F.col("sharpe"), F.col("skew"), F.col("kurtosis") + 3
    z = ratio((sr - F.col("__spread") * expected_maximum(trials)) * F.sqrt(F.col("n") - 1), F.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr))
    p = normal_cdf(F.abs(z))
    return stats.crossJoin(F.broadcast(spread)).withColumn("dsr", F.when(z >= 0, p).otherwise(1 - p)).drop("__spread")


def r_squared(rows: DataFrame, actual: str, fitted: str, by: list[str]) -> DataFrame:
    """1 - residual over total sum of squares, over rows that have both; null where actual does not vary."""
    both = rows.dropna(subset=[actual, fitted])
    a, e = F.col(actual), F.col(actual) - F.col(fitted)
    return both.groupBy(*by).agg((1 - ratio(F.sum(e * e), F.var_pop(a) * F.count(a))).alias("r2"))


def status_counts(rows: DataFrame, status: str, values: list[str], by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in values])


def best_trials(rows: DataFrame, study: str, trial: str, value: str, largest: bool = True) -> DataFrame:
    """The best trial of each study; ties go to the smallest trial. Trials without a value do not take part."""
    v = F.col(value) if largest else -F.col(value)
    return rows.where(v.isNotNull()).groupBy(study).agg(F.max_by(trial, F.struct(v, -F.col(trial))).alias("best_trial"), (F.max if largest else F.min)(value).alias("best_value"), F.count("*").alias("trials"))


def importances(rows: DataFrame, parameters: list[str], value: str) -> DataFrame:
    """For each parameter the share of the value's variance that lies between its values (eta squared); null where the
    value does not vary. Variances within and in all come from Spark's own, which do not cancel."""
    v = F.col(value)
    long = rows.where(v.isNotNull()).select(v.alias("v"), F.explode(F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).cast("string").alias("level")) for p in parameters])).alias("x")).select("v", "x.*")
    levels = long.groupBy("parameter", "level").agg((F.var_pop("v") * F.count("v")).alias("within"))
    total = rows.agg((F.var_pop(v) * F.count(v)).alias("total"))  # one row
    within = levels.groupBy("parameter").agg(F.sum("within").alias("within"))
    return within.crossJoin(F.broadcast(total)).select("parameter", F.greatest(1 - ratio(F.col("within"), F.col("total")), F.lit(0.0)).alias("importance"))


def parallel_rows(rows: DataFrame, columns: list[str], order: list[Column], cap: int) -> DataFrame:
    """Up to cap rows in order for a parallel-coordinates plot, each with capped: whether there are more."""
    over = rows.agg((F.count("*") > cap).alias("capped"))
    return rows.select(*columns).orderBy(*order).limit(cap).crossJoin(F.broadcast(over))  # one row


def feature_clusters(rows: DataFrame, features: list[str], threshold: float = 0.7) -> DataFrame:
    """(feature, cluster): features whose absolute correlations reach the threshold, and their chains, share a cluster
    named by its first feature. All pairs' correlations are one aggregate; the few features are joined on the driver."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    if not pairs:
        return rows.sparkSession.createDataFrame([(f, f) for f in features], "feature string, cluster string")
    row = rows.agg(*[corr_guarded(F.col(a), F.col(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first()
    root = {f: f for f in features}

    def find(f: str) -> str:
        while root[f] != f:
            f = root[f]
        return f

    for i, (a, b) in enumerate(pairs):
        if row[i] is not None and abs(row[i]) >= threshold:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return rows.sparkSession.createDataFrame([(f, find(f)) for f in features], "feature string, cluster string")


#: Objectives: the metric that orders runs, and whether more is better.
OBJECTIVES = {"profit": ("best_value", True), "trials": ("trials", True), "low_cost": ("best_value", False)}


def by_objective(rows: DataFrame, mode: str, key: str, most: int | None = None) -> DataFrame:
    """All rows with their rank by the mode's metric, ties by key; rows without it come last. With most, the first."""
    if mode not in OBJECTIVES:
        raise ValueError(f"unknown objective {mode!r}")
    metric, more = OBJECTIVES[mode]
    order = F.desc_nulls_last(metric) if more else F.asc_nulls_last(metric)
    return ranked(rows, [order, F.col(key)], most)
