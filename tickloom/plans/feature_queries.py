"""Feature statistics, studies and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import features as X
from tickloom.plans.indicator_queries import REGIME, W, fr
from tickloom.plans.registry import bars_sql, query
from tickloom.plans.select_queries import hour_bars

FEATURES = f"""{bars_sql()}, {REGIME}, base AS (
        SELECT symbol, time, close, lag(close) {W}) AS p, lag(close, 10) {W}) AS b, lead(close, 5) {W}) AS n, CASE WHEN count(*) {fr(20)} = 20 THEN avg(close) {fr(20)} END AS m FROM bars),
    feat AS (SELECT base.symbol, base.time, base.close / nullif(p, 0) - 1 AS ret, base.close / nullif(m, 0) - 1 AS gap, (base.close / nullif(b, 0) - 1) * 100 AS roc10,
        CASE WHEN vol_pct >= 0.8 THEN 'high' WHEN vol_pct IS NOT NULL THEN 'low' END AS regime, n / nullif(base.close, 0) - 1 AS target FROM base JOIN pct USING (symbol, time))"""


def corr_sql(x: str, y: str) -> str:
    both = f"FILTER ({x} IS NOT NULL AND {y} IS NOT NULL)"
    return f"covar_samp({x}, {y}) / nullif(stddev_samp({x}) {both} * stddev_samp({y}) {both}, 0)"


def feats(t):
    return X.feature_table(hour_bars(t))


def r(*columns):
    return [F.round(c, 6).alias(c) for c in columns]


@query(f"WITH {FEATURES} SELECT symbol, count(*) FILTER (gap IS NOT NULL AND target IS NOT NULL) AS n, round({corr_sql('gap', 'target')}, 6) AS ic FROM feat GROUP BY symbol")
def ic(t):
    return X.information(feats(t), "gap", "target", ["symbol"]).select("symbol", "n", *r("ic"))


@query(f"WITH {FEATURES} SELECT symbol, regime, count(*) FILTER (gap IS NOT NULL AND target IS NOT NULL) AS n, round({corr_sql('gap', 'target')}, 6) AS ic FROM feat WHERE regime IS NOT NULL GROUP BY symbol, regime")
def regime_ic(t):
    return X.information(feats(t).where("regime IS NOT NULL"), "gap", "target", ["symbol", "regime"]).select("symbol", "regime", "n", *r("ic"))


RANKED = """ranked AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY round(gap, 9)) + (count(*) OVER (PARTITION BY symbol, round(gap, 9)) - 1) / 2.0::DOUBLE AS x,
        rank() OVER (PARTITION BY symbol ORDER BY round(target, 9)) + (count(*) OVER (PARTITION BY symbol, round(target, 9)) - 1) / 2.0::DOUBLE AS y
        FROM feat WHERE gap IS NOT NULL AND target IS NOT NULL)"""


def rounded_feats(t):
    """Ranks and bins compare values, so these are rounded first."""
    return feats(t).withColumns({c: F.round(c, 9) for c in ("ret", "gap", "roc10", "target")})


@query(f"WITH {FEATURES}, {RANKED} SELECT symbol, count(*) AS n, round({corr_sql('x', 'y')}, 6) AS rank_ic FROM ranked GROUP BY symbol")
def rank_ic(t):
    return X.rank_information(rounded_feats(t), "gap", "target", ["symbol"]).select("symbol", "n", *r("rank_ic"))


@query(f"""
    WITH {FEATURES}, c AS (SELECT symbol, ntile(5) OVER (PARTITION BY symbol ORDER BY round(gap, 9), time) AS x, ntile(5) OVER (PARTITION BY symbol ORDER BY round(target, 9), time) AS y FROM feat WHERE gap IS NOT NULL AND target IS NOT NULL),
    cells AS (SELECT symbol, x, y, count(*) AS n FROM c GROUP BY ALL),
    p AS (SELECT symbol, n, sum(n) OVER (PARTITION BY symbol) AS total, sum(n) OVER (PARTITION BY symbol, x) AS nx, sum(n) OVER (PARTITION BY symbol, y) AS ny FROM cells)
    SELECT symbol, round(sum(n / total * ln(n * total / (nx * ny))), 6) AS mutual_info FROM p GROUP BY symbol
""")
def mutual_info(t):
    return X.mutual_information(rounded_feats(t), "gap", "target", ["symbol"]).select("symbol", *r("mutual_info"))


@query(f"""
    WITH {FEATURES}, folds AS (SELECT symbol, date_trunc('week', time) AS fold, {corr_sql('gap', 'target')} AS ic FROM feat GROUP BY 1, 2)
    SELECT symbol, count(ic) AS folds, round(avg(ic), 6) AS mean_ic, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) AS stability FROM folds GROUP BY symbol
""")
def ic_stability(t):
    return X.stability(feats(t), "gap", "target", ["symbol"], F.date_trunc("week", "time")).select("symbol", "folds", *r("mean_ic", "stability"))


def _heat(f: str) -> str:
    return f"SELECT '{f}' AS feature, count({f})::DOUBLE AS n, {corr_sql(f, 'target')} AS ic, stddev_samp({f}) AS sd FROM feat"


@query(f"""
    WITH {FEATURES}, h AS ({_heat('ret')} UNION ALL {_heat('gap')} UNION ALL {_heat('roc10')})
    SELECT feature, 'n' AS metric, round(n, 6) AS value FROM h UNION ALL SELECT feature, 'ic', round(ic, 6) FROM h UNION ALL SELECT feature, 'sd', round(sd, 6) FROM h
""")
def feature_heatmap(t):
    return X.heatmap(feats(t), ["ret", "gap", "roc10"], "target", []).select("feature", "metric", *r("value"))


@query(f"""
    WITH {FEATURES}, s AS (SELECT symbol, {corr_sql('gap', 'target')} AS a, {corr_sql('ret', 'target')} AS b FROM feat GROUP BY symbol),
    c AS (SELECT symbol, round(0.0::DOUBLE + coalesce(round(a, 6), 0) * 0.7::DOUBLE + coalesce(round(b, 6), 0) * 0.3::DOUBLE, 9) AS score FROM s)
    SELECT symbol, score, row_number() OVER (ORDER BY score DESC, symbol) AS rank FROM c
""")
def leaderboard(t):
    f = feats(t)
    a = X.information(f, "gap", "target", ["symbol"]).select("symbol", F.round("ic", 6).alias("gap_ic"))
    b = X.information(f, "ret", "target", ["symbol"]).select("symbol", F.round("ic", 6).alias("ret_ic"))
    return X.composite_scores(a.join(b, "symbol"), {"gap_ic": 0.7, "ret_ic": 0.3}, "symbol").select("symbol", "score", "rank")


@query("""
    WITH v AS (SELECT o_custkey, sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS a, sum(o_totalprice) FILTER (o_orderpriority = '2-HIGH') AS b FROM orders GROUP BY 1),
    s AS (SELECT count(b - a) AS n, avg(b - a) AS mean_delta, avg(b - a) / nullif(stddev_samp(b - a), 0) AS d FROM v),
    h AS (SELECT *, atan(abs(d * sqrt(n)) / sqrt(n - 1)) AS theta, (n - 1) % 2 = 1 AS odd FROM s),
    k AS (SELECT *, list_reduce(list_prepend({'s': 0.0::DOUBLE, 't': CASE WHEN odd THEN cos(theta) ELSE 1.0::DOUBLE END, 'k': 0::BIGINT}, list_transform(range(1, CAST((n - 1 - CASE WHEN odd THEN 1 ELSE 0 END) // 2 AS BIGINT) + 1), lambda i: {'s': 0.0::DOUBLE, 't': 0.0::DOUBLE, 'k': i::BIGINT})),
            lambda x, y: {'s': x.s + x.t, 't': x.t * cos(theta) * cos(theta) * CASE WHEN odd THEN 2.0::DOUBLE * y.k / (2 * y.k + 1) ELSE (2.0::DOUBLE * y.k - 1) / (2 * y.k) END, 'k': y.k}).s AS total FROM h)
    SELECT n, round(mean_delta, 6) AS mean_delta, round(d, 6) AS cohens_d, round(d * sqrt(n), 6) AS t,
           round(greatest(1 - CASE WHEN odd THEN (theta + sin(theta) * total) * 2 / pi() ELSE sin(theta) * total END, 0), 6) AS p_value FROM k
""")
def paired_delta(t):
    by = lambda p: F.sum(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice")))
    pairs = t("orders").groupBy("o_custkey").agg(by("1-URGENT").alias("a"), by("2-HIGH").alias("b"))
    return X.paired_delta(pairs, "a", "b").select("n", *r("mean_delta", "cohens_d", "t", "p_value"))


MOMENTS = f"""{FEATURES}, m AS (SELECT symbol, avg(ret) AS mean FROM feat GROUP BY symbol),
    c AS (SELECT symbol, ret, ret - mean AS d, mean FROM feat JOIN m USING (symbol)),
    mom AS (SELECT symbol, count(ret) AS n, any_value(mean) AS mean, stddev_samp(ret) AS sd, avg(d * d * d) / nullif(pow(avg(d * d), 1.5), 0) AS skew, avg(d * d * d * d) / nullif(avg(d * d) * avg(d * d), 0) - 3 AS kurtosis,
        any_value(mean) / nullif(stddev_samp(ret), 0) AS sharpe FROM c GROUP BY symbol)"""


@query(f"WITH {MOMENTS} SELECT symbol, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(skew, 5) AS skew, round(kurtosis, 4) AS kurtosis, round(sharpe, 6) AS sharpe FROM mom")
def return_moments(t):
    return X.moments(feats(t), "ret", ["symbol"]).select("symbol", "n", *r("mean", "sd"), F.round("skew", 5).alias("skew"), F.round("kurtosis", 4).alias("kurtosis"), *r("sharpe"))


TRIALS = 20


@query(f"""
    WITH {MOMENTS}, spr AS (SELECT *, stddev_samp(sharpe) OVER () AS spread FROM mom),
    z AS (SELECT symbol, sharpe, (sharpe - spread * {X.expected_maximum(TRIALS)!r}::DOUBLE) * sqrt(n - 1) / nullif(sqrt(1 - skew * sharpe + (kurtosis + 2) / 4 * sharpe * sharpe), 0) AS z FROM spr),
    k AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS k FROM z),
    p AS (SELECT *, 1 - exp(-z * z / 2) / sqrt(2 * pi()) * k * (0.319381530::DOUBLE + k * (-0.356563782::DOUBLE + k * (1.781477937::DOUBLE + k * (-1.821255978::DOUBLE + k * 1.330274429::DOUBLE)))) AS p FROM k)
    SELECT symbol, round(sharpe, 6) AS sharpe, round(CASE WHEN z >= 0 THEN p ELSE 1 - p END, 6) AS dsr FROM p
""")
def deflated_sharpe(t):
    return X.deflated_sharpe(X.moments(feats(t), "ret", ["symbol"]), TRIALS).select("symbol", *r("sharpe", "dsr"))


@query("""
    WITH f AS (SELECT l_returnflag, l_extendedprice AS y, p_retailprice * l_quantity AS fit FROM lineitem JOIN part ON l_partkey = p_partkey),
    m AS (SELECT l_returnflag, avg(y) AS mean FROM f WHERE y IS NOT NULL AND fit IS NOT NULL GROUP BY 1)
    SELECT l_returnflag, round(1 - sum((y - fit) * (y - fit)) / nullif(sum((y - mean) * (y - mean)), 0), 6) AS r2 FROM f JOIN m USING (l_returnflag) WHERE y IS NOT NULL AND fit IS NOT NULL GROUP BY 1
""")
def reconstruction_r2(t):
    rows = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("p_retailprice") * F.col("l_quantity")).alias("fit"))
    return X.r_squared(rows, "y", "fit", ["l_returnflag"]).select("l_returnflag", *r("r2"))


@query("SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1")
def status_counts(t):
    return X.status_counts(t("orders"), "o_orderstatus", ["F", "O", "P"], ["o_orderpriority"])


BEST = "best AS (SELECT o_custkey AS study, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best_trial, max(o_totalprice) AS best_value, count(*) AS trials FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1)"


def best(t):
    return X.best_trials(t("orders").withColumnRenamed("o_custkey", "study"), "study", "o_orderkey", "o_totalprice")


@query(f"WITH {BEST} SELECT * FROM best")
def best_trials(t):
    return best(t)


@query(f"WITH {BEST} SELECT *, row_number() OVER (ORDER BY best_value ASC NULLS LAST, study) AS rank FROM best")
def objective_order(t):
    return X.by_objective(best(t), "low_cost", "study")


def _importance(p: str) -> str:
    return f"SELECT '{p}' AS parameter, {p}::VARCHAR AS level, count(*) AS n, avg(p_retailprice) AS mean FROM part GROUP BY 2"


@query(f"""
    WITH l AS ({_importance('p_size')} UNION ALL {_importance('p_brand')} UNION ALL {_importance('p_type')}), g AS (SELECT avg(p_retailprice) AS mean FROM part),
    w AS (SELECT sum((p_retailprice - mean) * (p_retailprice - mean)) AS total FROM part, g)
    SELECT parameter, round(sum(n * (l.mean - g.mean) * (l.mean - g.mean)) / nullif(any_value(total), 0), 6) AS importance FROM l, g, w GROUP BY 1
""")
def importances(t):
    return X.importances(t("part"), ["p_size", "p_brand", "p_type"], "p_retailprice").select("parameter", *r("importance"))


@query("SELECT p_partkey, p_size, p_brand, p_retailprice, (SELECT count(*) FROM part) > 500 AS capped FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 500")
def parallel_coordinates(t):
    return X.parallel_rows(t("part"), ["p_partkey", "p_size", "p_brand", "p_retailprice"], [F.desc("p_retailprice"), F.col("p_partkey")], 500)


CLUSTERED = ["ret", "gap", "roc10", "vol"]
_PAIRS = [(a, b) for i, a in enumerate(CLUSTERED) for b in CLUSTERED[i + 1 :]]


@query(f"""
    WITH RECURSIVE {FEATURES}, f AS (SELECT feat.*, pct.vol FROM feat JOIN pct USING (symbol, time)),
    c AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, {corr_sql(a, b)} AS c FROM f" for a, b in _PAIRS)}),
    e AS (SELECT a, b FROM c WHERE abs(c) >= 0.5 UNION ALL SELECT b, a FROM c WHERE abs(c) >= 0.5),
    n AS (SELECT unnest({CLUSTERED!r}) AS feature),
    reach(feature, root) AS (SELECT feature, feature FROM n UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.feature)
    SELECT feature, min(root) AS cluster FROM reach GROUP BY feature
""")
def feature_clusters(t):
    return X.feature_clusters(feats(t), CLUSTERED, 0.5)
