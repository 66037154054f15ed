"""Indicators and joins of series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import indicators as I
from tickloom.operators import joins as J
from tickloom.plans.registry import bars_sql, query
from tickloom.plans.select_queries import hour_bars

W = "OVER (PARTITION BY symbol ORDER BY time"


def fr(n: int) -> str:
    return f"{W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def rounded(df, *columns):
    return df.select("symbol", "time", *[F.round(c, 6).alias(c) for c in columns])


def ema_sql(name: str, source: str, column: str, alpha: str) -> str:
    """The recursive average in closed form: each value weighs (1 - alpha) ** age times alpha, the first without alpha."""
    return f"""{name}_x AS (SELECT symbol, time, {column} AS x, row_number() OVER (PARTITION BY symbol ORDER BY time) AS i FROM {source} WHERE {column} IS NOT NULL),
    {name} AS (SELECT a.symbol, a.time, sum((CASE WHEN b.i = 1 THEN 1 ELSE {alpha}::DOUBLE END) * b.x * pow(1 - {alpha}::DOUBLE, a.i - b.i)) AS y
        FROM {name}_x a JOIN {name}_x b ON a.symbol = b.symbol AND b.i <= a.i GROUP BY 1, 2)"""


@query(f"WITH {bars_sql()} SELECT symbol, time, round(CASE WHEN count(*) {fr(20)} = 20 THEN avg(close) {fr(20)} END, 6) AS sma FROM bars")
def sma20(t):
    return rounded(hour_bars(t).withColumn("sma", I.sma(F.col("close"), 20)), "sma")


@query(f"""
    WITH {bars_sql()}, s AS (SELECT *, CASE WHEN count(*) {fr(20)} = 20 THEN avg(close) {fr(20)} END AS m, CASE WHEN count(*) {fr(20)} = 20 THEN stddev_samp(close) {fr(20)} END AS d FROM bars)
    SELECT symbol, time, round(m, 6) AS mid, round(m + 2 * d, 6) AS upper, round(m - 2 * d, 6) AS lower FROM s
""")
def bollinger20(t):
    return rounded(I.bollinger(hour_bars(t)), "mid", "upper", "lower")


@query(f"WITH {bars_sql()} SELECT symbol, time, CASE WHEN count(*) {fr(20)} = 20 THEN max(high) {fr(20)} END AS channel_high, CASE WHEN count(*) {fr(20)} = 20 THEN min(low) {fr(20)} END AS channel_low FROM bars")
def donchian20(t):
    return I.donchian(hour_bars(t)).select("symbol", "time", "channel_high", "channel_low")


@query(f"""
    WITH {bars_sql()}, s AS (SELECT *, CASE WHEN count(*) {fr(14)} = 14 THEN (close - min(low) {fr(14)}) * 100 / nullif(max(high) {fr(14)} - min(low) {fr(14)}, 0) END AS k FROM bars)
    SELECT symbol, time, round(k, 6) AS k, round(CASE WHEN count(k) {fr(3)} = 3 THEN avg(k) {fr(3)} END, 6) AS d FROM s
""")
def stochastic14(t):
    return rounded(I.stochastic(hour_bars(t)), "k", "d")


@query(f"""
    WITH {bars_sql()}, s AS (SELECT *, lag(close) {W}) AS p, lag(close, 10) {W}) AS b FROM bars)
    SELECT symbol, time, round(close / nullif(p, 0) - 1, 6) AS ret, round(CASE WHEN close > 0 AND p > 0 THEN ln(close / p) END, 6) AS logret, round(close - b, 6) AS momentum,
           round((close / nullif(b, 0) - 1) * 100, 6) AS roc, round(greatest(high - low, abs(high - p), abs(low - p)), 6) AS true_range FROM s
""")
def returns(t):
    return rounded(I.returns(hour_bars(t)), "ret", "logret", "momentum", "roc", "true_range")


@query(f"""
    WITH {bars_sql()}, s AS (SELECT *, coalesce(sign(close - lag(close) {W})), 0) AS sg FROM bars)
    SELECT symbol, time, round(sum((high + low + close) / 3 * tick_volume) {W} ROWS UNBOUNDED PRECEDING) / sum(tick_volume) {W} ROWS UNBOUNDED PRECEDING), 6) AS vwap,
           CAST(sum(sg * tick_volume) {W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS obv FROM s
""")
def vwap_obv(t):
    return I.vwap(hour_bars(t)).select("symbol", "time", F.round("vwap", 6).alias("vwap"), "obv")


@query(f"WITH {bars_sql()}, {ema_sql('e', 'bars', 'close', '(2.0::DOUBLE / 11)')} SELECT symbol, time, round(y, 6) AS ema FROM e")
def ema10(t):
    return rounded(I.ema(hour_bars(t), "close", 10, "ema"), "ema")


@query(f"""
    WITH {bars_sql()}, {ema_sql('f', 'bars', 'close', '(2.0::DOUBLE / 13)')}, {ema_sql('s', 'bars', 'close', '(2.0::DOUBLE / 27)')},
    m AS (SELECT f.symbol, f.time, f.y - s.y AS macd FROM f JOIN s USING (symbol, time)), {ema_sql('g', 'm', 'macd', '(2.0::DOUBLE / 10)')}
    SELECT symbol, time, round(macd, 6) AS macd, round(y, 6) AS macd_signal FROM m JOIN g USING (symbol, time)
""")
def macd(t):
    return rounded(I.macd(hour_bars(t)), "macd", "macd_signal")


@query(f"""
    WITH {bars_sql()}, c AS (SELECT *, row_number() {W}) AS n, close - lag(close) {W}) AS ch FROM bars),
    d AS (SELECT *, greatest(ch, 0) AS gain, greatest(-ch, 0) AS loss FROM c WHERE ch IS NOT NULL),
    {ema_sql('g', 'd', 'gain', '(1.0::DOUBLE / 14)')}, {ema_sql('l', 'd', 'loss', '(1.0::DOUBLE / 14)')}
    SELECT c.symbol, c.time, round(CASE WHEN n > 14 THEN CASE WHEN g.y + l.y = 0 THEN 50 ELSE 100 * g.y / (g.y + l.y) END END, 6) AS rsi
    FROM c LEFT JOIN g USING (symbol, time) LEFT JOIN l USING (symbol, time)
""")
def rsi14(t):
    return rounded(I.rsi(hour_bars(t)), "rsi")


@query(f"""
    WITH {bars_sql()}, c AS (SELECT *, row_number() {W}) AS n, lag(close) {W}) AS p FROM bars),
    d AS (SELECT *, greatest(high - low, coalesce(abs(high - p), 0), coalesce(abs(low - p), 0)) AS tr FROM c), {ema_sql('e', 'd', 'tr', '(1.0::DOUBLE / 14)')}
    SELECT c.symbol, c.time, round(CASE WHEN n >= 14 THEN y END, 6) AS atr FROM c JOIN e USING (symbol, time)
""")
def atr14(t):
    return rounded(I.atr(hour_bars(t)), "atr")


@query(f"""
    WITH {bars_sql()} SELECT symbol, time, round(CASE WHEN count(*) {fr(20)} = 20 THEN covar_samp(close, tick_volume) {fr(20)} / nullif(stddev_samp(close) {fr(20)} * stddev_samp(tick_volume) {fr(20)}, 0) END, 6) AS corr FROM bars
""")
def corr20(t):
    return rounded(hour_bars(t).withColumn("corr", I.rolling_corr(F.col("close"), F.col("tick_volume").cast("double"), 20)), "corr")


VOL = f"""lr AS (SELECT *, CASE WHEN close > 0 AND lag(close) {W}) > 0 THEN ln(close / lag(close) {W})) END AS logret FROM bars),
    vol AS (SELECT *, CASE WHEN count(logret) {fr(20)} = 20 THEN stddev_samp(logret) {fr(20)} END AS vol FROM lr)"""


@query(f"WITH {bars_sql()}, {VOL} SELECT symbol, time, round(vol, 6) AS vol FROM vol")
def vol20(t):
    return rounded(I.volatility(hour_bars(t)), "vol")


#: Volatilities are compared, so they are rounded before, to differ alike in both engines.
REGIME = f"""{VOL}, v AS (SELECT symbol, time, close, round(vol, 9) AS vol, row_number() {W}) AS i FROM vol),
    pct AS (SELECT a.symbol, a.time, any_value(a.close) AS close, any_value(a.i) AS i, any_value(a.vol) AS vol, CASE WHEN any_value(a.vol) IS NOT NULL THEN count(*) FILTER (b.vol <= a.vol) / count(b.vol)::DOUBLE END AS vol_pct
        FROM v a JOIN v b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 99 AND a.i GROUP BY 1, 2)"""


@query(f"WITH {bars_sql()}, {REGIME} SELECT symbol, time, round(vol_pct, 6) AS vol_pct, CASE WHEN vol_pct >= 0.8 THEN 'high' WHEN vol_pct IS NOT NULL THEN 'low' END AS regime FROM pct")
def vol_regime(t):
    return I.volatility_regime(hour_bars(t)).select("symbol", "time", F.round("vol_pct", 6).alias("vol_pct"), "regime")


@query(f"WITH {bars_sql()} SELECT symbol, time, round(lead(close, 5) {W}) / nullif(close, 0) - 1, 6) AS target FROM bars")
def forward_target5(t):
    return rounded(I.forward_target(hour_bars(t), 5), "target")


CROSS = f"""a AS (SELECT *, round(CASE WHEN count(*) {fr(5)} = 5 THEN avg(close) {fr(5)} END, 9) AS fast, round(CASE WHEN count(*) {fr(20)} = 20 THEN avg(close) {fr(20)} END, 9) AS slow FROM bars),
    b AS (SELECT *, sign(fast - slow) AS side FROM a), c AS (SELECT *, lag(side) {W}) AS before FROM b),
    x AS (SELECT *, CASE WHEN side > 0 AND before <= 0 THEN 1 WHEN side < 0 AND before >= 0 THEN -1 ELSE 0 END AS signal, lead(time) {W}) AS entry_time, lead(open) {W}) AS entry_price FROM c)"""


@query(f"WITH {bars_sql()}, {CROSS} SELECT symbol, time, signal, entry_time, entry_price FROM x WHERE signal <> 0")
def crossover_entries(t):
    return I.crossover(hour_bars(t)).where("signal <> 0").select("symbol", "time", "signal", "entry_time", "entry_price")


@query("""
    WITH c AS (SELECT user_id, ts, event_id AS id, value FROM events WHERE event_type = 'click'), v AS (SELECT user_id, ts, value AS view_value FROM events WHERE event_type = 'view')
    SELECT c.user_id, c.ts, c.id, c.value, v.view_value FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts
""")
def asof_view_for_click(t):
    e = t("events")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("id"), "value")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("id2"), F.col("value").alias("view_value"))
    return J.asof_join(clicks, views, ["user_id"], "ts", ["view_value"], tiebreak="id2")


@query(f"""
    WITH {bars_sql()}, {bars_sql('day', 'days')}, x AS (SELECT symbol, time, lag(close, 1) OVER (PARTITION BY symbol ORDER BY time) AS day_close FROM days)
    SELECT b.symbol, b.time, b.close, x.day_close FROM bars b ASOF LEFT JOIN x ON b.symbol = x.symbol AND b.time >= x.time
""")
def exogenous_alignment(t):
    from tickloom.operators import bars as B

    bars = hour_bars(t)
    days = B.resample(bars, "day").select("symbol", "time", F.col("close").alias("day_close"))
    return J.align_exogenous(bars.select("symbol", "time", "close"), days, ["symbol"], "time", ["day_close"], lag=1)


@query("""
    SELECT l_orderkey, l_linenumber, o_custkey, c_name, n_name, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity >= 45
""")
def order_lineage(t):
    """Fills (lines) to orders to accounts (customers) to venues (nations)."""
    lines = t("lineitem").where("l_quantity >= 45").select("l_orderkey", "l_linenumber", "l_extendedprice")
    joined = lines.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    joined = joined.join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey"), "o_custkey", "left")
    return joined.join(t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "left").select("l_orderkey", "l_linenumber", "o_custkey", "c_name", "n_name", "l_extendedprice")


@query("""
    SELECT o.o_orderkey AS entry_id, o.o_custkey AS account, l.l_extendedprice AS fill_amount FROM orders o
    LEFT JOIN lineitem l ON l.l_orderkey = (CASE WHEN o.o_orderstatus = 'F' THEN o.o_orderkey END) AND l.l_linenumber = 1
""")
def ledger_fill(t):
    """Ledger entries with the fill they name; entries without one stay, with nulls."""
    entries = t("orders").select(F.col("o_orderkey").alias("entry_id"), F.col("o_custkey").alias("account"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("fill_id"))
    fills = t("lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("fill_id"), F.col("l_extendedprice").alias("fill_amount"))
    return entries.join(fills, "fill_id", "left").select("entry_id", "account", "fill_amount")


@query("SELECT l_orderkey AS order_ticket, l_linenumber AS deal, o_totalprice, l_extendedprice AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def deal_orders(t):
    deals = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("order_ticket"), F.col("l_linenumber").alias("deal"), F.col("l_extendedprice").alias("price"))
    return deals.join(t("orders").select(F.col("o_orderkey").alias("order_ticket"), "o_totalprice"), "order_ticket").select("order_ticket", "deal", "o_totalprice", "price")


@query("""
    SELECT p.user_id, p.event_id AS deal_id, i.event_id AS intent_id FROM events p JOIN events i ON p.user_id = i.user_id AND p.ts >= i.ts AND p.ts < i.ts + INTERVAL 6 HOUR
    WHERE p.event_type = 'purchase' AND i.event_type = 'click'
""")
def intent_window(t):
    e = t("events")
    deals = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("deal_ts"), F.col("event_id").alias("deal_id"))
    intents = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("end"), F.col("event_id").alias("intent_id"))
    return J.interval_join(deals, intents, ["user_id"], "deal_ts", "start", "end", 6 * 3600).select("user_id", "deal_id", "intent_id")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)")
def missing_parts(t):
    sold = t("lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return J.not_found(t("part").select("p_partkey"), sold, "p_partkey")


@query("""
    SELECT p_partkey, p_size, p_retailprice FROM part p WHERE NOT EXISTS (
        SELECT 1 FROM part o WHERE o.p_size >= p.p_size AND o.p_retailprice <= p.p_retailprice AND (o.p_size > p.p_size OR o.p_retailprice < p.p_retailprice))
""")
def pareto_parts(t):
    return J.pareto_front(t("part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", ["p_size"], ["p_retailprice"])


@query("""
    WITH a AS (SELECT o_custkey AS seed, sum(o_totalprice) AS v FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), b AS (SELECT o_custkey AS seed, sum(o_totalprice) AS v FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1)
    SELECT coalesce(a.seed, b.seed) AS seed, round(a.v, 6) AS a, round(b.v, 6) AS b, round(b.v - a.v, 6) AS delta, CASE WHEN a.seed IS NULL THEN 'missing_a' WHEN b.seed IS NULL THEN 'missing_b' WHEN a.v IS NULL OR b.v IS NULL THEN 'null_value' END AS dropped
    FROM a FULL JOIN b ON a.seed = b.seed
""")
def paired_runs(t):
    side = lambda p: t("orders").where(F.col("o_orderpriority") == p).groupBy(F.col("o_custkey").alias("seed")).agg(F.sum("o_totalprice").alias("v"))
    return J.paired_runs(side("1-URGENT"), side("2-HIGH"), "seed", "v").select("seed", *[F.round(c, 6).alias(c) for c in ("a", "b", "delta")], "dropped")


@query("""
    WITH ours AS (SELECT l_partkey AS ticket, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), theirs AS (SELECT l_partkey AS ticket, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag <> 'A' AND l_partkey % 3 <> 0 GROUP BY 1)
    SELECT coalesce(o.ticket, t.ticket) AS ticket, o.q AS ours, t.q AS theirs, CASE WHEN t.ticket IS NULL THEN 'only_ours' WHEN o.ticket IS NULL THEN 'only_theirs' WHEN o.q IS NOT DISTINCT FROM t.q THEN 'match' ELSE 'differs' END AS status
    FROM ours o FULL JOIN theirs t ON o.ticket = t.ticket
""")
def reconcile_positions(t):
    lines = t("lineitem").withColumnRenamed("l_partkey", "ticket")
    ours = lines.where("l_linestatus = 'O'").groupBy("ticket").agg(F.sum("l_quantity").alias("q"))
    theirs = lines.where("l_returnflag <> 'A' AND ticket % 3 <> 0").groupBy("ticket").agg(F.sum("l_quantity").alias("q"))
    return J.reconcile(ours, theirs, "ticket", "q")
