"""Simulation, ledgers and walk-forward evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions.expressions import round_scaled
from tickloom.operators import features as X
from tickloom.operators import indicators as I
from tickloom.operators import simulation as S
from tickloom.operators import walkforward as WF
from tickloom.plans.feature_queries import r
from tickloom.plans.indicator_queries import CROSS, VOL, W
from tickloom.plans.registry import bars_sql, query
from tickloom.plans.select_queries import hour_bars, ticks

EXITS = S.Exits(hold=24, stop=0.3, target=0.5)
TRAIL = S.Exits(hold=24, stop=None, target=None, trail=0.25)


def signals_and_bars(t):
    bars = S.numbered(I.crossover(hour_bars(t)))
    return bars.where("signal = 1").select("symbol", "i"), bars


def all_trades(t, exits: S.Exits = EXITS):
    signals, bars = signals_and_bars(t)
    return S.candidate_trades(bars, signals, exits)


def trades_sql(stop: str, fixed: str, target: str, hold: int = 24, first: str = "") -> str:
    """Candidate trades in SQL; stop may use e (entry price) and pk (peak before), fixed is the fixed stop alone."""
    return f"""{bars_sql()}, {CROSS}, nb AS (SELECT *, row_number() {W}) AS i FROM x){first},
    path AS (SELECT s.symbol, s.i AS s, b0.open AS e, b0.time AS entry_time, b.i - s.i AS k, b.i, b.time, b.open, b.high, b.low, b.close
        FROM nb s JOIN nb b0 ON b0.symbol = s.symbol AND b0.i = s.i + 1 JOIN nb b ON b.symbol = s.symbol AND b.i BETWEEN s.i + 1 AND s.i + {hold} WHERE s.signal = 1),
    pk AS (SELECT *, greatest(e, coalesce(max(high) OVER (PARTITION BY symbol, s ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), e)) AS pk, max(k) OVER (PARTITION BY symbol, s) AS last_k FROM path),
    lv AS (SELECT *, {stop} AS stop, {fixed} AS fixed, {target} AS target FROM pk),
    hit AS (SELECT *, CASE WHEN low <= stop THEN CASE WHEN stop > fixed THEN 'trail' ELSE 'stop' END WHEN high >= target THEN 'target' WHEN k = {hold} THEN 'time' WHEN k = last_k THEN 'end' END AS reason,
        max(high) OVER (PARTITION BY symbol, s ORDER BY k ROWS UNBOUNDED PRECEDING) AS top, min(low) OVER (PARTITION BY symbol, s ORDER BY k ROWS UNBOUNDED PRECEDING) AS bottom FROM lv),
    trades AS (SELECT symbol, s, entry_time, e AS entry_price, i AS exit_i, time AS exit_time, reason, top / nullif(e, 0) - 1 AS mfe, 1 - bottom / nullif(e, 0) AS mae,
        CASE WHEN reason IN ('stop', 'trail') THEN least(open, stop) WHEN reason = 'target' THEN greatest(open, target) ELSE close END AS exit_price
        FROM hit WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, s ORDER BY k) = 1)"""


FIXED_SQL = trades_sql("e * (1 - 0.3::DOUBLE)", "e * (1 - 0.3::DOUBLE)", "e * (1 + 0.5::DOUBLE)")
TRAIL_SQL = trades_sql("pk * (1 - 0.25::DOUBLE)", "-1.0", "NULL::DOUBLE")
#: Greedy choice by following each trade to the first signal from its exit bar on.
TAKEN_SQL = """nxt AS (SELECT a.symbol, a.s, min(b.s) AS n FROM trades a LEFT JOIN trades b ON a.symbol = b.symbol AND b.s >= a.exit_i AND b.s > a.s GROUP BY 1, 2),
    chain AS (SELECT symbol, min(s) AS s FROM trades GROUP BY 1 UNION ALL SELECT c.symbol, x.n FROM chain c JOIN nxt x ON c.symbol = x.symbol AND c.s = x.s WHERE x.n IS NOT NULL),
    taken AS (SELECT t.* FROM trades t JOIN chain c ON t.symbol = c.symbol AND t.s = c.s)"""
PNL_SQL = """pnl AS (SELECT *, (exit_price * (1 + -1 * 5.0::DOUBLE / 10000) - entry_price * (1 + 1 * 5.0::DOUBLE / 10000)) * 2
        - (entry_price * (1 + 1 * 5.0::DOUBLE / 10000) * 2 * 10.0::DOUBLE / 10000 + 2 * 0.05::DOUBLE + exit_price * (1 + -1 * 5.0::DOUBLE / 10000) * 2 * 10.0::DOUBLE / 10000 + 2 * 0.05::DOUBLE) AS pnl FROM taken),
    ret AS (SELECT *, pnl / nullif(entry_price * 2, 0) AS ret FROM pnl)"""


def taken(t):
    return S.with_pnl(S.one_at_a_time(all_trades(t)), quantity=2.0, slippage_bps=5.0, bps=10.0, per_contract=0.05)


@query(f"WITH {FIXED_SQL} SELECT symbol, entry_time, entry_price, exit_time, round(exit_price, 6) AS exit_price, reason FROM trades")
def stop_target_exits(t):
    return all_trades(t).select("symbol", "entry_time", "entry_price", "exit_time", *r("exit_price"), "reason")


@query(f"WITH {TRAIL_SQL} SELECT symbol, entry_time, entry_price, exit_time, round(exit_price, 6) AS exit_price, reason FROM trades")
def trailing_stop(t):
    return all_trades(t, TRAIL).select("symbol", "entry_time", "entry_price", "exit_time", *r("exit_price"), "reason")


@query(f"WITH RECURSIVE {FIXED_SQL}, {TAKEN_SQL}, {PNL_SQL} SELECT symbol, entry_time, exit_time, reason, round(pnl, 6) AS pnl, round(ret, 6) AS ret FROM ret")
def candle_backtest(t):
    return taken(t).select("symbol", "entry_time", "exit_time", "reason", *r("pnl", "ret"))


TICK_BARS = "tb AS (SELECT event_type AS symbol, ts AS time, value AS open, value AS high, value AS low, value AS close, 1 AS tick_volume FROM events WHERE value IS NOT NULL)"


@query(f"WITH {FIXED_SQL.replace(bars_sql(), TICK_BARS + ', bars AS (SELECT * FROM tb)')} SELECT symbol, entry_time, entry_price, exit_time, round(exit_price, 6) AS exit_price, reason FROM trades")
def tick_backtest(t):
    """The same kernel on ticks: each is a bar of its own."""
    p = F.col("price")
    bars = ticks(t).where("price IS NOT NULL").select("symbol", "id", F.col("ts").alias("time"), p.alias("open"), p.alias("high"), p.alias("low"), p.alias("close"), F.lit(1).alias("tick_volume"))
    bars = I.numbered_by_day(bars, "id")
    signals = I.by_chunks(bars, I.crossover, before=24).where("signal = 1").select("symbol", "i")
    trades = S.candidate_trades(bars, signals, EXITS)
    return trades.select("symbol", "entry_time", "entry_price", "exit_time", *r("exit_price"), "reason")


@query(f"WITH {bars_sql()}, {CROSS} SELECT symbol, time, round(entry_price * (1 + signal * 5.0::DOUBLE / 10000), 6) AS fill_price FROM x WHERE signal <> 0 AND entry_price IS NOT NULL")
def fills(t):
    s = I.crossover(hour_bars(t)).where("signal <> 0 AND entry_price IS NOT NULL")
    return s.select("symbol", "time", round_scaled(S.fill_price(F.col("entry_price"), F.col("signal"), 5.0), 6).alias("fill_price"))


@query("SELECT l_orderkey, l_linenumber, round(abs(l_extendedprice) * 2.5::DOUBLE / 10000 + abs(l_quantity) * 0.35::DOUBLE, 8) AS cost FROM lineitem")
def transaction_costs(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(S.costs(F.col("l_extendedprice"), F.col("l_quantity"), 2.5, 0.35), 8).alias("cost"))


CURVE_SQL = """e AS (SELECT *, 1000 + sum(pnl) OVER (PARTITION BY symbol ORDER BY s ROWS UNBOUNDED PRECEDING) AS equity FROM ret),
    curve AS (SELECT *, greatest(1000, max(equity) OVER (PARTITION BY symbol ORDER BY s ROWS UNBOUNDED PRECEDING)) AS peak FROM e)"""


@query(f"""
    WITH RECURSIVE {FIXED_SQL}, {TAKEN_SQL}, {PNL_SQL}, {CURVE_SQL}
    SELECT symbol, count(*) AS trades, round(sum(pnl), 6) AS total, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, round(sum(greatest(pnl, 0)) / nullif(sum(greatest(-pnl, 0)), 0), 6) AS profit_factor,
           round(avg(ret) / nullif(stddev_samp(ret), 0), 6) AS sharpe, round(max(1 - equity / nullif(peak, 0)), 6) AS max_drawdown FROM curve GROUP BY symbol
""")
def performance(t):
    return S.performance(taken(t), "symbol", ["s"], 1000.0).select("symbol", "trades", *r("total", "win_rate", "profit_factor", "sharpe", "max_drawdown"))


@query(f"WITH RECURSIVE {FIXED_SQL}, {TAKEN_SQL}, {PNL_SQL}, {CURVE_SQL} SELECT symbol, exit_time, round(equity, 6) AS equity, round(peak, 6) AS peak, round(1 - equity / nullif(peak, 0), 6) AS drawdown FROM curve")
def drawdown(t):
    return S.equity_curve(taken(t), "symbol", ["s"], 1000.0).select("symbol", "exit_time", *r("equity", "peak", "drawdown"))


@query(f"WITH {FIXED_SQL}, kept AS (SELECT *, exit_price / nullif(entry_price, 0) - 1 AS r FROM trades) SELECT symbol, entry_time, round(mfe, 6) AS mfe, round(mae, 6) AS mae, round(r / nullif(mfe, 0), 6) AS capture, round(mfe - r, 6) AS giveback FROM kept")
def excursions(t):
    return S.excursions(all_trades(t)).select("symbol", "entry_time", *r("mfe", "mae", "capture", "giveback"))


@query(f"""
    WITH {bars_sql()}, {CROSS}, n AS (SELECT *, row_number() {W}) AS i, lag(high) {W}) AS ph FROM x),
    s AS (SELECT symbol, i, 0 AS source FROM n WHERE signal = 1 UNION ALL SELECT symbol, i, 1 FROM n WHERE close > ph)
    SELECT symbol, i, min(source) AS source FROM s GROUP BY 1, 2
""")
def multi_entry(t):
    signals, bars = signals_and_bars(t)
    breakout = bars.withColumn("ph", F.lag("high").over(I.series())).where("close > ph").select("symbol", "i")
    return S.first_by_priority([signals, breakout])


@query(f"WITH {bars_sql()} SELECT symbol, time, round(3.0::DOUBLE * (close / nullif(high, 0)), 6) AS size FROM bars")
def fixed_size(t):
    return hour_bars(t).select("symbol", "time", F.round(S.fixed_size(F.try_divide("close", "high"), 3.0), 6).alias("size"))


@query("SELECT c_custkey, CAST(greatest(0, least(20, floor(c_acctbal / 750.0::DOUBLE))) AS BIGINT) AS size FROM customer")
def margin_size(t):
    return t("customer").select("c_custkey", S.margin_size(F.col("c_acctbal"), 750.0, 0, 20).alias("size"))


@query(f"WITH {bars_sql()}, {VOL} SELECT symbol, time, round(CASE WHEN vol = 0 THEN 5 WHEN vol IS NOT NULL THEN greatest(0.1::DOUBLE, least(5::DOUBLE, 0.5::DOUBLE / vol)) END, 6) AS size FROM vol")
def invvol_size(t):
    return I.volatility(hour_bars(t)).select("symbol", "time", F.round(S.inverse_volatility_size(F.col("vol"), 0.5, 0.1, 5.0), 6).alias("size"))


@query("""
    SELECT o_custkey, o_orderkey, CAST(CAST(1000 AS DECIMAL(38, 2)) + sum(CAST(printf('%.2f', CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END) AS DECIMAL(18, 2)))
        OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS balance_after FROM orders
""")
def running_balance(t):
    signed = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    entries = t("orders").withColumn("amount", F.format_string("%.2f", signed).cast("decimal(18,2)"))
    out = S.ledger(entries, "o_custkey", ["o_orderdate", "o_orderkey"], "amount", F.lit(1000).cast("decimal(20,2)"))
    return out.select("o_custkey", "o_orderkey", F.col("balance_after").cast("decimal(38,2)").cast("string").alias("balance_after"))


@query("SELECT o_custkey AS account, CAST(CAST(1000 AS DECIMAL(38, 2)) + sum(CAST(printf('%.2f', o_totalprice) AS DECIMAL(18, 2))) AS VARCHAR) AS balance FROM orders GROUP BY 1")
def account_balance(t):
    amount = F.format_string("%.2f", "o_totalprice").cast("decimal(18,2)")
    return t("orders").groupBy(F.col("o_custkey").alias("account")).agg((F.lit(1000).cast("decimal(20,2)") + F.sum(amount)).cast("decimal(38,2)").cast("string").alias("balance"))


_FILL0 = "{'q': 0.0::DOUBLE, 'a': 0.0::DOUBLE, 'r': 0.0::DOUBLE, 'o': NULL::TIMESTAMP, 'c': NULL::TIMESTAMP, 'dq': 0.0::DOUBLE, 'p': 0.0::DOUBLE, 't': NULL::TIMESTAMP}"
_TIMES = """'o': CASE WHEN s.q + y.dq <> 0 AND s.q * (s.q + y.dq) <= 0 THEN y.t ELSE s.o END, 'c': CASE WHEN s.q + y.dq <> 0 THEN NULL WHEN s.q <> 0 THEN y.t ELSE s.c END, 'dq': 0.0::DOUBLE, 'p': 0.0::DOUBLE, 't': NULL::TIMESTAMP"""


@query(f"""
    WITH f AS (SELECT o_custkey AS account, o_orderkey AS n, o_orderdate AS t, (CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END) * (1 + o_orderkey % 5)::DOUBLE AS dq, o_totalprice AS p FROM orders WHERE o_totalprice IS NOT NULL AND o_orderkey IS NOT NULL),
    l AS (SELECT account, count(*) AS fills, list_prepend({_FILL0}, list({{'q': 0.0::DOUBLE, 'a': 0.0::DOUBLE, 'r': 0.0::DOUBLE, 'o': NULL::TIMESTAMP, 'c': NULL::TIMESTAMP, 'dq': dq, 'p': p, 't': t::TIMESTAMP}} ORDER BY n)) AS x FROM f GROUP BY 1),
    d AS (SELECT account, fills, list_reduce(x, lambda s, y: CASE WHEN s.q * y.dq >= 0
            THEN {{'q': s.q + y.dq, 'a': CASE WHEN s.q + y.dq = 0 THEN 0 ELSE (s.q * s.a + y.dq * y.p) / (s.q + y.dq) END, 'r': s.r, {_TIMES}}}
            ELSE {{'q': s.q + y.dq, 'a': CASE WHEN (s.q + y.dq) * s.q > 0 THEN s.a WHEN s.q + y.dq <> 0 THEN y.p ELSE 0 END, 'r': s.r + least(abs(s.q), abs(y.dq)) * sign(s.q) * (y.p - s.a), {_TIMES}}} END) AS z FROM l)
    SELECT account, z.q AS quantity, round(z.a, 6) AS average, round(z.r, 6) AS realized, fills, z.q <> 0 AS is_open, z.o AS opened_at, z.c AS closed_at FROM d
""")
def positions(t):
    k = F.col("o_orderkey")
    f = t("orders").select(F.col("o_custkey").alias("account"), k.alias("n"), F.col("o_orderdate").alias("time"), (F.when(k % 3 == 0, -1).otherwise(1) * (1 + k % 5)).cast("double").alias("quantity"), F.col("o_totalprice").alias("price"))
    return S.positions(f).select("account", "quantity", *r("average", "realized"), "fills", "is_open", "opened_at", "closed_at")


WIN = """bounds AS (SELECT CAST(date_trunc('day', min(ts)) AS TIMESTAMP) AS s, CAST(date_trunc('day', max(ts)) AS TIMESTAMP) + INTERVAL 1 DAY AS e FROM events),
    st AS (SELECT unnest(generate_series(s, e - INTERVAL 14 DAY, INTERVAL 4 DAY)) AS train_start FROM bounds),
    win AS (SELECT row_number() OVER (ORDER BY train_start) - 1 AS index, train_start, train_start + INTERVAL 10 DAY AS train_end, train_start + INTERVAL 10 DAY AS test_start, train_start + INTERVAL 14 DAY AS test_end FROM st)"""


def wf_windows(t):
    day = lambda c: F.date_trunc("day", c).cast("timestamp_ntz")
    bounds = t("events").agg(day(F.min("ts")).alias("start"), (day(F.max("ts")) + F.expr("INTERVAL 1 DAY")).alias("end"))
    return WF.windows(bounds, 10, 4, 4)


@query(f"WITH {WIN} SELECT * FROM win")
def walkforward_windows(t):
    return wf_windows(t)


PARTS = """parts AS (SELECT index, 'train' AS part, train_start AS a, train_end AS b FROM win UNION ALL SELECT index, 'test', test_start, test_end FROM win)"""


@query(f"""
    WITH RECURSIVE {FIXED_SQL}, {TAKEN_SQL}, {PNL_SQL}, {WIN}, {PARTS}, z AS (SELECT r.symbol, r.ret, p.index, p.part FROM ret r JOIN parts p ON r.entry_time >= p.a AND r.entry_time < p.b),
    w AS (SELECT symbol, avg(ret) FILTER (part = 'train') AS i, avg(ret) FILTER (part = 'test') AS o, count(DISTINCT index) FILTER (part = 'test') AS n_windows FROM z GROUP BY 1)
    SELECT symbol, round(i, 6) AS in_sample, round(o, 6) AS out_of_sample, n_windows, round(o / nullif(i, 0), 6) AS efficiency FROM w
""")
def wf_summary(t):
    parts = WF.split(taken(t), "entry_time", wf_windows(t))
    return WF.efficiency(parts, ["symbol"], "ret").select("symbol", *r("in_sample", "out_of_sample"), "n_windows", *r("efficiency"))


@query("SELECT event_id, ts > (SELECT max(ts) FROM events) - INTERVAL 5 DAY AS locked FROM events")
def lockbox_days(t):
    return WF.lockbox(t("events").select("event_id", "ts"), "ts", days=5).select("event_id", "locked")


@query("""
    WITH e AS (SELECT min(ts) AS a, max(ts) AS b FROM events)
    SELECT event_id, ts > b - to_seconds(CAST(floor(datesub('second', a, b) * 0.2::DOUBLE) AS BIGINT)) AS locked FROM events, e
""")
def lockbox_pct(t):
    return WF.lockbox(t("events").select("event_id", "ts"), "ts", pct=0.2).select("event_id", "locked")


@query("""
    WITH c AS (SELECT o_custkey, count(*) AS trades, count(DISTINCT date_trunc('year', o_orderdate)) AS n_windows, avg(o_totalprice) FILTER (o_orderstatus = 'O') / nullif(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 0) AS efficiency FROM orders GROUP BY 1)
    SELECT o_custkey, list_sort(list_filter([CASE WHEN trades < 8 THEN 'too_few_trades' END, CASE WHEN n_windows < 5 THEN 'too_few_windows' END, CASE WHEN efficiency IS NULL OR efficiency < 0.6 OR efficiency > 1.5 THEN 'efficiency_out_of_band' END], lambda x: x IS NOT NULL)) AS flags,
           trades >= 8 AND n_windows >= 5 AND efficiency IS NOT NULL AND efficiency BETWEEN 0.6 AND 1.5 AS passed FROM c
""")
def gates(t):
    part = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    rows = t("orders").groupBy("o_custkey").agg(F.count("*").alias("trades"), F.count_distinct(F.date_trunc("year", "o_orderdate")).alias("n_windows"), F.try_divide(part("O"), part("F")).alias("efficiency"))
    return WF.gate_flags(rows, WF.Gates(8, 5, (0.6, 1.5))).select("o_custkey", "flags", "passed")


@query("""
    SELECT p_brand AS brand, CAST(f AS INTEGER) AS fast, round(s, 9) AS stop, round(0.001::DOUBLE * pow(100, l / 4), 9) AS rate
    FROM (SELECT DISTINCT p_brand FROM part), unnest(generate_series(5, 20, 5)) AS a(f), (SELECT 0.1::DOUBLE + i * 0.05::DOUBLE AS s FROM unnest(generate_series(0, 3)) AS q(i)), unnest(generate_series(0, 4)) AS b(l)
""")
def param_grid(t):
    """The grid of three numeric axes for each brand, the categorical axis read from the data."""
    space = {"fast": {"low": 5, "high": 20, "step": 5}, "stop": {"low": 0.1, "high": 0.25, "step": 0.05}, "rate": {"low": 0.001, "high": 0.1, "n": 5, "log": True}}
    brands = t("part").select(F.col("p_brand").alias("brand")).distinct()
    return brands.crossJoin(F.broadcast(WF.grid(brands.sparkSession, space)))  # the grid's size is fixed by its axes


PRESETS = [{"preset": "tight", "stop": 0.1, "target": 0.2}, {"preset": "wide", "stop": 0.3, "target": 0.6}]


@query("""
    SELECT p_brand AS brand, preset, stop, target FROM (SELECT DISTINCT p_brand FROM part), (VALUES ('tight', 0.1::DOUBLE, 0.2::DOUBLE), ('wide', 0.3::DOUBLE, 0.6::DOUBLE), ('baseline', NULL, NULL)) AS v(preset, stop, target)
""")
def exit_presets(t):
    return WF.presets(t("part").select(F.col("p_brand").alias("brand")).distinct(), PRESETS, baseline=True)


SPACE = {"stop": {"low": 0.1, "high": 0.3, "step": 0.1}, "target": {"choices": [0.2, 0.4, 0.6]}}
_GRID_SQL = trades_sql("e * (1 - stop_x)", "e * (1 - stop_x)", "e * (1 + target_x)", first="""
    , gr AS (SELECT round(0.1::DOUBLE + i * 0.1::DOUBLE, 9) AS stop_x, target_x FROM unnest(generate_series(0, 2)) AS a(i), (VALUES (0.2::DOUBLE), (0.4::DOUBLE), (0.6::DOUBLE)) AS b(target_x))""")
# each signal's path once for each point of the grid
_GRID_SQL = _GRID_SQL.replace("SELECT s.symbol, s.i AS s,", "SELECT gr.stop_x, gr.target_x, s.symbol, s.i AS s,").replace("WHERE s.signal = 1)", "CROSS JOIN gr WHERE s.signal = 1)")
_GRID_SQL = _GRID_SQL.replace("PARTITION BY symbol, s", "PARTITION BY symbol, s, stop_x, target_x").replace("trades AS (SELECT symbol, s,", "trades AS (SELECT stop_x, target_x, symbol, s,")


@query(f"""
    WITH {_GRID_SQL}, {WIN}, {PARTS},
    z AS (SELECT p.index, p.part, a.stop_x, a.target_x, avg(exit_price / nullif(entry_price, 0) - 1) AS score, count(*) AS n FROM trades a JOIN parts p ON a.entry_time >= p.a AND a.entry_time < p.b GROUP BY 1, 2, 3, 4),
    best AS (SELECT * FROM z WHERE part = 'train' QUALIFY row_number() OVER (PARTITION BY index ORDER BY round(score, 9) DESC, stop_x, target_x) = 1),
    j AS (SELECT b.index, b.stop_x, b.target_x, b.score AS i, t.score AS o, coalesce(t.n, 0) AS trades FROM best b LEFT JOIN z t ON t.index = b.index AND t.stop_x = b.stop_x AND t.target_x = b.target_x AND t.part = 'test'),
    f AS (SELECT *, round(o / nullif(i, 0), 6) AS e FROM j)
    SELECT index, stop_x AS stop, target_x AS target, round(i, 6) AS in_sample, round(o, 6) AS out_of_sample, trades, e AS efficiency,
           list_sort(list_filter([CASE WHEN trades < 20 THEN 'too_few_trades' END, CASE WHEN e IS NULL OR e < 0.5 OR e > 2 THEN 'efficiency_out_of_band' END], lambda x: x IS NOT NULL)) AS flags FROM f
""")
def walkforward_search(t):
    """Walk-forward search over a grid of exits: the best point in training of each window, what it does in the test, and
    the gates it fails. Bars and signals are made once; each signal meets the whole grid."""
    signals, bars = signals_and_bars(t)
    points = WF.grid(bars.sparkSession, SPACE)  # its size is fixed by its axes
    trades = S.candidate_trades(bars, signals.crossJoin(F.broadcast(points)), S.Exits(24), ("stop", "target")).withColumn("ret", F.try_divide("exit_price", "entry_price") - 1)
    z = WF.split(trades, "entry_time", wf_windows(t)).groupBy("index", "part", "stop", "target").agg(F.avg("ret").alias("score"), F.count("*").alias("n"))
    # a row for each window and point: the test's figures ride along with the training's
    part = lambda p, c: F.max(F.when(F.col("part") == p, F.col(c)))
    both = z.groupBy("index", "stop", "target").agg(part("train", "score").alias("in_sample"), part("test", "score").alias("out_of_sample"), F.coalesce(part("test", "n"), F.lit(0)).alias("trades"))
    w = Window.partitionBy("index").orderBy(F.desc(F.round("in_sample", 9)), "stop", "target")
    best = both.where("in_sample IS NOT NULL").withColumn("place", F.row_number().over(w)).where("place = 1")
    judged = best.withColumns({"efficiency": F.round(F.try_divide("out_of_sample", "in_sample"), 6), "n_windows": F.lit(1)})
    return WF.gate_flags(judged, WF.Gates(20, 1, (0.5, 2.0))).select("index", "stop", "target", *r("in_sample", "out_of_sample"), "trades", "efficiency", "flags")


@query("WITH s AS (SELECT symbol, score FROM (SELECT event_type AS symbol, round(avg(value), 6) AS score FROM events GROUP BY 1)) SELECT *, row_number() OVER (ORDER BY score DESC, symbol) AS rank FROM s")
def candidate_rank(t):
    s = ticks(t).groupBy("symbol").agg(F.round(F.avg("price"), 6).alias("score"))
    return X.ranked(s, [F.desc("score"), F.col("symbol")])
