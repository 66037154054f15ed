"""Slices, filters, pages, rounding and listings: everything that keeps the rows' grain."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.expressions import money, ratio, to_step, to_tick


def slice_series(rows: DataFrame, symbols: list[str], start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows of the symbols in [start, end): both conditions reach the Parquet scan."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return rows.where(F.col("symbol").isin(symbols) & (F.col(ts) >= at(start)) & (F.col(ts) < at(end)))


def session_filter(rows: DataFrame, start: str, end: str, close: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows whose time of day is in [start, end) (HH:mm:ss; past midnight if start > end), with closing, whether it has
    reached close, from which on positions must be shut."""
    clock = F.date_format(ts, "HH:mm:ss")
    inside = (clock >= start) & (clock < end) if start <= end else (clock >= start) | (clock < end)
    rows = rows.where(inside)
    return rows.withColumn("closing", clock >= close) if close else rows


def with_flags(rows: DataFrame, mask: int, every: bool = False, flags: str = "flags") -> DataFrame:
    """Rows that have any (or every) bit of mask. Bits: 1 bid, 2 ask, 4 last, 8 volume."""
    hit = F.col(flags).bitwiseAND(F.lit(mask))
    return rows.where(hit == mask if every else hit != 0)


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order. The total for the listing is a count of rows, asked for by itself."""
    return rows.orderBy(*order).offset(offset).limit(limit)


#: Comparison operators of conditions.
COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}


def condition(tree: dict) -> Column:
    """{"all": [...]}, {"any": [...]}, {"not": {...}} or {"column", "op", "value" or "other"} as one predicate."""
    if "all" in tree or "any" in tree:
        parts = [condition(t) for t in tree.get("all", tree.get("any"))]
        if not parts:
            raise ValueError("an empty group has no meaning")
        return reduce(operator.and_ if "all" in tree else operator.or_, parts)
    if "not" in tree:
        return ~condition(tree["not"])
    if tree.get("op") not in COMPARE:
        raise ValueError(f"unknown comparison {tree.get('op')!r}")
    right = F.col(tree["other"]) if "other" in tree else F.lit(tree["value"])
    return COMPARE[tree["op"]](F.col(tree["column"]), right)


#: Nodes of expression graphs: number of inputs, and the column they make.
NODES = {
    "add": (2, lambda a, b: a + b),
    "sub": (2, lambda a, b: a - b),
    "mul": (2, lambda a, b: a * b),
    "div": (2, ratio),
    "neg": (1, lambda a: -a),
    "abs": (1, F.abs),
    "min": (2, F.least),
    "max": (2, F.greatest),
    "if_positive": (3, lambda c, a, b: F.when(c > 0, a).otherwise(b)),
}


def compile_graph(nodes: dict[str, dict], output: str, most_depth: int = 32, most_nodes: int = 256) -> Column:
    """A graph {name: {"op", "inputs"} or {"column"} or {"value"}} as one column expression, checked first for unknown
    operators, arity, missing inputs, cycles and size."""
    if len(nodes) > most_nodes:
        raise ValueError(f"more than {most_nodes} nodes")
    made: dict[str, Column] = {}

    def make(name: str, path: tuple[str, ...]) -> Column:
        if name in path:
            raise ValueError(f"cycle at {name}")
        if len(path) >= most_depth:
            raise ValueError(f"deeper than {most_depth}")
        if name not in nodes:
            raise ValueError(f"no node {name}")
        if name not in made:
            node = nodes[name]
            if "column" in node:
                made[name] = F.col(node["column"])
            elif "value" in node:
                made[name] = F.lit(float(node["value"]))
            else:
                arity, f = NODES.get(node.get("op"), (None, None))
                if f is None:
                    raise ValueError(f"unknown operator {node.get('op')!r}")
                if len(node["inputs"]) != arity:
                    raise ValueError(f"{node['op']} takes {arity} inputs")
                made[name] = f(*[make(i, (*path, name)) for i in node["inputs"]])
        return made[name]

    return make(output, ())


def parse_money(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Decimal strings to exact numbers, null where a string is none."""
    return rows.withColumns({c: money(F.col(c)) for c in columns})


def round_to_instrument(rows: DataFrame, price: str, volume: str, digits: int, tick: float, step: float, least: float, most: float) -> DataFrame:
    """Prices to the nearest tick; volumes down to a step and into [least, most]."""
    return rows.withColumns({price: to_tick(F.col(price), tick, digits), volume: F.greatest(F.lit(least), F.least(F.lit(most), F.round(to_step(F.col(volume), step), 8)))})


def quote_fields(quotes: DataFrame) -> DataFrame:
    """spread, mid, and the change of mid from prev_close, absolute and in percent (null from 0)."""
    mid = (F.col("bid") + F.col("ask")) / 2
    return quotes.withColumns({"spread": F.col("ask") - F.col("bid"), "mid": mid, "change": mid - F.col("prev_close"), "change_pct": ratio((mid - F.col("prev_close")) * 100, F.col("prev_close"))})


def quote_age(rows: DataFrame, as_of: str, ts: str = "ts") -> DataFrame:
    """age_ms: milliseconds from the row's time to as_of, a time that is given and never the clock's."""
    return rows.withColumn("age_ms", F.timestamp_diff("MILLISECOND", F.col(ts), F.lit(as_of).cast("timestamp_ntz")))


def run_listing(runs: DataFrame, results: DataFrame, run_id: str, value: str, label: str) -> DataFrame:
    """Runs with their results' number, best value and its label (least label of the best); 0 and null without results."""
    best = results.groupBy(run_id).agg(F.count("*").alias("n_results"), F.max(value).alias("best_value"), F.max_by(label, F.struct(F.col(value), -F.col(label))).alias("best_label"))
    return runs.join(best, run_id, "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))


def event_log(events: DataFrame, kinds: list[str], field: str) -> DataFrame:
    """Log rows of the kinds with one field of their JSON payload (null where it is missing or the payload is no JSON)."""
    return events.where(F.col("event_type").isin(kinds)).withColumn("field", F.try_variant_get(F.try_parse_json("props"), f"$.{field}", "bigint"))


def violations(rows: DataFrame, specs: dict[str, dict]) -> DataFrame:
    """failed: the sorted names of checks that a row's parameters fail: "x:min", "x:max", "x:choice", "x:missing"."""
    checks = []
    for name, spec in specs.items():
        c = F.col(name)
        checks.append(F.when(c.isNull(), F.lit(f"{name}:missing")))
        if "min" in spec:
            checks.append(F.when(c < spec["min"], F.lit(f"{name}:min")))
        if "max" in spec:
            checks.append(F.when(c > spec["max"], F.lit(f"{name}:max")))
        if "choices" in spec:
            checks.append(F.when(~c.isin(spec["choices"]), F.lit(f"{name}:choice")))
    return rows.withColumn("failed", F.array_sort(F.array_compact(F.array(*checks))))
