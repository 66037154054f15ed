"""Column expressions used throughout: guarded statistics, ordering keys, rounding to an instrument's steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.schemas import MONEY


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.try_divide(a, b)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def order_key(ts: Column, tiebreak: Column) -> Column:
    """One number that sorts like (ts, tiebreak), for min_by and max_by.

    Aggregates keep a decimal in place, so they hash; a struct would make them sort all rows first.
    """
    return (micros(ts).cast("decimal(18,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)")).cast("decimal(38,0)") + tiebreak.cast("decimal(38,0)")


def corr_guarded(x: Column, y: Column, window=None) -> Column:
    """covar / (sd * sd) over a group or a window frame; null where either is constant (corr raises there under ANSI)."""
    over = (lambda c: c.over(window)) if window is not None else (lambda c: c)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return ratio(over(F.covar_samp(a, b)), over(F.stddev_samp(a)) * over(F.stddev_samp(b)))


def money(text: Column) -> Column:
    """A decimal string as an exact number; null if it is none."""
    return text.try_cast(MONEY)


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(x.isNotNull(), F.greatest(as_col(low), F.least(as_col(high), x)))


def round_scaled(x: Column, digits: int) -> Column:
    """The double x at so many digits, halves away from zero: scaled, rounded and scaled back in doubles, as DuckDB does; x
    itself where scaling gives no number. Spark's round takes the shortest decimal of x instead, and so the other neighbour
    where the last bits of x or of what it is scaled to make a half."""
    scale = F.lit(10.0**digits)
    size = F.abs(x * scale)
    part = size % 1
    whole = size - part + (part >= 0.5).cast("double")
    return F.when(size < float("inf"), F.signum(x) * whole / scale).otherwise(x)


def to_step(x: Column, step: Column | float) -> Column:
    """x rounded down to a multiple of step."""
    s = step if isinstance(step, Column) else F.lit(step)
    return F.floor(x / s + F.lit(1e-9)) * s


def to_tick(price: Column, tick: float, digits: int) -> Column:
    """price at the nearest multiple of tick, shown with so many digits."""
    return F.round(F.floor(price / F.lit(tick) + F.lit(0.5)) * F.lit(tick), digits)
