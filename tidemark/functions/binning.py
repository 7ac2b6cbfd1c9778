"""Bin configurations and bin expressions."""

from __future__ import annotations

import math
from bisect import bisect_right
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.spec import BinConfig, Interval


def ordered(interval: Interval) -> Interval:
    """The interval with its lower end first."""
    return (min(interval), max(interval))


def nice_bins(most: int, extent: Interval) -> BinConfig:
    """At most `most` bins of 1, 2 or 5 times a power of ten that cover the extent."""
    low, high = ordered(extent)
    span = (high - low) or abs(low) or 1.0
    exponent = math.floor(math.log10(span) + 0.5) - math.ceil(math.log(most) / math.log(10))
    step = 10.0**exponent
    while math.ceil(span / step) > most:
        step *= 10
    for divisor in (5, 2):
        if span / (step / divisor) <= most:
            step /= divisor
    digits = math.log10(step)
    slack = 10 ** ((0 if digits >= 0 else int(-digits) + 1) * -1 - 1)
    start = min(low, math.floor(low / step + slack) * step)
    stop = math.ceil(high / step) * step
    return BinConfig(float(start), float(stop if stop != start else start + step), step)


_S, _M, _H, _D = 1000, 60_000, 3_600_000, 86_400_000
#: The lengths between which time ticks choose, as (unit, count, milliseconds).
TICKS = (
    ("second", 1, _S), ("second", 5, 5 * _S), ("second", 15, 15 * _S), ("second", 30, 30 * _S),
    ("minute", 1, _M), ("minute", 5, 5 * _M), ("minute", 15, 15 * _M), ("minute", 30, 30 * _M),
    ("hour", 1, _H), ("hour", 3, 3 * _H), ("hour", 6, 6 * _H), ("hour", 12, 12 * _H),
    ("day", 1, _D), ("day", 2, 2 * _D), ("week", 1, 7 * _D),
    ("month", 1, 30 * _D), ("month", 3, 90 * _D), ("year", 1, 365 * _D),
)


def _decimal_step(low: float, high: float, count: int) -> float:
    """The 1, 2, 5 or 10 times a power of ten nearest, by ratio, to the span over count."""
    raw = (high - low) / max(1, count)
    power = 10.0 ** math.floor(math.log10(raw)) if raw > 0 else 1.0
    ratio = raw / power
    return power * (10 if ratio >= math.sqrt(50) else 5 if ratio >= math.sqrt(10) else 2 if ratio >= math.sqrt(2) else 1)


def time_ticks(extent: Interval, count: int) -> list[float]:
    """About count calendar instants in UTC within the extent, in milliseconds."""
    low, high = ordered(extent)
    target = (high - low) / count
    at = bisect_right([t[2] for t in TICKS], target)
    if at == 0:
        step = max(1.0, _decimal_step(low, high, count))
        first = math.ceil(low / step)
        return [k * step for k in range(first, math.floor(high / step) + 1)]
    if at == len(TICKS):
        unit, every = "year", max(1, int(_decimal_step(low / (365 * _D), high / (365 * _D), count)))
    else:
        unit, every, _ = TICKS[at - 1] if target / TICKS[at - 1][2] < TICKS[at][2] / target else TICKS[at]
    zero = datetime(1970, 1, 1, tzinfo=UTC)
    fixed = {"second": _S, "minute": _M, "hour": _H}
    if unit in fixed:  # these divide their parent unit, so whole multiples are calendar instants
        step = fixed[unit] * every
        return [float(k * step) for k in range(math.ceil(low / step), math.floor(high / step) + 1)]
    begin = zero + timedelta(milliseconds=low)
    day = begin.replace(hour=0, minute=0, second=0, microsecond=0)
    day = day if day == begin else day + timedelta(days=1)
    out = []
    while (ms := (day - zero) / timedelta(milliseconds=1)) <= high:
        if unit == "day" and (day.day - 1) % every == 0:
            out.append(ms)
        elif unit == "week" and day.weekday() == 6:
            out.append(ms)
        elif unit == "month" and day.day == 1 and (day.month - 1) % every == 0:
            out.append(ms)
        elif unit == "year" and (day.day, day.month) == (1, 1) and day.year % every == 0:
            out.append(ms)
        day += timedelta(days=1)
    return out


def time_bins(most: int, extent: Interval) -> BinConfig:
    """Equal bins between the first and the last tick, as many as there are ticks; what lies beyond them is outside."""
    ticks = time_ticks(extent, most)
    if len(ticks) < 2:
        return BinConfig(*ordered(extent), (ordered(extent)[1] - ordered(extent)[0]) / most or 1.0)
    return BinConfig(ticks[0], ticks[-1], (ticks[-1] - ticks[0]) / len(ticks))


def inside(value: Column, low: float, high: float, closed: bool = False) -> Column:
    """low <= value < high (or <= with closed). Nulls, NaN and infinities are outside. The comparison reaches Parquet."""
    return (value >= F.lit(float(low))) & ((value <= F.lit(float(high))) if closed else (value < F.lit(float(high))))


def bin_index(value: Column, config: BinConfig) -> Column:
    """The bin of a value in the domain."""
    return F.floor((value - F.lit(float(config.start))) / F.lit(float(config.step))).cast("int")


def in_bins(value: Column, config: BinConfig, closed: bool = False) -> Column:
    """Values that a bin holds. Rounding may put one just below the end past the last bin; closed lets the end itself pass, which has no bin."""
    return inside(value, config.start, config.stop, closed) & (fractional_bin(value, config) < F.lit(float(config.count)))


def bin_or(value: Column, config: BinConfig, outside: int = -1) -> Column:
    """The bin of a value, or outside for values not in the domain and nulls."""
    return F.when(in_bins(value, config), bin_index(value, config)).otherwise(F.lit(outside))


def fractional_bin(value: Column, config: BinConfig) -> Column:
    return (value - F.lit(float(config.start))) / F.lit(float(config.step))


def bin_start(index: Column, config: BinConfig) -> Column:
    """The value at which a bin begins."""
    return F.lit(float(config.start)) + index * F.lit(float(config.step))


def snapped(value: Column, config: BinConfig) -> Column:
    """The start of the bin that holds a value."""
    return F.lit(float(config.start)) + F.lit(float(config.step)) * F.floor(fractional_bin(value, config))


def snap(value: float, config: BinConfig) -> int:
    """The pixel edge nearest to a value, within the domain."""
    return min(max(round((value - config.start) / config.step), 0), config.count)
