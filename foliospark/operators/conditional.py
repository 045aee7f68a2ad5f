"""Conditional-format rules: range statistics once per group, then a predicate or value per row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compile import with_truth
from . import statistics
from .statistics import group_stats

#: Icon colours by number of icons, and the colour of negative bars.
ICON_COLOURS = {3: ("FF0000", "FFC000", "00B050"), 4: ("FF0000", "FF8C00", "FFC000", "00B050"), 5: ("FF0000", "FF8C00", "FFC000", "92D050", "00B050")}
NEGATIVE_BAR = "FF0000"
#: What helper columns' names start with.
_STOP = "_folio_t"


@dataclass(frozen=True)
class Stop:
    """A threshold: kind num, percent, percentile, min, max, autoMin, autoMax or formula, and its value."""

    kind: str
    value: float | str | None = None


def _number(x) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def threshold(stop: Stop, value: str, last: bool = False) -> Column:
    """A stop that is no percentile as an aggregate over a group."""
    low, high, n = F.min(value), F.max(value), _number(stop.value)
    if stop.kind in ("min", "autoMin"):
        return low
    if stop.kind in ("max", "autoMax"):
        return high
    if stop.kind == "formula":
        return F.lit(n) if n is not None else high if last else low
    if n is None:
        return F.lit(None).cast("double")
    if stop.kind == "percent":
        return low + (high - low) * (n / 100)
    return F.lit(n)


def _with_stops(df: DataFrame, value: str, stops: Sequence[Stop], by: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """df with the stops as columns, which _drop takes away again."""
    shares = {f"{_STOP}{k}": min(100.0, max(0.0, n)) / 100 for k, s in enumerate(stops) if s.kind == "percentile" and (n := _number(s.value)) is not None}
    plain = {f"{_STOP}{k}": threshold(s, value, k == len(stops) - 1) for k, s in enumerate(stops) if f"{_STOP}{k}" not in shares}
    out = df
    if plain:
        out = group_stats(df, by, **plain)
    if shares:
        out = statistics.joined(out, statistics.percentiles(df, value, by, shares), by)
    return out, [F.col(f"{_STOP}{k}") for k in range(len(stops))]


def _drop(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(_STOP)])


def cell_is(value: Column, operator: str, first, second=None) -> Column:
    """A comparison with one or two operands: numeric if both sides are, else text without case."""
    a, b = _number(first), _number(second)
    if a is not None:
        x = value.cast("double")
        if operator in ("between", "notBetween"):
            inside = x.between(min(a, b), max(a, b)) if b is not None else F.lit(None).cast("boolean")
            return F.coalesce(inside if operator == "between" else ~inside, F.lit(False))
        left, right = x, F.lit(a)
    else:
        left, right = F.lower(value.cast("string")), F.lit(str(first).lower())
        if operator in ("between", "notBetween"):
            low, high = sorted((str(first).lower(), str(second).lower()))
            inside = left.between(low, high)
            return F.coalesce(inside if operator == "between" else ~inside, F.lit(False))
    ops = {"lessThan": left < right, "lessThanOrEqual": left <= right, "equal": left == right, "notEqual": left != right, "greaterThanOrEqual": left >= right, "greaterThan": left > right}
    return F.coalesce(ops[operator], F.lit(False))


def _channel(colour: str, k: int) -> int:
    return int(colour[-6:][2 * k : 2 * k + 2], 16)


def colour_text(channels: Sequence[Column]) -> Column:
    part = [F.lpad(F.hex(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(c + 0.5).cast("double"))).cast("bigint")), 2, "0") for c in channels]
    return F.concat(*part)


def color_scale(df: DataFrame, value: str, stops: Sequence[Stop], colours: Sequence[str], by: Sequence[str] = (), name: str = "color") -> DataFrame:
    """df with the colour (RRGGBB) of each value in a gradient of two stops or more."""
    out, t = _with_stops(df, value, stops, by)
    for k in range(1, len(t)):  # out-of-order stops are raised to the one before
        t[k] = F.greatest(*t[: k + 1])
    x = F.col(value)
    rgb = []
    for ch in range(3):
        c = [float(_channel(h, ch)) for h in colours]
        shade = F.when(x <= t[0], c[0]).when(x >= t[-1], c[-1])
        for k in range(len(t) - 1):
            part = F.coalesce(F.try_divide(x - t[k], t[k + 1] - t[k]), F.lit(0.0))
            shade = shade.when(x <= t[k + 1], c[k] + (c[k + 1] - c[k]) * part)
        rgb.append(shade)
    return _drop(out.withColumn(name, F.when(x.isNotNull(), colour_text(rgb))))


def data_bar(df: DataFrame, value: str, low: Stop, high: Stop, colour: str, by: Sequence[str] = (), shortest: float = 0.0, longest: float = 100.0) -> DataFrame:
    """df with bar_fraction, bar_start (null unless the extent has both signs) and bar_color."""
    out, (lo, hi) = _with_stops(df, value, (low, high), by)
    x = F.col(value)
    mixed = (lo < 0) & (hi > 0)
    axis = F.try_divide(-lo, hi - lo)
    width = F.when(x >= 0, F.try_divide(x, hi) * (1 - axis)).otherwise(F.try_divide(F.abs(x), F.abs(lo)) * axis)
    share = F.when(hi > lo, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(x - lo, hi - lo)))).otherwise((x >= hi).cast("double"))
    plain = shortest / 100 + share * (longest - shortest) / 100
    known = x.isNotNull() & lo.isNotNull() & hi.isNotNull()
    out = out.withColumns({
        "bar_fraction": F.when(known, F.when(mixed, width).otherwise(plain)),
        "bar_start": F.when(known & mixed, F.when(x >= 0, axis).otherwise(axis - width)),
        "bar_color": F.when(known, F.when(mixed & (x < 0), NEGATIVE_BAR).otherwise(colour)),
    })
    return _drop(out)


def icon_set(df: DataFrame, value: str, stops: Sequence[Stop], by: Sequence[str] = (), reverse: bool = False, name: str = "icon") -> DataFrame:
    """df with the icon's index (thresholds reached past the first) and its colour."""
    out, t = _with_stops(df, value, stops, by)
    x = F.col(value)
    index = sum(((x >= c).cast("int") for c in t[1:]), F.lit(0))
    if reverse:
        index = len(stops) - 1 - index
    ramp = F.array(*[F.lit(c) for c in ICON_COLOURS.get(len(stops), ICON_COLOURS[3])])
    return _drop(out.withColumns({name: F.when(x.isNotNull(), index), f"{name}_color": F.when(x.isNotNull(), F.get(ramp, F.least(index, F.size(ramp) - 1)))}))


def top_n(df: DataFrame, value: str, n: float, by: Sequence[str], percent: bool = False, bottom: bool = False, name: str = "in_top") -> DataFrame:
    """df with whether the value is among the top (bottom) n or n percent of its group, ties included.

    The value at the edge is found first, without a sort of the table, and each row compared with it.
    """
    x, n_rows, edge = F.col(value), f"{_STOP}n", f"{_STOP}edge"
    if percent:
        share = n / 100 if bottom else 1 - n / 100
        wanted = lambda c: F.greatest(F.lit(1), F.least(c, F.floor(c * n / 100)))
        cut = statistics.at_positions(df, value, by, {edge: (min(1.0, max(0.0, share)), (lambda c: wanted(c) - 1) if bottom else (lambda c: c - wanted(c)))})
    else:
        fewer = (F.max if bottom else F.min)(value)
        known = df.groupBy(*by).agg(F.count(value).alias(n_rows), fewer.alias(f"{_STOP}last"))
        cut = statistics.joined(known, statistics.kth(df, value, max(1, int(n)), by, not bottom, edge), by).select(*by, F.coalesce(edge, f"{_STOP}last").alias(edge))
    hit = x <= F.col(edge) if bottom else x >= F.col(edge)
    return _drop(statistics.joined(df, cut, by).withColumn(name, F.coalesce(hit, F.lit(False))))


def above_average(df: DataFrame, value: str, by: Sequence[str] = (), above: bool = True, equal: bool = False, deviations: float = 0.0, name: str = "matches") -> DataFrame:
    """df with whether the value is beyond its group's mean, moved by population deviations if asked."""
    out = group_stats(df, by, **{f"{_STOP}m": F.avg(value), f"{_STOP}s": F.stddev_pop(value)})
    x, line = F.col(value), F.col(f"{_STOP}m") + (deviations if above else -deviations) * F.col(f"{_STOP}s")
    hit = {(True, False): x > line, (True, True): x >= line, (False, False): x < line, (False, True): x <= line}[above, equal]
    return _drop(out.withColumn(name, F.coalesce(hit, F.lit(False))))


def typed_key(value: Column, is_number: bool) -> Column:
    """Numbers and text never meet; text is trimmed and without case; empty text is no key."""
    if is_number:
        return F.when(value.isNotNull(), F.concat(F.lit("n:"), value.cast("double").cast("string")))
    return F.when(F.trim(value) != "", F.concat(F.lit("s:"), F.lower(F.trim(value))))


def duplicates(df: DataFrame, key: Column, by: Sequence[str] = (), unique: bool = False, name: str = "matches") -> DataFrame:
    """df with whether the key occurs twice or more (once, if unique) in its group; no key never matches.

    The counts are combined map-side before they meet, and only then joined back.
    """
    k, n = f"{_STOP}k", f"{_STOP}n"
    keyed = df.withColumn(k, key)
    counts = keyed.where(F.col(k).isNotNull()).groupBy(*by, k).agg(F.count("*").alias(n)).withColumnRenamed(k, "_key")
    hit = F.col(n) == 1 if unique else F.col(n) > 1
    return statistics.joined(keyed, counts, by, key=F.col(k)).select(*df.columns, F.coalesce(hit, F.lit(False)).alias(name))


def text_rule(value: Column, operator: str, operand: str) -> Column:
    """contains, notContains, beginsWith or endsWith, without case."""
    s, t = F.lower(F.coalesce(value, F.lit(""))), operand.lower()
    return {"contains": s.contains(t), "notContains": ~s.contains(t), "beginsWith": s.startswith(t), "endsWith": s.endswith(t)}[operator]


def time_period(serial: Column, period: str, now_serial: float) -> Column:
    """Whether a day number falls in a period relative to an injected now; weeks start on Sunday."""
    day, today = F.floor(serial), F.lit(int(now_serial // 1))
    days = {"today": (0, 0), "yesterday": (-1, -1), "tomorrow": (1, 1), "last7Days": (-6, 0)}
    if period in days:
        a, b = days[period]
        return F.coalesce(day.between(today + a, today + b), F.lit(False))
    epoch = F.lit("1899-12-30").cast("date")
    date, now = F.date_add(epoch, day.cast("int")), F.date_add(epoch, today)
    if period.endswith("Week"):
        start = F.date_sub(now, F.dayofweek(now) - 1)
        start = F.date_add(start, {"last": -7, "this": 0, "next": 7}[period[:4]])
        return F.coalesce((date >= start) & (date <= F.date_add(start, 6)), F.lit(False))
    month = F.add_months(F.trunc(now, "month"), {"last": -1, "this": 0, "next": 1}[period[:4]])
    return F.coalesce(F.trunc(date, "month") == month, F.lit(False))


def expression_rule(df: DataFrame, formula: str, by: Sequence[str] = (), now_serial: float | None = None, name: str = "matches") -> DataFrame:
    """df with a formula's truth; range functions see the rows of the same group."""
    return with_truth(df, formula, name, by, now_serial)


def first_rule(rules: Sequence[tuple[int, Column, str]], name: str = "format") -> Column:
    """The format of the matching rule of least priority number; later ones do not merge."""
    chosen = F.lit(None).cast("string")
    for _, hit, style in sorted(rules, key=lambda r: -r[0]):
        chosen = F.when(hit, style).otherwise(chosen)
    return chosen.alias(name)


def merged_format(rules: Sequence[tuple[int, Column, dict, bool]], properties: Sequence[str], name: str = "format") -> Column:
    """A struct with each property from the matching rule of least priority number that sets it.

    rules: priority, hit, the properties set, and whether a match stops all later rules.
    """
    found = {p: F.lit(None).cast("string") for p in properties}
    open_ = F.lit(True)
    for _, hit, style, stops in sorted(rules, key=lambda r: r[0]):
        counts = open_ & hit
        for p, value in style.items():
            found[p] = F.coalesce(found[p], F.when(counts, F.lit(str(value))))
        if stops:
            open_ = open_ & ~hit
    return F.struct(*[found[p].alias(p) for p in properties]).alias(name)
