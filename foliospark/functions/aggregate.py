"""Range formula functions as aggregate expressions.

An argument is a Range (a whole column of the table, one value a row) or a direct value.
Most functions are decomposable aggregates, which Spark combines map-side. Those that need a
group's values in order (LARGE, SMALL, MODE, MEDIAN, percentiles, RANK, AVEDEV, several ranges
in a spread, joined texts) are frames of their own from `operators.statistics`, joined to the
groups, so that no group is gathered. On a stream, which cannot be joined to itself, and where a
position or percentile is no constant, these gather a group's numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field as default
from functools import reduce
from operator import add, and_, mul

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import statistics
from ..plans.values import DIV0, NA, NUM, REF, VALUE, Val, boolean, compare, error, exact, field, first_error, is_blank, kind_is, num, text, to_cell, to_num, to_text
from .criteria import predicate, wildcard_match

MAX_TEXT = 32767


@dataclass(frozen=True)
class Range:
    """One value a row, for the rows of the group that `where` lets in."""

    val: Val
    where: Column | None = None
    size: int | None = None  # cells, where it is known

    def of(self, c: Column) -> Column:
        return c if self.where is None else F.when(self.where, c)


#: What the columns that a plan adds are named by, with a number after.
PREFIX = "_folio"


@dataclass(frozen=True)
class Plan:
    """The aggregates and frames that formulas need; their results are columns by name.

    per_row: the formulas are for each row, not each group. order: the rows' order.
    streaming: the table is a stream, so frames of its own rows cannot be joined to it.
    """

    per_row: bool = False
    order: Column | None = None
    literals: dict = default(default_factory=dict)
    streaming: bool = False
    aggregates: list = default(default_factory=list)
    frames: list = default(default_factory=list)  # (key of each row or None, (table, by) to a frame)
    shares: dict = default(default_factory=dict)  # percentiles wanted of the same rows, by name

    def __call__(self, c: Column) -> Column:
        name = f"{PREFIX}_a{len(self.aggregates)}"
        self.aggregates.append(c.alias(name))
        return F.col(name)

    def frame(self, build: Callable, key: Column | None = None) -> Column:
        """The column that `build(table, by, name)` has for the row's group (and _key)."""
        name = f"{PREFIX}_f{len(self.frames)}"
        self.frames.append((key, lambda df, by: build(df, by, name)))
        return F.col(name)

    def percentile(self, rows: Callable, which: str, p: float) -> Column:
        """A percentile of rows; those of the same rows are found together."""
        if which not in self.shares:
            wanted: dict[str, float] = {}
            self.shares[which] = wanted
            self.frames.append((None, lambda df, by: statistics.percentiles(rows(df, by), "_x", by, wanted)))
        name = f"{PREFIX}_p{len(self.shares)}_{len(self.shares[which])}"
        self.shares[which][name] = p
        return F.col(name)

    def framed(self, args: list) -> bool:
        """Whether these arguments' values can be rows of a frame."""
        flat = _flat(args)
        return not self.streaming and any(isinstance(a, Range) for a in flat) and all(isinstance(a, Range) or id(a) in self.literals for a in flat)


@dataclass(frozen=True)
class Items:
    """An array constant as one argument."""

    vals: tuple[Val, ...]


Arg = Range | Val | Items


def _flat(args: list[Arg]) -> list[Range | Val]:
    return [v for a in args for v in (a.vals if isinstance(a, Items) else (a,))]


RANGE: dict[str, tuple[int, int, Callable]] = {}


def define(names: str, least: int, most: int | None = None):
    def put(f):
        for name in names.split():
            RANGE[name] = (least, least if most is None else most, f)
        return f

    return put


def apply(name: str, args: list[Arg], plan: Plan) -> Val:
    least, most, f = RANGE[name]
    return f(args, plan) if least <= len(args) <= most else error(VALUE)


def _error(args: list[Arg], plan: Plan) -> Column | None:
    """The first error among the arguments."""
    found = []
    for a in _flat(args):
        if isinstance(a, Range) and a.val.err is not None:
            e = a.of(a.val.err)
            found.append(plan(F.min_by(e, F.when(e.isNotNull(), plan.order)) if plan.order is not None else F.first(e, ignorenulls=True)))
        elif isinstance(a, Val):
            found.append(a.err)
    return first_error(*found)


def _number(a: Arg) -> Column:
    """A row's number in a range; a direct number or logical; else null."""
    if isinstance(a, Range):
        return a.of(field(a.val, "num"))
    return F.coalesce(field(a, "num"), field(a, "bool").cast("double"))


def _each(args: list[Arg], plan: Plan, of_range, of_direct) -> list[Column]:
    return [plan(of_range(_number(a))) if isinstance(a, Range) else of_direct(_number(a)) for a in args]


def _count(args: list[Arg], plan: Plan) -> Column:
    return reduce(add, _each(_flat(args), plan, F.count, lambda x: x.isNotNull().cast("bigint")))


@define("SUM", 1, 255)
def _sum_fn(args, plan):
    return num(_total(args, plan), _error(args, plan))


def _total(args: list[Arg], plan: Plan, f=lambda x: x) -> Column:
    return reduce(add, [F.coalesce(plan(F.sum(f(_number(a)))), F.lit(0.0)) if isinstance(a, Range) else F.coalesce(f(_number(a)), F.lit(0.0)) for a in args])


@define("SUMSQ", 1, 255)
def _sumsq(args, plan):
    return num(_total(args, plan, lambda x: x * x), _error(args, plan))


@define("AVERAGE", 1, 255)
def _average(args, plan):
    n = _count(args, plan)
    return num(F.try_divide(_total(args, plan), n), _error(args, plan), F.when(n == 0, DIV0))


def _extreme(names: str, of_range, of_all) -> None:
    def build(args, plan):
        parts = [plan(of_range(_number(a))) if isinstance(a, Range) else _number(a) for a in args]
        return num(F.coalesce(parts[0] if len(parts) == 1 else of_all(*parts), F.lit(0.0)), _error(args, plan))

    define(names, 1, 255)(build)


_extreme("MIN", F.min, F.least)
_extreme("MAX", F.max, F.greatest)


@define("PRODUCT", 1, 255)
def _product(args, plan):
    parts = [F.when(plan(F.count(_number(a))) > 0, plan(F.product(_number(a)))) if isinstance(a, Range) else _number(a) for a in args]
    n = _count(args, plan)
    return num(F.when(n == 0, 0.0).otherwise(reduce(mul, [F.coalesce(p, F.lit(1.0)) for p in parts])), _error(args, plan))


@define("COUNT", 1, 255)
def _count_fn(args, plan):
    parts = [plan(F.count(_number(a))) if isinstance(a, Range) else kind_is(a, "num").cast("bigint") for a in args]
    return exact(reduce(add, parts).cast("double"))


@define("COUNTA", 1, 255)
def _counta(args, plan):
    parts = []
    for a in args:
        v = a.val if isinstance(a, Range) else a
        full = ~is_blank(v) if v.err is None else ~is_blank(v) | v.err.isNotNull()
        parts.append(plan(F.count_if(F.coalesce(a.of(full), F.lit(False)))) if isinstance(a, Range) else full.cast("bigint"))
    return exact(reduce(add, parts).cast("double"))


@define("COUNTBLANK", 1)
def _countblank(args, plan):
    if not isinstance(args[0], Range):
        return error(VALUE)
    a = args[0]
    empty = is_blank(a.val) | F.coalesce(field(a.val, "str") == "", F.lit(False))
    if a.val.err is not None:
        empty = empty & a.val.err.isNull()
    if a.size is not None:  # a sparse area: what is absent is blank too
        return exact((F.lit(a.size) - plan(F.count_if(F.coalesce(a.of(~empty), F.lit(False))))).cast("double"))
    return exact(plan(F.count_if(F.coalesce(a.of(empty), F.lit(False)))).cast("double"))


def _constant(a: Arg, plan: Plan):
    """The Python value of a literal argument."""
    key = id(a)
    if key not in plan.literals:
        raise NotImplementedError("a criterion must be a constant")
    return plan.literals[key]


def _conditions(args: list[Arg], plan: Plan) -> Column:
    pairs = list(zip(args[::2], args[1::2], strict=True))
    preds = [F.coalesce(r.of(predicate(r.val, _constant(c, plan))), F.lit(False)) for r, c in pairs]
    return reduce(and_, preds)


def _ifs(kind: str, target: Range | None, hit: Column, plan: Plan) -> Val:
    if kind == "count":
        return exact(plan(F.count_if(hit)).cast("double"))
    x = F.when(hit, field(target.val, "num"))
    err = None if target.val.err is None else plan(F.first(F.when(hit, target.val.err), ignorenulls=True))
    if kind == "sum":
        return num(F.coalesce(plan(F.sum(x)), F.lit(0.0)), err)
    return num(plan(F.avg(x)), err, F.when(plan(F.count(x)) == 0, DIV0))


def _ranges(args: list[Arg]) -> bool:
    return all(isinstance(a, Range) for a in args)


@define("COUNTIF", 2)
def _countif(args, plan):
    return _ifs("count", None, _conditions(args, plan), plan) if _ranges(args[:1]) else error(VALUE)


@define("COUNTIFS", 2, 254)
def _countifs(args, plan):
    return _ifs("count", None, _conditions(args, plan), plan) if len(args) % 2 == 0 and _ranges(args[::2]) else error(VALUE)


def _one_if(kind: str):
    def build(args, plan):
        target = args[2] if len(args) > 2 else args[0]
        return _ifs(kind, target, _conditions(args[:2], plan), plan) if _ranges([args[0], target]) else error(VALUE)

    return build


define("SUMIF", 2, 3)(_one_if("sum"))
define("AVERAGEIF", 2, 3)(_one_if("avg"))


def _many_ifs(kind: str):
    def build(args, plan):
        return _ifs(kind, args[0], _conditions(args[1:], plan), plan) if len(args) % 2 and _ranges([args[0], *args[1::2]]) else error(VALUE)

    return build


define("SUMIFS", 3, 255)(_many_ifs("sum"))
define("AVERAGEIFS", 3, 255)(_many_ifs("avg"))


@define("SUMPRODUCT", 1, 255)
def _sumproduct(args, plan):
    if not _ranges(args):
        return error(VALUE)
    factors = [F.coalesce(a.of(field(a.val, "num")), F.lit(0.0)) for a in args]
    return num(F.coalesce(plan(F.sum(reduce(mul, factors))), F.lit(0.0)), _error(args, plan))


def _rows(args: list[Arg], plan: Plan) -> Callable:
    """The arguments' numbers as rows: the group, _x and its place _o, by argument and then in the rows' order."""
    flat = list(enumerate(_flat(args)))

    def build(df, by):
        order = plan.order if plan.order is not None else F.lit(0)
        parts = [F.struct(_number(a).alias("_x"), F.struct(F.lit(k).alias("k"), order.alias("o")).alias("_o")) for k, a in flat if isinstance(a, Range)]
        rows = df.select(*by, parts[0].alias("_i")) if len(parts) == 1 else df.select(*by, F.explode(F.array(*parts)).alias("_i"))
        direct = [F.struct(_number(a).alias("_x"), F.struct(F.lit(k).alias("k"), F.lit(None).cast(rows.schema["_i"].dataType["_o"].dataType["o"].dataType).alias("o")).alias("_o")) for k, a in flat if not isinstance(a, Range)]
        if direct:
            groups = df.select(*by).distinct() if by else df.sparkSession.range(1)
            rows = rows.union(groups.select(*by, F.explode(F.array(*direct)).alias("_i")))
        return rows.select(*by, "_i.*").where("_x is not null")

    return build


def _numbers(args: list[Arg], plan: Plan) -> Column:
    """All numbers of the arguments in one array, in argument order."""
    parts = [plan(F.collect_list(_number(a))) if isinstance(a, Range) else F.array_compact(F.array(_number(a))) for a in _flat(args)]
    return F.concat(*parts)


def _add_up(xs: Column, f=lambda x: x) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x))


def _single(args: list[Arg]) -> bool:
    return len(args) == 1 and isinstance(args[0], Range)


def percentile_of(xs: Column, p: Column) -> Column:
    """Inclusive linear interpolation over an unsorted array."""
    s = F.array_sort(xs)
    place = p * (F.size(xs) - 1)
    low = F.floor(place).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(xs) - 1))
    return a + (b - a) * (place - low)


def _key(args: list[Arg]) -> str:
    """The same for arguments of the same numbers."""
    return "|".join(str(_number(a)) for a in _flat(args))


@define("MEDIAN", 1, 255)
def _median(args, plan):
    if plan.framed(args):
        value = plan.percentile(_rows(args, plan), _key(args), 0.5)
    else:
        value = plan(F.median(_number(args[0]))) if _single(args) else percentile_of(_numbers(args, plan), F.lit(0.5))
    return num(value, _error(args, plan), F.when(_count(args, plan) == 0, NUM))


def _spread(names: str, aggregate, of_array, least: int) -> None:
    def build(args, plan):
        n = _count(args, plan)
        if _single(args) and aggregate is not None:
            value = plan(aggregate(_number(args[0])))
        elif plan.framed(args):
            rows = _rows(args, plan)
            value = plan.frame(lambda df, by, name: statistics.mean_deviation(rows(df, by), "_x", by, name) if aggregate is None else rows(df, by).groupBy(*by).agg(aggregate("_x").alias(name)))
        else:
            xs = _numbers(args, plan)
            mean = F.try_divide(_add_up(xs), F.size(xs))
            value = of_array(xs, mean, F.size(xs).cast("double"))
        return num(F.when(n >= least, value), _error(args, plan), F.when(n < least, DIV0 if least else NUM))

    define(names, 1, 255)(build)


def _square_sum(xs: Column, mean: Column) -> Column:
    return _add_up(xs, lambda x: (x - mean) * (x - mean))


_spread("STDEV STDEV.S", F.stddev_samp, lambda xs, m, n: F.sqrt(F.try_divide(_square_sum(xs, m), n - 1)), 2)
_spread("STDEVP STDEV.P", F.stddev_pop, lambda xs, m, n: F.sqrt(F.try_divide(_square_sum(xs, m), n)), 1)
_spread("VAR VAR.S", F.var_samp, lambda xs, m, n: F.try_divide(_square_sum(xs, m), n - 1), 2)
_spread("VARP VAR.P", F.var_pop, lambda xs, m, n: F.try_divide(_square_sum(xs, m), n), 1)
_spread("AVEDEV", None, lambda xs, m, n: F.try_divide(_add_up(xs, lambda x: F.abs(x - m)), n), 1)


@define("DEVSQ", 1, 255)
def _devsq(args, plan):
    n = _count(args, plan)
    if _single(args):
        value = plan(F.var_pop(_number(args[0]))) * n
    elif plan.framed(args):
        rows = _rows(args, plan)
        value = plan.frame(lambda df, by, name: rows(df, by).groupBy(*by).agg(F.var_pop("_x").alias(name))) * n
    else:
        xs = _numbers(args, plan)
        value = _square_sum(xs, F.try_divide(_add_up(xs), F.size(xs)))
    return num(value, _error(args, plan), F.when(n == 0, NUM))


def _mean(names: str, f, back) -> None:
    def build(args, plan):
        n, low = _count(args, plan), RANGE["MIN"][2](args, plan).col
        ok = (n > 0) & (low > 0)
        return num(F.when(ok, back(_total(args, plan, lambda x: F.when(x > 0, f(x))), n)), _error(args, plan), F.when(~ok, NUM))

    define(names, 1, 255)(build)


_mean("GEOMEAN", F.ln, lambda s, n: F.exp(s / n))
_mean("HARMEAN", lambda x: 1 / x, lambda s, n: F.try_divide(n.cast("double"), s))


def _of_any(a: Arg) -> Column:
    """Numbers, logicals as 1 or 0, text as 0."""
    v = a.val if isinstance(a, Range) else a
    x = F.coalesce(field(v, "num"), field(v, "bool").cast("double"), F.when(kind_is(v, "str"), 0.0))
    return a.of(x) if isinstance(a, Range) else x


def _a_kind(names: str, combine) -> None:
    define(names, 1, 255)(lambda args, plan: combine(args, plan))


def _averagea(args, plan):
    n = reduce(add, [plan(F.count(_of_any(a))) if isinstance(a, Range) else _of_any(a).isNotNull().cast("bigint") for a in args])
    s = reduce(add, [F.coalesce(plan(F.sum(_of_any(a))) if isinstance(a, Range) else _of_any(a), F.lit(0.0)) for a in args])
    return num(F.try_divide(s, n), _error(args, plan), F.when(n == 0, DIV0))


def _extreme_a(one, many):
    def build(args, plan):
        parts = [plan(one(_of_any(a))) if isinstance(a, Range) else _of_any(a) for a in args]
        return num(F.coalesce(parts[0] if len(parts) == 1 else many(*parts), F.lit(0.0)), _error(args, plan))

    return build


_a_kind("AVERAGEA", _averagea)
_a_kind("MAXA", _extreme_a(F.max, F.greatest))
_a_kind("MINA", _extreme_a(F.min, F.least))


@define("MODE MODE.SNGL", 1, 255)
def _mode(args, plan):
    if plan.framed(args):
        rows, order = _rows(args, plan), "_o" if plan.order is not None or not _single(args) else None
        value = plan.frame(lambda df, by, name: statistics.mode_first(rows(df, by), "_x", order, by, name))
        return num(value, _error(args, plan), F.when(value.isNull(), NA))
    xs = _numbers(args, plan)
    times = F.transform(xs, lambda x: F.size(F.filter(xs, lambda y: y == x)))
    most = F.array_max(times)
    return num(F.get(xs, (F.array_position(times, most) - 1).cast("int")), _error(args, plan), F.when(F.coalesce(most, F.lit(0)) < 2, NA))


def _kth(largest: bool):
    def build(args, plan):
        k, e = to_num(args[1])
        n = F.floor(k).cast("int")
        constant = plan.literals.get(id(args[1]))
        if plan.framed(args[:1]) and isinstance(constant, float):
            rows, place = _rows(args[:1], plan), math.floor(constant)
            if place < 1:
                return error(NUM)
            value = plan.frame(lambda df, by, name: statistics.kth(rows(df, by), "_x", place, by, largest, name))
            return num(value, _error(args[:1], plan), e, F.when(value.isNull(), NUM))
        xs = F.sort_array(_numbers(args[:1], plan), asc=not largest)
        bad = (n < 1) | (n > F.size(xs))
        return num(F.when(~bad, F.get(xs, n - 1)), _error(args[:1], plan), e, F.when(bad, NUM))

    return build


define("LARGE", 2)(_kth(True))
define("SMALL", 2)(_kth(False))


def _percentile(scale: float, top: float):
    def build(args, plan):
        k, e = to_num(args[1])
        p = F.floor(k) / scale if scale > 1 else k
        bad = (k < 0) | (F.floor(k) > top if scale > 1 else k > top)
        constant = plan.literals.get(id(args[1]))
        if plan.framed(args[:1]) and isinstance(constant, float) and 0 <= constant <= top:
            value = plan.percentile(_rows(args[:1], plan), _key(args[:1]), (int(constant) if scale > 1 else constant) / scale)
        elif _single(args[:1]) and isinstance(constant, float) and 0 <= constant <= top:
            value = plan(F.percentile(_number(args[0]), F.lit((int(constant) if scale > 1 else constant) / scale)))
        else:
            value = percentile_of(_numbers(args[:1], plan), F.when(~bad, p))
        return num(value, _error(args[:1], plan), e, F.when(bad | (_count(args[:1], plan) == 0), NUM))

    return build


define("PERCENTILE PERCENTILE.INC", 2)(_percentile(1.0, 1.0))
define("QUARTILE QUARTILE.INC", 2)(_percentile(4.0, 4.0))


@define("RANK RANK.EQ", 2, 3)
def _rank(args, plan):
    x, e = to_num(args[0])
    up = to_num(args[2])[0] != 0 if len(args) > 2 else F.lit(False)
    if plan.per_row and id(args[0]) not in plan.literals and plan.framed(args[1:2]):
        ascending = bool(len(args) > 2 and plan.literals.get(id(args[2])))
        rows = _rows(args[1:2], plan)
        key = field(args[0], "num") if args[0].kind in ("num", "cell") else x
        place = plan.frame(lambda df, by, name: statistics.ranks(rows(df, by), "_x", by, ascending, name).withColumnRenamed("_x", "_key"), key)
        return exact(place.cast("double"), e, F.when(place.isNull(), NA))
    y = _number(args[1])
    beyond = plan(F.count_if(F.coalesce(F.when(up, y < x).otherwise(y > x), F.lit(False))))
    there = plan(F.count_if(F.coalesce(y == x, F.lit(False))))
    return exact((beyond + 1).cast("double"), e, F.when(there == 0, NA))


def _truths(args: list[Arg], plan: Plan, fold) -> tuple[list[Column], Column]:
    """Each argument's truth value and the number of usable inputs: numbers and logicals."""
    parts, counts = [], []
    for a in args:
        v = a.val if isinstance(a, Range) else a
        b = F.coalesce(field(v, "bool"), field(v, "num") != 0)
        parts.append(plan(fold(a.of(b))) if isinstance(a, Range) else b)
        counts.append(plan(F.count(a.of(b))) if isinstance(a, Range) else b.isNotNull().cast("bigint"))
    return parts, reduce(add, counts)


def _fold(names: str, aggregate, combine) -> None:
    def build(args, plan):
        parts, n = _truths(args, plan, aggregate)
        return boolean(combine(parts), _error(args, plan), F.when(n == 0, VALUE))

    define(names, 1, 255)(build)


_fold("AND", F.bool_and, lambda ps: reduce(and_, [F.coalesce(p, F.lit(True)) for p in ps]))
_fold("OR", F.bool_or, lambda ps: reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in ps]))
_fold("XOR", lambda b: F.count_if(b), lambda ps: reduce(add, [p.cast("bigint") for p in ps]) % 2 == 1)


def _gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two whole doubles, by at most 80 remainders."""
    step = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] - s["b"] * F.floor(F.try_divide(s["a"], s["b"]))).alias("b"))))
    return step["a"]


def _divisors(least: bool):
    def build(args, plan):
        parts = [plan(F.collect_set(_number(a))) if isinstance(a, Range) else F.array_compact(F.array(_number(a))) for a in args]  # repeats change nothing
        xs = F.transform(F.concat(*parts), lambda x: F.signum(x) * F.floor(F.abs(x)).cast("double"))
        bad = F.exists(xs, lambda x: x < 0)
        if least:
            value = F.aggregate(xs, F.lit(1.0), lambda acc, x: F.when((acc == 0) | (x == 0), 0.0).otherwise(F.try_divide(acc, _gcd(acc, x)) * x))
            bad = bad | (value > 2.0**53)
        else:
            value = F.aggregate(xs, F.lit(0.0), _gcd)
        return num(F.when(~bad, value), _error(args, plan), F.when(bad, NUM))

    return build


define("GCD", 1, 255)(_divisors(False))
define("LCM", 1, 255)(_divisors(True))


def _texts(args: list[Arg], plan: Plan) -> tuple[Column, list[Column | None]]:
    parts, errors = [], []
    for a in args:
        if isinstance(a, Range):
            s, _ = to_text(a.val)
            item = F.struct((plan.order if plan.order is not None else F.lit(0)).alias("o"), s.alias("s"))
            parts.append(F.transform(F.array_sort(plan(F.collect_list(a.of(item)))), lambda x: x["s"]))
        else:
            s, e = to_text(a)
            parts.append(F.array(s))
            errors.append(e)
    return F.concat(*parts), errors


def _joined_texts(args: list[Arg], plan: Plan, between: str, skip: bool) -> Val:
    """The arguments' texts in order; a group whose text would be too long is only measured, never gathered."""
    skip = skip or not between  # what is empty then leaves no trace
    flat = list(enumerate(args))

    def build(df, by, name):
        order = plan.order if plan.order is not None else F.lit(0)
        parts = [F.struct(F.lit(k).alias("k"), order.alias("o"), a.of(to_text(a.val)[0]).alias("s")) for k, a in flat if isinstance(a, Range)]
        rows = df.select(*by, F.explode(F.array(*parts)).alias("_i"))
        direct = [F.struct(F.lit(k).alias("k"), F.lit(None).cast(rows.schema["_i"].dataType["o"].dataType).alias("o"), to_text(a)[0].alias("s")) for k, a in flat if not isinstance(a, Range)]
        if direct:
            groups = df.select(*by).distinct() if by else df.sparkSession.range(1)
            rows = rows.union(groups.select(*by, F.explode(F.array(*direct)).alias("_i")))
        rows = rows.where("_i.s <> ''" if skip else "_i.s is not null")
        sizes = rows.groupBy(*by).agg((F.sum(F.length("_i.s")) + (F.count("*") - 1) * len(between)).alias("_n"))
        short = statistics.joined(rows, sizes.where(F.col("_n") <= MAX_TEXT), by, "inner") if by else rows.join(F.broadcast(sizes.where(F.col("_n") <= MAX_TEXT)), how="cross")
        text_of = F.array_join(F.transform(F.array_sort(F.collect_list("_i")), lambda i: i["s"]), between)
        kept = short.groupBy(*by).agg(text_of.alias("_t"))
        return statistics.joined(sizes, kept, by).select(*by, F.struct(F.col("_t"), (F.col("_n") > MAX_TEXT).alias("_long")).alias(name))

    found = plan.frame(build)
    return text(F.coalesce(found["_t"], F.lit("")), _error(args, plan), *[to_text(a)[1] for a in args if not isinstance(a, Range)], F.when(found["_long"], VALUE))


@define("CONCAT", 1, 255)
def _concat(args, plan):
    if plan.framed(args):
        return _joined_texts(args, plan, "", False)
    items, errors = _texts(args, plan)
    out = F.array_join(items, "")
    return text(out, _error(args, plan), *errors, F.when(F.length(out) > MAX_TEXT, VALUE))


@define("TEXTJOIN", 3, 255)
def _textjoin(args, plan):
    from ..plans.values import to_bool

    between, drop = plan.literals.get(id(args[0])), plan.literals.get(id(args[1]))
    if plan.framed(args[2:]) and isinstance(between, str) and isinstance(drop, (bool, float)):
        return _joined_texts(args[2:], plan, between, bool(drop))
    (d, e), (skip, e2) = to_text(args[0]), to_bool(args[1])
    items, errors = _texts(args[2:], plan)
    kept = F.filter(items, lambda x: ~skip | (x != ""))
    out = F.aggregate(kept, F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNull(), x).otherwise(F.concat(acc, d, x)))
    out = F.coalesce(out, F.lit(""))
    return text(out, e, e2, _error(args[2:], plan), *errors, F.when(F.length(out) > MAX_TEXT, VALUE))


@define("MATCH", 2, 3)
def _match(args, plan):
    """Position in the range's order (plan.order counts from 1)."""
    if not isinstance(args[1], Range) or plan.order is None:
        return error(VALUE)
    if plan.per_row and id(args[0]) not in plan.literals:
        raise NotImplementedError("look up a column's own values with operators.lookup")
    kind = to_num(args[2])[0] if len(args) > 2 else F.lit(1.0)
    v, at = args[1].val, plan.order
    wild = plan.literals.get(id(args[0]))
    same = wildcard_match(F.coalesce(field(v, "str"), F.lit("")), wild) & kind_is(v, "str") if isinstance(wild, str) else compare("=", v, args[0]).col & ~is_blank(v)
    comparable = F.coalesce((kind_is(v, "num") & kind_is(args[0], "num")) | (kind_is(v, "str") & kind_is(args[0], "str")), F.lit(False))
    less, more = compare("<=", v, args[0]).col, compare(">=", v, args[0]).col

    exact_at = plan(F.min(args[1].of(F.when(F.coalesce(same, F.lit(False)), at))))
    # A prefix scan ends before the first item on the wrong side; positions before it are on the right side.
    up = plan(F.min(args[1].of(F.when(comparable & ~less, at))))
    down = plan(F.min(args[1].of(F.when(comparable & ~more, at))))
    end = plan(F.max(args[1].of(F.when(comparable, at))))
    found = F.when(kind == 0, exact_at).when(kind > 0, F.coalesce(up - 1, end)).otherwise(F.coalesce(down - 1, end)).cast("double")
    return exact(F.when(found >= 1, found), args[0].err, F.when(found.isNull() | (found < 1), NA))


@define("INDEX", 2, 3)
def _index(args, plan):
    if not isinstance(args[0], Range) or plan.order is None:
        return error(VALUE)
    k, e = to_num(args[1])
    n = F.floor(k)
    cell = plan(F.max(args[0].of(F.when(plan.order == n, to_cell(args[0].val)))))
    size = plan(F.max(args[0].of(plan.order)))
    return Val("cell", cell, first_error(e, F.when(n < 1, VALUE), F.when(n > size, REF)))
