"""Scalar formula functions: builders from argument values to a value, all built-in expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.values import DIV0, NA, NUM, VALUE, Val, boolean, choose, compare, error, exact, field, first_error, is_blank, kind_is, literal, num, text, to_bool, to_num, to_text

MAX_TEXT = 32767
#: The codes of ERROR.TYPE in order, from 1.
ERROR_CODES = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A")


@dataclass(frozen=True)
class Context:
    """What a formula may need besides its operands; the clock is a parameter, never read."""

    now_serial: float | None = None
    date1904: bool = False

    @property
    def epoch(self) -> Column:
        return F.lit("1904-01-01" if self.date1904 else "1899-12-30").cast("date")


Builder = Callable[[list[Val], Context], Val]
SCALAR: dict[str, tuple[int, int, Builder]] = {}


def define(names: str, least: int, most: int | None = None) -> Callable[[Builder], Builder]:
    def add(f: Builder) -> Builder:
        for name in names.split():
            SCALAR[name] = (least, least if most is None else most, f)
        return f

    return add


def apply(name: str, args: list[Val], ctx: Context) -> Val:
    if name not in SCALAR:
        return error("#NAME?")
    least, most, f = SCALAR[name]
    return f(args, ctx) if least <= len(args) <= most else error(VALUE)


def trunc(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x)).cast("double")


def _nums(args: list[Val]) -> tuple[list[Column], list[Column | None]]:
    pairs = [to_num(a) for a in args]
    return [c for c, _ in pairs], [e for _, e in pairs]


def _math(names: str, f: Callable[[Column], Column], bad: Callable[[Column], Column] | None = None) -> None:
    def build(args: list[Val], ctx: Context) -> Val:
        x, e = to_num(args[0])
        if bad is None:
            return num(f(x), e)
        wrong = bad(x)
        return num(F.when(~wrong, f(x)), e, F.when(wrong, NUM))

    define(names, 1)(build)


_math("ABS", F.abs)
_math("SIGN", F.signum)
_math("SQRT", F.sqrt, lambda x: x < 0)
_math("INT", lambda x: F.floor(x).cast("double"))
_math("EXP", F.exp)
_math("LN", F.ln, lambda x: x <= 0)
_math("LOG10", F.log10, lambda x: x <= 0)
_math("SIN", F.sin)
_math("COS", F.cos)
_math("TAN", F.tan)
_math("ASIN", F.asin, lambda x: F.abs(x) > 1)
_math("ACOS", F.acos, lambda x: F.abs(x) > 1)
_math("ATAN", F.atan)
_math("SINH", F.sinh)
_math("COSH", F.cosh)
_math("TANH", F.tanh)
_math("DEGREES", F.degrees)
_math("RADIANS", F.radians)
_math("SQRTPI", lambda x: F.sqrt(x * math.pi), lambda x: x < 0)


def _to_even(x: Column, odd: int) -> Column:
    m = F.ceil(F.abs(x))
    return F.when(x < 0, -1.0).otherwise(1.0) * F.when(m % 2 == odd, m).otherwise(m + 1).cast("double")


_math("EVEN", lambda x: _to_even(x, 0))
_math("ODD", lambda x: _to_even(x, 1))


@define("PI", 0)
def _pi(args, ctx):
    return literal(math.pi)


define("TRUE", 0)(lambda args, ctx: literal(True))
define("FALSE", 0)(lambda args, ctx: literal(False))


@define("NOT", 1)
def _not(args, ctx):
    b, e = to_bool(args[0])
    return boolean(~b, e)


def _logical(combine):
    def build(args, ctx):
        bools = [to_bool(a) for a in args]
        return boolean(combine([b for b, _ in bools]), *[e for _, e in bools])

    return build


define("AND", 1, 255)(_logical(lambda bs: reduce(and_, bs)))
define("OR", 1, 255)(_logical(lambda bs: reduce(or_, bs)))
define("XOR", 1, 255)(_logical(lambda bs: sum((b.cast("int") for b in bs), F.lit(0)) % 2 == 1))


@define("IF", 2, 3)
def _if(args, ctx):
    b, e = to_bool(args[0])
    return _guarded(choose([(b, args[1])], args[2] if len(args) > 2 else literal(False)), e)


def _guarded(v: Val, e: Column | None) -> Val:
    """The value with an error of a condition before its own."""
    return v if e is None else Val(v.kind, v.col, first_error(e, v.err))


@define("IFS", 2, 254)
def _ifs(args, ctx):
    if len(args) % 2:
        return error(VALUE)
    out = error(NA)
    for c, v in reversed(list(zip(args[::2], args[1::2], strict=True))):
        b, e = to_bool(c)
        out = _guarded(choose([(b, v)], out), e)
    return out


@define("SWITCH", 3, 254)
def _switch(args, ctx):
    rest = args[1:]
    pairs, other = list(zip(rest[::2], rest[1::2], strict=False)), rest[-1] if len(rest) % 2 else error(NA)
    same = [((kind_is(args[0], "num") & kind_is(k, "num")) | (kind_is(args[0], "str") & kind_is(k, "str")) | (kind_is(args[0], "bool") & kind_is(k, "bool")) | (is_blank(args[0]) & is_blank(k))) & compare("=", args[0], k).col for k, _ in pairs]
    return _guarded(choose([(F.coalesce(s, F.lit(False)), v) for s, (_, v) in zip(same, pairs, strict=True)], other), args[0].err)


@define("IFERROR", 2)
def _iferror(args, ctx):
    return args[0] if args[0].err is None else choose([(args[0].err.isNull(), Val(args[0].kind, args[0].col))], args[1])


@define("IFNA", 2)
def _ifna(args, ctx):
    return args[0] if args[0].err is None else choose([(F.coalesce(args[0].err != NA, F.lit(True)), args[0])], args[1])


@define("NA", 0)
def _na(args, ctx):
    return error(NA)


def _is(names: str, f: Callable[[Val], Column]) -> None:
    def build(args, ctx):
        v = args[0]
        none = F.lit(True) if v.err is None else v.err.isNull()
        return boolean(F.coalesce(f(v) & none, F.lit(False)))

    define(names, 1)(build)


_is("ISBLANK", is_blank)
_is("ISNUMBER", lambda v: kind_is(v, "num"))
_is("ISTEXT", lambda v: kind_is(v, "str"))
_is("ISLOGICAL", lambda v: kind_is(v, "bool"))


def _err_is(names: str, f: Callable[[Column], Column]) -> None:
    define(names, 1)(lambda args, ctx: literal(False) if args[0].err is None else boolean(F.coalesce(f(args[0].err), F.lit(False))))


_err_is("ISERROR", lambda e: e.isNotNull())
_err_is("ISERR", lambda e: e != NA)
_err_is("ISNA", lambda e: e == NA)


@define("ISNONTEXT", 1)
def _isnontext(args, ctx):
    v = args[0]
    return boolean(~kind_is(v, "str") if v.err is None else v.err.isNotNull() | ~kind_is(v, "str"))


def _parity(odd: int):
    def build(args, ctx):
        x, e = to_num(args[0])
        return boolean(F.floor(F.abs(x)) % 2 == odd, e)

    return build


define("ISEVEN", 1)(_parity(0))
define("ISODD", 1)(_parity(1))


@define("N", 1)
def _n(args, ctx):
    v = args[0]
    return exact(F.coalesce(field(v, "num"), field(v, "bool").cast("double"), F.lit(0.0)), v.err)


@define("T", 1)
def _t(args, ctx):
    return text(F.coalesce(field(args[0], "str"), F.lit("")), args[0].err)


@define("TYPE", 1)
def _type(args, ctx):
    v = args[0]
    code = F.when(kind_is(v, "str"), 2.0).when(kind_is(v, "bool"), 4.0).otherwise(1.0)
    return exact(code if v.err is None else F.when(v.err.isNotNull(), 16.0).otherwise(code))


@define("ERROR.TYPE", 1)
def _error_type(args, ctx):
    e = args[0].err
    if e is None:
        return error(NA)
    code = F.array_position(F.array(*map(F.lit, ERROR_CODES)), e).cast("double")
    return exact(code, F.when(e.isNull(), NA))


@define("MOD", 2)
def _mod(args, ctx):
    (n, d), es = _nums(args)
    return num(F.when(d != 0, n - d * F.floor(F.try_divide(n, d))), *es, F.when(d == 0, DIV0))


@define("QUOTIENT", 2)
def _quotient(args, ctx):
    (a, b), es = _nums(args)
    return num(trunc(F.try_divide(a, b)), *es, F.when(b == 0, DIV0))


@define("POWER", 2)
def _power(args, ctx):
    (a, b), es = _nums(args)
    return num(F.pow(a, b), *es)


def _rounding(step: Callable[[Column], Column]):
    def build(args, ctx):
        (x, *rest), es = _nums(args)
        f = F.pow(F.lit(10.0), trunc(rest[0]) if rest else F.lit(0.0))
        return num(F.try_divide(F.signum(x) * step(F.abs(x) * f).cast("double"), f), *es)

    return build


define("ROUND", 1, 2)(_rounding(lambda m: F.floor(m + 0.5)))
define("ROUNDUP", 1, 2)(_rounding(F.ceil))
define("ROUNDDOWN TRUNC", 1, 2)(_rounding(F.floor))


def _multiple(mode: str):
    def build(args, ctx):
        (x, s), es = _nums(args)
        q = F.try_divide(F.abs(x), F.abs(s))
        whole = F.floor(q + 0.5)
        if mode == "near":
            low = F.floor(q)
            units = F.when(F.abs(q - low - 0.5) < 1e-9, low + 1).otherwise(whole)
        else:
            snapped = F.when(F.abs(q - whole) < 1e-9, whole.cast("double")).otherwise(q)
            units = F.ceil(snapped) if mode == "up" else F.floor(snapped)
        value = F.when(s == 0, 0.0).otherwise(F.when(x < 0, -1.0).otherwise(1.0) * units * F.abs(s))
        return num(value, *es, F.when((s != 0) & (x != 0) & ((x > 0) != (s > 0)), NUM))

    return build


define("CEILING", 2)(_multiple("up"))
define("FLOOR", 2)(_multiple("down"))
define("MROUND", 2)(_multiple("near"))


@define("LOG", 1, 2)
def _log(args, ctx):
    (x, *rest), es = _nums(args)
    b = rest[0] if rest else F.lit(10.0)
    bad = (x <= 0) | (b <= 0) | (b == 1)
    return num(F.when(~bad, F.try_divide(F.ln(x), F.ln(b))), *es, F.when(bad, NUM))


@define("ATAN2", 2)
def _atan2(args, ctx):
    (x, y), es = _nums(args)
    return num(F.atan2(y, x), *es, F.when((x == 0) & (y == 0), NUM))


def _falling(n: Column, k: Column, step: Callable[[Column, Column], Column]) -> Column:
    count = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(count, F.lit(1.0), lambda acc, i: step(acc, i))


@define("FACT", 1)
def _fact(args, ctx):
    x, e = to_num(args[0])
    n = trunc(x)
    bad = (n < 0) | (n > 170)
    return num(F.when(~bad, _falling(n, n, lambda acc, i: acc * i)), e, F.when(bad, NUM))


def _choices(divide: bool):
    def build(args, ctx):
        (a, b), es = _nums(args)
        n, k = trunc(a), trunc(b)
        bad = (n < 0) | (k < 0) | (k > n) | (k > 100_000)
        value = _falling(n, F.when(bad, 0.0).otherwise(k), (lambda acc, i: acc * (n - k + i) / i) if divide else (lambda acc, i: acc * (n - i + 1)))
        return num(F.when(~bad, F.floor(value + 0.5).cast("double") if divide else value), *es, F.when(bad, NUM))

    return build


define("COMBIN", 2)(_choices(True))
define("PERMUT", 2)(_choices(False))


def utf16_length(s: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("double")


@define("LEN", 1)
def _len(args, ctx):
    s, e = to_text(args[0])
    return exact(utf16_length(s), e)


def _text(names: str, f: Callable[[Column], Column]) -> None:
    def build(args, ctx):
        s, e = to_text(args[0])
        return text(f(s), e)

    define(names, 1)(build)


_text("LOWER", F.lower)
_text("UPPER", F.upper)
_text("TRIM", lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " ")))
_text("CLEAN", lambda s: F.regexp_replace(s, r"[\x00-\x1f]", ""))
#: Every run of ASCII letters starts with a capital.
_text("PROPER", lambda s: F.array_join(F.transform(F.regexp_extract_all(s, F.lit(r"([A-Za-z]+|[^A-Za-z]+)")), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), ""))


def _edge(take: Callable[[Column, Column], Column]):
    def build(args, ctx):
        s, e = to_text(args[0])
        n, e2 = to_num(args[1]) if len(args) > 1 else (F.lit(1.0), None)
        k = trunc(n).cast("int")
        return text(F.when(k > 0, take(s, k)).otherwise(""), e, e2, F.when(k < 0, VALUE))

    return build


define("LEFT", 1, 2)(_edge(lambda s, k: F.left(s, k)))
define("RIGHT", 1, 2)(_edge(lambda s, k: F.right(s, k)))


@define("MID", 3)
def _mid(args, ctx):
    s, e = to_text(args[0])
    (start, length), es = _nums(args[1:])
    a, n = trunc(start).cast("int"), trunc(length).cast("int")
    bad = (a < 1) | (n < 0)
    return text(F.when(~bad, F.substring(s, a, n)), e, *es, F.when(bad, VALUE))


@define("REPLACE", 4)
def _replace(args, ctx):
    s, e = to_text(args[0])
    (start, length), es = _nums(args[1:3])
    new, e2 = to_text(args[3])
    a, n = trunc(start).cast("int"), trunc(length).cast("int")
    bad = (a < 1) | (n < 0)
    return text(F.when(~bad, F.concat(F.substring(s, F.lit(1), a - 1), new, F.substring(s, a + n, F.length(s)))), e, *es, e2, F.when(bad, VALUE))


@define("SUBSTITUTE", 3, 4)
def _substitute(args, ctx):
    (s, e), (old, e2), (new, e3) = map(to_text, args[:3])
    every = F.when(old == "", s).otherwise(F.replace(s, old, new))
    if len(args) == 3:
        return text(every, e, e2, e3)
    k, e4 = to_num(args[3])
    n = trunc(k).cast("int")
    before = F.call_function("substring_index", s, old, n)
    has = (F.length(before) < F.length(s)) & (old != "")
    return text(F.when(has, F.concat(before, new, F.substring(s, F.length(before) + F.length(old) + 1, F.length(s)))).otherwise(s), e, e2, e3, e4, F.when(n < 1, VALUE))


@define("REPT", 2)
def _rept(args, ctx):
    s, e = to_text(args[0])
    n, e2 = to_num(args[1])
    k = trunc(n).cast("int")
    bad = (k < 0) | (F.length(s) * k > MAX_TEXT)
    return text(F.when(~bad, F.repeat(s, k)), e, e2, F.when(bad, VALUE))


@define("EXACT", 2)
def _exact(args, ctx):
    (a, e), (b, e2) = map(to_text, args)
    return boolean(a == b, e, e2)


def _locate(fold: Callable[[Column], Column]):
    def build(args, ctx):
        (needle, e), (hay, e2) = map(to_text, args[:2])
        start, e3 = to_num(args[2]) if len(args) > 2 else (F.lit(1.0), None)
        k = trunc(start).cast("int")
        place = F.call_function("locate", fold(needle), fold(hay), F.greatest(k, F.lit(1)))
        return exact(place.cast("double"), e, e2, e3, F.when((k < 1) | (place < 1), VALUE))

    return build


define("FIND", 2, 3)(_locate(lambda s: s))
define("SEARCH", 2, 3)(_locate(F.lower))


@define("VALUE", 1)
def _value(args, ctx):
    n, e = to_num(args[0])
    return exact(n, e)


@define("CONCATENATE", 1, 255)
def _concatenate(args, ctx):
    pairs = [to_text(a) for a in args]
    return text(F.concat(*[s for s, _ in pairs]), *[e for _, e in pairs])


@define("CHAR", 1)
def _char(args, ctx):
    x, e = to_num(args[0])
    n = trunc(x).cast("int")
    bad = (n < 1) | (n > 255)
    return text(F.when(~bad, F.char(n)), e, F.when(bad, VALUE))


@define("UNICHAR", 1)
def _unichar(args, ctx):
    x, e = to_num(args[0])
    n = trunc(x).cast("bigint")
    bad = (n < 1) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    made = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return text(F.when(~bad, made), e, F.when(bad, VALUE))


@define("CODE", 1)
def _code(args, ctx):
    s, e = to_text(args[0])
    unit = F.conv(F.substring(F.hex(F.encode(s, "UTF-16BE")), 1, 4), 16, 10).cast("double")
    return exact(unit, e, F.when(s == "", VALUE))


@define("UNICODE", 1)
def _unicode(args, ctx):
    s, e = to_text(args[0])
    return exact(F.ascii(s).cast("double"), e, F.when(s == "", VALUE))


@define("CHOOSE", 2, 255)
def _choose(args, ctx):
    x, e = to_num(args[0])
    k = trunc(x)
    return _guarded(choose([(k == i, v) for i, v in enumerate(args[1:], 1)], error(VALUE)), e)


define("NOW", 0)(lambda args, ctx: error(VALUE) if ctx.now_serial is None else literal(float(ctx.now_serial)))
define("TODAY", 0)(lambda args, ctx: error(VALUE) if ctx.now_serial is None else literal(float(math.floor(ctx.now_serial))))


def serial_date(serial: Column, ctx: Context) -> Column:
    return F.date_add(ctx.epoch, F.floor(serial).cast("int"))


def date_serial(date: Column, ctx: Context) -> Column:
    return F.datediff(date, ctx.epoch).cast("double")


def _date_part(names: str, f: Callable[[Column], Column]) -> None:
    def build(args, ctx):
        x, e = to_num(args[0])
        bad = (x < 0) | (x > 2958465 + 1)
        return exact(F.when(~bad, f(serial_date(F.when(~bad, x), ctx)).cast("double")), e, F.when(bad, NUM))

    define(names, 1)(build)


_date_part("YEAR", F.year)
_date_part("MONTH", F.month)
_date_part("DAY", F.day)
_date_part("ISOWEEKNUM", F.weekofyear)


@define("WEEKDAY", 1, 2)
def _weekday(args, ctx):
    (x, *rest), es = _nums(args)
    kind = trunc(rest[0]) if rest else F.lit(1.0)
    monday = F.weekday(serial_date(F.when(x >= 0, x), ctx))
    value = F.when(kind == 1, (monday + 1) % 7 + 1).when(kind == 2, monday + 1).when(kind == 3, monday)
    return exact(value.cast("double"), *es, F.when((x < 0) | ~kind.isin(1.0, 2.0, 3.0), NUM))


@define("WEEKNUM", 1, 2)
def _weeknum(args, ctx):
    (x, *rest), es = _nums(args)
    kind = trunc(rest[0]) if rest else F.lit(1.0)
    date = serial_date(F.when(x >= 0, x), ctx)
    # The day a week begins on, Sunday 0: types 1 and 17 Sunday, 2 and 11 Monday, 12 to 16 the days after.
    first = F.when(kind.isin(1.0, 17.0), 0).when(kind.isin(2.0, 11.0), 1).when(kind.between(12, 16), kind.cast("int") - 10)
    jan1 = F.dayofweek(F.trunc(date, "year")) - 1
    plain = F.floor((F.dayofyear(date) + F.pmod(jan1 - first, F.lit(7)) - 1) / 7) + 1
    return exact(F.when(kind == 21, F.weekofyear(date)).otherwise(plain).cast("double"), *es, F.when((x < 0) | (first.isNull() & (kind != 21)), NUM))


@define("DATE", 3)
def _date(args, ctx):
    (y, m, d), es = _nums(args)
    y, m, d = trunc(y), trunc(m), trunc(d)
    year = F.when(y.between(0, 99), y + 1900).otherwise(y).cast("int")
    ok = year.between(1, 9999) & (F.abs(m) < 100_000) & (F.abs(d) < 3_000_000)
    serial = date_serial(F.date_add(F.add_months(F.make_date(F.when(ok, year), F.lit(1), F.lit(1)), m.cast("int") - 1), d.cast("int") - 1), ctx)
    return exact(serial, *es, F.when(~ok | (serial < 0), NUM))


def _months(end: bool):
    def build(args, ctx):
        (x, m), es = _nums(args)
        moved = F.add_months(serial_date(F.when(x >= 0, x), ctx), trunc(m).cast("int"))
        serial = date_serial(F.last_day(moved) if end else moved, ctx)
        return exact(serial, *es, F.when((x < 0) | (serial < 0), NUM))

    return build


define("EDATE", 2)(_months(False))
define("EOMONTH", 2)(_months(True))


@define("DAYS", 2)
def _days(args, ctx):
    (a, b), es = _nums(args)
    return num((F.floor(a) - F.floor(b)).cast("double"), *es)


def _clock(names: str, f: Callable[[Column], Column]) -> None:
    def build(args, ctx):
        x, e = to_num(args[0])
        seconds = F.floor((x - F.floor(x)) * 86400 + 0.5) % 86400
        return exact(f(seconds).cast("double"), e, F.when(x < 0, NUM))

    define(names, 1)(build)


_clock("HOUR", lambda s: F.floor(s / 3600))
_clock("MINUTE", lambda s: F.floor(s / 60) % 60)
_clock("SECOND", lambda s: s % 60)


@define("TIME", 3)
def _time(args, ctx):
    (h, m, s), es = _nums(args)
    return num(F.pmod(trunc(h) * 3600 + trunc(m) * 60 + trunc(s), F.lit(86400.0)) / 86400.0, *es)
