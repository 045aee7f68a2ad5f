"""Typed formula values as Columns.

A value has a static kind (num, str, bool, or cell when it is only known per row), a Column
and an optional error Column (null where there is no error). A null Column without an error
is a blank. A cell is a struct of kind, num, str and bool.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE, NUM, DIV0, NA, REF, NAME = "#VALUE!", "#NUM!", "#DIV/0!", "#N/A", "#REF!", "#NAME?"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_TYPES = {"num": "double", "str": "string", "bool": "boolean"}
_RADIX = r"^\s*0[xX][0-9a-fA-F]+\s*$"


@dataclass(frozen=True)
class Val:
    kind: str
    col: Column
    err: Column | None = None
    empty: bool = False  # nothing but an error, which fits any kind

    def fail(self, *more: Column | None) -> Val:
        return Val(self.kind, self.col, first_error(self.err, *more))

    @property
    def clean(self) -> Column:
        """The value, null where there is an error."""
        return self.col if self.err is None else F.when(self.err.isNull(), self.col)


def first_error(*errors: Column | None) -> Column | None:
    real = [e for e in errors if e is not None]
    return None if not real else real[0] if len(real) == 1 else F.coalesce(*real)


def num(col: Column, *errors: Column | None) -> Val:
    """A number; what is not finite is #NUM!."""
    return Val("num", col, first_error(*errors, F.when(F.isnan(col) | (F.abs(col) == float("inf")), NUM)))


def exact(col: Column, *errors: Column | None) -> Val:
    """A number that is finite by construction."""
    return Val("num", col, first_error(*errors))


def text(col: Column, *errors: Column | None) -> Val:
    return Val("str", col, first_error(*errors))


def boolean(col: Column, *errors: Column | None) -> Val:
    return Val("bool", col, first_error(*errors))


def error(code: str) -> Val:
    return Val("num", F.lit(None).cast("double"), F.lit(code), True)


def literal(x: float | str | bool) -> Val:
    return Val("bool" if isinstance(x, bool) else "num" if isinstance(x, float) else "str", F.lit(x))


def column_value(col: Column, kind: T.DataType) -> Val:
    """A table's column: dates and timestamps become serial day numbers."""
    if isinstance(kind, T.BooleanType):
        return Val("bool", col)
    if isinstance(kind, T.StringType):
        return Val("str", col)
    if isinstance(kind, T.NumericType):
        return Val("num", col.cast("double"))
    if isinstance(kind, T.DateType):
        return Val("num", F.datediff(col, F.lit("1899-12-30").cast("date")).cast("double"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return Val("num", F.unix_micros(col.cast("timestamp")) / 86_400_000_000.0 + 25569.0)
    if isinstance(kind, T.StructType) and {"kind", "num", "str", "bool"} <= set(kind.names):
        return Val("cell", col, F.when(col["kind"] == "err", col["err"]) if "err" in kind.names else None)
    return error(VALUE)


def parse_number(s: Column) -> Column:
    """Text as a number, null if it is none."""
    radix = F.conv(F.substring(F.trim(s), 3, 40), 16, 10).cast("double")
    return F.when(s.rlike(_NUMBER), F.expr("try_cast(0 as double)") + F.trim(s).try_cast("double")).when(s.rlike(_RADIX), radix)


def number_text(x: Column) -> Column:
    """The shortest text that reads back as the number, with exponents only below 1e-6 and from 1e21."""
    s, size = x.cast("string"), F.abs(x)
    plain = F.regexp_replace(s.try_cast("decimal(38,17)").cast("string"), r"\.?0+$", "")
    small = F.regexp_replace(s.try_cast("decimal(38,30)").cast("string"), r"\.?0+$", "")
    sci = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\.0E", "E"), r"E(\d)", "e+$1"), "E-", "e-")
    return (
        F.when(x == 0, "0")
        .when((size < 1e18) & (x == F.floor(x)), x.try_cast("bigint").cast("string"))
        .when((size >= 1e18) & (size < 1e21), s.try_cast("decimal(38,0)").cast("string"))
        .when((size >= 1e-3) & (size < 1e7), F.regexp_replace(s, r"\.0$", ""))
        .when(size >= 1e21, sci)
        .when(size >= 1e-3, plain)
        .when(size >= 1e-6, small)
        .otherwise(sci)
    )


def to_num(v: Val) -> tuple[Column, Column | None]:
    if v.kind == "num":
        return F.coalesce(v.col, F.lit(0.0)), v.err
    if v.kind == "bool":
        return F.coalesce(v.col.cast("double"), F.lit(0.0)), v.err
    if v.kind == "str":
        n = parse_number(v.col)
        return F.when(v.col.isNull(), 0.0).otherwise(n), first_error(v.err, F.when(v.col.isNotNull() & n.isNull(), VALUE))
    n = F.when(v.col["kind"] == "num", v.col["num"]).when(v.col["kind"] == "bool", v.col["bool"].cast("double")).when(v.col["kind"] == "str", parse_number(v.col["str"])).otherwise(0.0)
    return n, first_error(v.err, F.when((v.col["kind"] == "str") & n.isNull(), VALUE))


def to_text(v: Val) -> tuple[Column, Column | None]:
    flag = lambda b: F.when(b, "TRUE").otherwise("FALSE")
    if v.kind == "num":
        s = number_text(v.col)
    elif v.kind == "bool":
        s = F.when(v.col.isNotNull(), flag(v.col))
    elif v.kind == "str":
        s = v.col
    else:
        k = v.col["kind"]
        s = F.when(k == "num", number_text(v.col["num"])).when(k == "bool", flag(v.col["bool"])).when(k == "str", v.col["str"])
    return F.coalesce(s, F.lit("")), v.err


def to_bool(v: Val) -> tuple[Column, Column | None]:
    def of_text(s: Column) -> Column:
        return F.when(F.upper(F.trim(s)) == "TRUE", True).when(F.upper(F.trim(s)) == "FALSE", False).otherwise(parse_number(s) != 0)

    if v.kind == "bool":
        return F.coalesce(v.col, F.lit(False)), v.err
    if v.kind == "num":
        return F.coalesce(v.col != 0, F.lit(False)), v.err
    if v.kind == "str":
        b = of_text(v.col)
        return F.when(v.col.isNull(), False).otherwise(b), first_error(v.err, F.when(v.col.isNotNull() & b.isNull(), VALUE))
    k = v.col["kind"]
    b = F.when(k == "bool", v.col["bool"]).when(k == "num", v.col["num"] != 0).when(k == "str", of_text(v.col["str"])).otherwise(False)
    return b, first_error(v.err, F.when((k == "str") & b.isNull(), VALUE))


def to_cell(v: Val) -> Column:
    if v.kind == "cell":
        return v.col
    none = {"num": F.lit(None).cast("double"), "str": F.lit(None).cast("string"), "bool": F.lit(None).cast("boolean")} | {v.kind: v.col}
    return F.struct(F.when(v.col.isNull(), "blank").otherwise(v.kind).alias("kind"), *[none[k].alias(k) for k in ("num", "str", "bool")])


def is_blank(v: Val) -> Column:
    return v.col["kind"] == "blank" if v.kind == "cell" else v.col.isNull()


def kind_is(v: Val, kind: str) -> Column:
    return v.col["kind"] == kind if v.kind == "cell" else F.lit(v.kind == kind) & v.col.isNotNull()


def field(v: Val, kind: str) -> Column:
    """The value as that kind without coercion, null if it is of another."""
    if v.kind == "cell":
        return F.when(v.col["kind"] == kind, v.col[kind])
    return v.col if v.kind == kind else F.lit(None).cast({"num": "double", "str": "string", "bool": "boolean"}[kind])


def choose(branches: list[tuple[Column, Val]], other: Val) -> Val:
    """The first branch whose condition holds; kinds that differ meet as cells, errors only count where chosen."""
    kinds = {v.kind for v in (*(v for _, v in branches), other) if not v.empty} or {"num"}
    same = len(kinds) == 1
    if same and kinds <= set(_TYPES):
        (kind,) = kinds
        fit = lambda v: Val(kind, F.lit(None).cast(_TYPES[kind]), v.err) if v.empty else v
        branches, other = [(c, fit(v)) for c, v in branches], fit(other)
    vals = [v for _, v in branches] + [other]
    same = len({v.kind for v in vals}) == 1
    get = (lambda v: v.col) if same else to_cell

    def pick(part) -> Column:
        out = reduce(lambda c, b: c.when(b[0], part(b[1])), branches[1:], F.when(branches[0][0], part(branches[0][1])))
        return out.otherwise(part(other))

    err = None if all(v.err is None for v in vals) else pick(lambda v: F.lit(None).cast("string") if v.err is None else v.err)
    return Val(vals[0].kind if same else "cell", pick(get), err)


def compare(symbol: str, a: Val, b: Val) -> Val:
    """Numbers before text before logicals; text without case; a blank takes the other side's neutral."""
    err = first_error(a.err, b.err)
    ops = {"=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}
    op = ops[symbol]
    neutral = {"num": 0.0, "str": "", "bool": False}
    if a.kind == b.kind != "cell":
        fold = F.lower if a.kind == "str" else (lambda c: c)
        return boolean(op(fold(F.coalesce(a.col, F.lit(neutral[a.kind]))), fold(F.coalesce(b.col, F.lit(neutral[b.kind])))), err)
    rank = lambda v: F.when(kind_is(v, "num"), 0).when(kind_is(v, "str"), 1).when(kind_is(v, "bool"), 2)
    ra, rb = F.coalesce(rank(a), rank(b), F.lit(0)), F.coalesce(rank(b), rank(a), F.lit(0))
    keys = [F.coalesce(field(v, "num"), F.lit(0.0)) for v in (a, b)], [F.lower(F.coalesce(field(v, "str"), F.lit(""))) for v in (a, b)], [F.coalesce(field(v, "bool"), F.lit(False)) for v in (a, b)]
    same = F.when(ra == 0, op(*keys[0])).when(ra == 1, op(*keys[1])).otherwise(op(*keys[2]))
    return boolean(F.when(ra == rb, same).otherwise(op(ra, rb)), err)
