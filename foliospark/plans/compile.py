"""Formulas compiled to Columns.

In a formula a bare name is a column of the table: one value a row in scalar functions and
operators, the whole column in range functions; [@name] is this row's value everywhere. On a
table of sparse cells (row, col, kind, num, str, bool, err) references such as A1 and B2:C9
are predicates over rows. All formulas of one call share one aggregate; for a column per row it
is joined back to the rows, so no group, and no table without groups, is gathered in a window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import aggregate, scalar
from ..functions.aggregate import PREFIX, Plan, Range
from ..operators import statistics
from .syntax import FormulaError, parse, parse_cell
from .values import NA, NAME, REF, VALUE, Val, choose, column_value, compare, error, exact, first_error, literal, num, text, to_bool, to_num, to_text

_CELL_FIELDS = {"row", "col", "kind", "num", "str", "bool", "err"}
#: Functions that take ranges only in some calls.
_EITHER = {"AND", "OR", "XOR"}
#: Functions whose first argument alone is a range.
_ONE_RANGE = {"LARGE", "SMALL", "PERCENTILE", "PERCENTILE.INC", "QUARTILE", "QUARTILE.INC"}


class Compiler:
    def __init__(self, schema: T.StructType, plan: Plan, ctx: scalar.Context, names: Mapping[str, str] | None = None):
        self.types = {f.name.lower(): f for f in schema.fields}
        self.plan, self.ctx, self.names = plan, ctx, {k.lower(): v for k, v in (names or {}).items()}
        self.sparse = set(self.types) >= _CELL_FIELDS
        self.kept: list[Val] = []  # keeps literal values alive, as plan.literals is keyed by identity
        self.depth = 0

    def column(self, name: str) -> Val | None:
        f = self.types.get(name.lower())
        return None if f is None else column_value(F.col(f"`{f.name}`"), f.dataType)

    def _literal(self, x) -> Val:
        v = literal(x)
        self.kept.append(v)
        self.plan.literals[id(v)] = x
        return v

    def area(self, first: tuple, last: tuple) -> Range | None:
        if not self.sparse:
            return None
        (r0, c0, *_), (r1, c1, *_) = first, last
        r0, r1, c0, c1 = min(r0, r1), max(r0, r1), min(c0, c1), max(c0, c1)
        cell = F.struct("kind", "num", "str", "bool")
        where = F.col("row").between(r0, r1) & F.col("col").between(c0, c1)
        return Range(Val("cell", cell, F.when(F.col("kind") == "err", F.col("err"))), where, (r1 - r0 + 1) * (c1 - c0 + 1))

    def scalar(self, node: tuple) -> Val:
        kind = node[0]
        if kind in ("num", "str", "bool"):
            return self._literal(node[1])
        if kind == "err":
            return error(node[1])
        if kind == "missing":
            return exact(F.lit(None).cast("double"))
        if kind in ("name", "row"):
            found = self.column(node[1])
            if found is None and kind == "name" and node[1].lower() in self.names:
                return self._nested(self.names[node[1].lower()])
            return found or error(NAME)
        if kind == "ref":
            one = self.area(node[2], node[2])
            if one is None:
                return error(REF)
            cell = self.plan(F.max(one.of(one.val.col)))
            return Val("cell", cell, self.plan(F.max(one.of(one.val.err))))
        if kind == "range":
            return error(VALUE)
        if kind == "array":
            return self.scalar(node[1][0][0])
        if kind in ("neg", "pos", "pct"):
            x, e = to_num(self.scalar(node[1]))
            return num(-x if kind == "neg" else x if kind == "pos" else x / 100.0, e)
        if kind == "op":
            return self.operator(node[1], self.scalar(node[2]), self.scalar(node[3]))
        return self.call(node[1], node[2])

    def _nested(self, formula: str) -> Val:
        self.depth += 1
        if self.depth > 16:
            raise FormulaError("defined names refer to each other")
        out = self.scalar(parse(formula))
        self.depth -= 1
        return out

    def operator(self, symbol: str, a: Val, b: Val) -> Val:
        if symbol in ("=", "<>", "<", ">", "<=", ">="):
            return compare(symbol, a, b)
        if symbol == "&":
            (x, e), (y, e2) = to_text(a), to_text(b)
            return text(F.concat(x, y), e, e2)
        (x, e), (y, e2) = to_num(a), to_num(b)
        if symbol == "/":
            return num(F.try_divide(x, y), e, e2, F.when(y == 0, "#DIV/0!"))
        return num({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "^": lambda: F.pow(x, y)}[symbol](), e, e2)

    def argument(self, node: tuple) -> Range | Val:
        """An argument of a range function: anything that varies by row and holds no aggregate is a range."""
        if node[0] == "range":
            return self.area(node[2], node[3]) or error(REF)
        if node[0] == "ref" and self.sparse:
            return self.area(node[2], node[2])
        if self.by_row(node):
            return Range(self.scalar(node))
        return self.scalar(node)

    def by_row(self, node: tuple) -> bool:
        if node[0] == "name":
            return node[1].lower() in self.types
        if node[0] in ("neg", "pos", "pct"):
            return self.by_row(node[1])
        if node[0] == "op":
            return self.by_row(node[2]) or self.by_row(node[3])
        if node[0] == "call":
            return (node[1] in _EITHER or node[1] not in aggregate.RANGE) and any(map(self.by_row, node[2]))
        return False

    def call(self, name: str, args: Sequence[tuple]) -> Val:
        if name in ("ROW", "COLUMN", "ROWS", "COLUMNS", "ISREF"):
            return self.reference_call(name, args)
        if name in ("VLOOKUP", "HLOOKUP"):
            return self.lookup(name, args)
        if name in ("MATCH", "INDEX") and args and args[name == "MATCH"][0] == "array":
            return self.array_call(name, args)
        if name in aggregate.RANGE and (name not in _EITHER or any(a[0] in ("range", "ref") for a in args) or (not self.plan.per_row and any(map(self.by_row, args)))):
            values = []
            for k, a in enumerate(args):
                direct = (name in ("RANK", "RANK.EQ") and k != 1) or (name == "MATCH" and k != 1) or (name == "INDEX" and k) or (name in _ONE_RANGE and k) or (name == "TEXTJOIN" and k < 2)
                if a[0] == "array" and not direct:
                    items = [self.scalar(x) for row in a[1] for x in row]
                    values += [aggregate.Items(tuple(items))] if name in _ONE_RANGE else items
                else:
                    values.append(self.scalar(a) if direct else self.argument(a))
            return aggregate.apply(name, values, self.plan)
        return scalar.apply(name, [self.scalar(a) for a in args], self.ctx)

    def reference_call(self, name: str, args: Sequence[tuple]) -> Val:
        if name == "ISREF":
            return self._literal(args[0][0] in ("ref", "range", "name", "row")) if len(args) == 1 else error(VALUE)
        axis = 0 if name.startswith("ROW") else 1
        if not args and not name.endswith("S"):
            key = ("row", "col")[axis]
            return exact(F.col(key).cast("double") + 1) if key in self.types else error(VALUE)
        if len(args) != 1 or args[0][0] not in ("ref", "range"):
            return error(VALUE)
        first, last = args[0][2], args[0][-1]
        low, high = sorted((first[axis], last[axis]))
        return self._literal(float(high - low + 1 if name.endswith("S") else low + 1))

    def lookup(self, name: str, args: Sequence[tuple]) -> Val:
        """A lookup in an array constant; tables of any size are joined, see operators.lookup."""
        if not 3 <= len(args) <= 4 or args[1][0] != "array":
            return error(VALUE)
        rows = args[1][1] if name == "VLOOKUP" else tuple(zip(*args[1][1], strict=True))
        k = args[2]
        if k[0] != "num" or k[1] < 1:
            return error(VALUE)
        if k[1] > len(rows[0]):
            return error(REF)
        approximate = to_bool(self.scalar(args[3]))[0] if len(args) == 4 else F.lit(True)
        key = self.scalar(args[0])
        keys, values = [self.scalar(r[0]) for r in rows], [self.scalar(r[int(k[1]) - 1]) for r in rows]
        near = self._prefix(keys, values, key)
        exact_hit = choose([(compare("=", c, key).col, v) for c, v in zip(keys, values, strict=True)], error(NA))
        out = choose([(approximate, near)], exact_hit)
        return Val(out.kind, out.col, first_error(key.err, out.err))

    def _prefix(self, keys: list[Val], values: list[Val], key: Val) -> Val:
        """The value of the last key before the first greater one."""
        out = values[-1]
        for i in range(len(keys) - 1, -1, -1):
            out = choose([(compare(">", keys[i], key).col, values[i - 1] if i else error(NA))], out)
        return out

    def array_call(self, name: str, args: Sequence[tuple]) -> Val:
        if name == "INDEX":
            rows = args[0][1]
            if any(a[0] != "num" for a in args[1:]):
                return error(VALUE)
            r, c = int(args[1][1]), int(args[2][1]) if len(args) > 2 else 1
            if len(args) == 2 and len(rows) == 1:
                r, c = 1, r
            if r < 1 or c < 1:
                return error(VALUE)
            return self.scalar(rows[r - 1][c - 1]) if r <= len(rows) and c <= len(rows[0]) else error(REF)
        flat = [self.scalar(x) for row in args[1][1] for x in row]
        key, places = self.scalar(args[0]), [self._literal(float(i)) for i in range(1, len(flat) + 1)]
        kind = to_num(self.scalar(args[2]))[0] if len(args) > 2 else F.lit(1.0)
        hit = choose([(compare("=", c, key).col, p) for c, p in zip(flat, places, strict=True)], error(NA))
        down = places[-1]
        for i in range(len(flat) - 1, -1, -1):
            down = choose([(compare("<", flat[i], key).col, places[i - 1] if i else error(NA))], down)
        return choose([(kind == 0, hit), (kind > 0, self._prefix(flat, places, key))], down)


def _compiler(df: DataFrame, plan: Plan, now_serial: float | None, date1904: bool, names: Mapping[str, str] | None) -> Compiler:
    return Compiler(df.schema, plan, scalar.Context(now_serial, date1904), names)


def result_columns(v: Val, name: str, errors: bool) -> list[Column]:
    """The value under `name` (null for an error or a blank) and, if asked, the error under name_error."""
    out = v.clean
    if v.kind == "cell":
        out = F.when(out["kind"] != "blank", out)
    return [out.alias(name)] + ([(F.lit(None).cast("string") if v.err is None else v.err).alias(f"{name}_error")] if errors else [])


def attached(df: DataFrame, plan: Plan, source: DataFrame, by: Sequence[str]) -> DataFrame:
    """df with the columns of the plan's frames over the source's rows."""
    for key, build in plan.frames:
        df = statistics.joined(df, build(source, list(by)), by, key=key)
    return df


def aggregated(df: DataFrame, plan: Plan, groups: Sequence[str | Column]) -> DataFrame:
    """One row a group with the plan's aggregates."""
    return df.groupBy(*groups).agg(*(plan.aggregates or [F.count(F.lit(1)).alias(f"{PREFIX}_n")]))


def _per_row(df: DataFrame, plan: Plan, by: Sequence[str]) -> DataFrame:
    if plan.aggregates:
        df, source = statistics.joined(df, aggregated(df, plan, by), by), df
    else:
        source = df
    return attached(df, plan, source, by)


def with_formulas(df: DataFrame, formulas: Mapping[str, str], by: Sequence[str] = (), order: str | Column | None = None, now_serial: float | None = None, date1904: bool = False, names: Mapping[str, str] | None = None, errors: bool = False) -> DataFrame:
    """The table with a column per formula; range functions see the rows of the same `by` group."""
    plan = Plan(True, F.col(order) if isinstance(order, str) else order, streaming=df.isStreaming)
    c = _compiler(df, plan, now_serial, date1904, names)
    columns = [x for name, f in formulas.items() for x in result_columns(c.scalar(parse(f)), name, errors)]
    return _per_row(df, plan, by).select(*[F.col(f"`{x}`") for x in df.columns], *columns)


def aggregate_formulas(df: DataFrame, formulas: Mapping[str, str], by: Sequence[str] = (), order: str | Column | None = None, now_serial: float | None = None, date1904: bool = False, names: Mapping[str, str] | None = None, errors: bool = False) -> DataFrame:
    """One row per `by` group (one in all without it) with a column per formula."""
    plan = Plan(False, F.col(order) if isinstance(order, str) else order, streaming=df.isStreaming)
    c = _compiler(df, plan, now_serial, date1904, names)
    columns = [x for name, f in formulas.items() for x in result_columns(c.scalar(parse(f)), name, errors)]
    return attached(aggregated(df, plan, by), plan, df, by).select(*by, *columns)


def _truth_value(v: Val) -> Column:
    b, e = to_bool(v)
    return F.coalesce(b if e is None else F.when(e.isNull(), b), F.lit(False))


def truth(df: DataFrame, formula: str, now_serial: float | None = None, date1904: bool = False) -> Column:
    """A rule's truth per row: true only where the value is true without an error; a formula that does not parse is never true.

    The formula must not use ranges; see with_truth.
    """
    plan = Plan(True)
    try:
        v = _compiler(df, plan, now_serial, date1904, None).scalar(parse(formula))
    except FormulaError:
        return F.lit(False)
    if plan.aggregates or plan.frames:
        raise ValueError("a formula over ranges needs with_truth")
    return _truth_value(v)


def with_truth(df: DataFrame, formula: str, name: str, by: Sequence[str] = (), now_serial: float | None = None, date1904: bool = False) -> DataFrame:
    """df with a rule's truth per row; range functions see the rows of the same `by` group."""
    plan = Plan(True)
    try:
        v = _compiler(df, plan, now_serial, date1904, None).scalar(parse(formula))
    except FormulaError:
        return df.withColumn(name, F.lit(False))
    return _per_row(df, plan, by).select(*[F.col(f"`{x}`") for x in df.columns if x != name], _truth_value(v).alias(name))


_BLANK = "struct<kind:string,num:double,str:string,bool:boolean,err:string>"


def _moved(node: tuple, places: dict[tuple, str]) -> tuple:
    """The tree with each cell reference as the name of a column."""
    if node[0] == "ref":
        return ("name", places.setdefault(node, f"{PREFIX}_r{len(places)}"))
    if node[0] == "range" and not all(flag for cell in node[2:] for flag in cell[2:]):
        raise NotImplementedError("a range that moves with the cell; anchor it with $ or name its cells")
    return tuple(tuple(_moved(x, places) if isinstance(x, tuple) and x and isinstance(x[0], str) else x for x in part) if isinstance(part, tuple) and part and isinstance(part[0], tuple) else _moved(part, places) if isinstance(part, tuple) and part and isinstance(part[0], str) else part for part in node)


def with_references(targets: DataFrame, cells: DataFrame, formulas: Mapping[str, str], origin: str = "A1", sheets: Mapping[str, int] | None = None, now_serial: float | None = None, date1904: bool = False, names: Mapping[str, str] | None = None, errors: bool = False) -> DataFrame:
    """targets(sheet, row, col, ...) with a column per formula as written for `origin`.

    A reference without $ moves with the target's distance from the origin; one with a sheet's
    name reads that sheet, an unknown name or a place off the grid is #REF!. Every reference is an
    equi-join with cells(sheet, row, col, kind, num, str, bool, err); a fixed row of a named sheet,
    which is one row of cells for all targets, is sent to every task. A range must be anchored; its
    functions see the target's own sheet.
    """
    r0, c0, *_ = parse_cell(origin)
    places: dict[tuple, str] = {}
    trees = {name: _moved(parse(f), places) for name, f in formulas.items()}
    value = cells.select("sheet", "row", "col", F.struct("kind", "num", "str", "bool", "err").alias("_v"))
    known = {k.lower(): v for k, v in (sheets or {}).items()}
    out = targets
    for (_, sheet, (r, c, fixed_row, fixed_col)), name in places.items():
        row = F.lit(r) if fixed_row else F.col("row") + (r - r0)
        col = F.lit(c) if fixed_col else F.col("col") + (c - c0)
        at = F.col("sheet") if sheet is None else F.lit(known.get(sheet.lower(), -1))
        held = value.select(F.col("sheet").alias("_s"), F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("_v").alias(name))
        if sheet is not None and fixed_row:
            held = F.broadcast(held.where((F.col("_s") == at) & (F.col("_r") == r)))
        else:
            held = held.hint("merge")  # a table's size says little of its cells', so it is not left to the planner to send them all
        out = out.join(held, (at == F.col("_s")) & (row == F.col("_r")) & (col == F.col("_c")), "left").drop("_s", "_r", "_c")
        empty = F.named_struct(F.lit("kind"), F.lit("blank"), F.lit("num"), F.lit(None).cast("double"), F.lit("str"), F.lit(None).cast("string"), F.lit("bool"), F.lit(None).cast("boolean"), F.lit("err"), F.lit(None).cast("string")).cast(_BLANK)
        lost = F.named_struct(F.lit("kind"), F.lit("err"), F.lit("num"), F.lit(None).cast("double"), F.lit("str"), F.lit(None).cast("string"), F.lit("bool"), F.lit(None).cast("boolean"), F.lit("err"), F.lit("#REF!")).cast(_BLANK)
        off = (row < 0) | (col < 0) | (F.lit(sheet is not None) & (at < 0))
        out = out.withColumn(name, F.when(off, lost).otherwise(F.coalesce(F.col(name).cast(_BLANK), empty)))
    plan = Plan(True)
    kinds = T.StructType([*out.schema.fields, *[f for f in cells.schema.fields if f.name not in out.columns]])
    c = Compiler(kinds, plan, scalar.Context(now_serial, date1904), names)
    columns = [x for name, tree in trees.items() for x in result_columns(c.scalar(tree), name, errors)]
    if plan.aggregates:
        out = statistics.joined(out, aggregated(cells, plan, ["sheet"]), ["sheet"])
    return attached(out, plan, cells, ["sheet"]).select(*[F.col(f"`{x}`") for x in targets.columns], *columns)
