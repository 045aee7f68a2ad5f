"""Formula text to a syntax tree.

Nodes are tuples: ("num", x), ("str", s), ("bool", b), ("err", code), ("name", column),
("row", column) for [@column], ("ref", sheet, cell), ("range", sheet, cell, cell),
("array", rows), ("neg"|"pos"|"pct", x), ("op", symbol, a, b), ("call", NAME, args), ("missing",).
A cell is (row, column, row is absolute, column is absolute), 0-based.
"""

from __future__ import annotations

import re

MAX_LENGTH, MAX_DEPTH, MAX_ARGS = 8192, 64, 255
#: The error literals.
ERRORS = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A")
#: Binding power of the binary operators; only ^ groups to the right.
POWER = {"=": 1, "<>": 1, "<": 1, ">": 1, "<=": 1, ">=": 1, "&": 2, "+": 3, "-": 3, "*": 4, "/": 4, "^": 5}


class FormulaError(ValueError):
    """The text is no formula."""


_TOKEN = re.compile(
    r"""\s*(?:
    (?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?![A-Za-z_])
  | "(?P<str>(?:[^"]|"")*)"
  | (?P<err>\#(?:NULL!|DIV/0!|VALUE!|REF!|NAME\?|NUM!|N/A))
  | \[@(?P<row>[^\]]+)\]
  | (?:(?:'(?P<quoted>(?:[^']|'')+)'|(?P<sheet>[A-Za-z_][\w.]*))!)?
    (?P<cell>\$?[A-Za-z]{1,3}\$?[1-9]\d*)(?![\w.(])(?::(?P<cell2>\$?[A-Za-z]{1,3}\$?[1-9]\d*)(?![\w.(]))?
  | (?P<name>[A-Za-z_][\w.]*)
  | (?P<op><>|<=|>=|[-+*/^&=<>%(),;{}])
    )""",
    re.VERBOSE,
)
_CELL = re.compile(r"(\$?)([A-Za-z]{1,3})(\$?)(\d+)")


def parse_cell(text: str) -> tuple[int, int, bool, bool]:
    m = _CELL.fullmatch(text)
    if not m:
        raise FormulaError(f"{text!r} is no cell address")
    column = 0
    for letter in m[2].upper():
        column = 26 * column + ord(letter) - 64
    return int(m[4]) - 1, column - 1, bool(m[3]), bool(m[1])


def format_cell(row: int, column: int) -> str:
    letters, n = "", column + 1
    while n:
        n, k = divmod(n - 1, 26)
        letters = chr(65 + k) + letters
    return f"{letters}{row + 1}"


def tokens(text: str) -> list[tuple]:
    if len(text) > MAX_LENGTH:
        raise FormulaError("the formula is too long")
    out, at = [], 1 if text.startswith("=") else 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"unexpected text at {at}: {text[at:at + 12]!r}")
        at = m.end()
        kind = m.lastgroup
        if m["num"] is not None:
            out.append(("num", float(m["num"])))
        elif m["str"] is not None:
            out.append(("str", m["str"].replace('""', '"')))
        elif m["err"] is not None:
            out.append(("err", m["err"]))
        elif m["row"] is not None:
            out.append(("row", m["row"].strip()))
        elif m["cell"] is not None:
            sheet = m["sheet"] or (m["quoted"].replace("''", "'") if m["quoted"] else None)
            first = parse_cell(m["cell"])
            out.append(("range", sheet, first, parse_cell(m["cell2"])) if m["cell2"] else ("ref", sheet, first))
        elif m["name"] is not None:
            out.append(("name", m["name"]))
        else:
            out.append((kind, m["op"]))
    return [*out, ("end",)]


def parse(text: str) -> tuple:
    """The syntax tree of a formula, with or without its leading equals sign."""
    queue = tokens(text)
    at = depth = 0

    def take(symbol: str | None = None) -> tuple:
        nonlocal at
        token = queue[at]
        if symbol is not None and token != ("op", symbol):
            raise FormulaError(f"expected {symbol!r}, found {token[1:]}")
        at += 1
        return token

    def expression(power: int) -> tuple:
        nonlocal depth
        depth += 1
        if depth > MAX_DEPTH:
            raise FormulaError("the formula is nested too deeply")
        left = operand()
        while queue[at][0] == "op":
            symbol = queue[at][1]
            if symbol == "%":
                take()
                left = ("pct", left)
                continue
            p = POWER.get(symbol, 0)
            if p <= power:
                break
            take()
            left = ("op", symbol, left, expression(p - 1 if symbol == "^" else p))
        depth -= 1
        return left

    def postfix(node: tuple) -> tuple:
        while queue[at] == ("op", "%"):
            take()
            node = ("pct", node)
        return node

    def operand() -> tuple:
        token = take()
        if token[0] in ("num", "str", "err", "row", "ref", "range"):
            return postfix(token)
        if token[0] == "name":
            if queue[at] == ("op", "("):
                return postfix(call(token[1]))
            if token[1].upper() in ("TRUE", "FALSE"):
                return ("bool", token[1].upper() == "TRUE")
            return postfix(token)
        if token == ("op", "("):
            inner = expression(0)
            take(")")
            return postfix(inner)
        if token in (("op", "-"), ("op", "+")):
            return ("neg" if token[1] == "-" else "pos", operand())
        if token == ("op", "{"):
            return array()
        raise FormulaError(f"unexpected {token[1:] or 'end'}")

    def call(name: str) -> tuple:
        take("(")
        args: list[tuple] = []
        if queue[at] != ("op", ")"):
            while True:
                args.append(("missing",) if queue[at] in (("op", ","), ("op", ")")) else expression(0))
                if queue[at] != ("op", ","):
                    break
                take()
        take(")")
        if len(args) > MAX_ARGS:
            raise FormulaError("too many arguments")
        return ("call", name.upper(), tuple(args))

    def array() -> tuple:
        rows: list[list[tuple]] = [[]]
        while True:
            sign = 1
            if queue[at] == ("op", "-"):
                take()
                sign = -1
            token = take()
            if token[0] == "name" and token[1].upper() in ("TRUE", "FALSE"):
                token = ("bool", token[1].upper() == "TRUE")
            if token[0] not in ("num", "str", "bool", "err"):
                raise FormulaError("an array holds constants only")
            rows[-1].append(("num", sign * token[1]) if token[0] == "num" else token)
            separator = take()
            if separator == ("op", "}"):
                break
            if separator == ("op", ";"):
                rows.append([])
            elif separator != ("op", ","):
                raise FormulaError("an array is not closed")
        if len({len(r) for r in rows}) > 1 or sum(map(len, rows)) > MAX_ARGS:
            raise FormulaError("an array must be a rectangle of at most 255 constants")
        return ("array", tuple(map(tuple, rows)))

    tree = expression(0)
    if queue[at] != ("end",):
        raise FormulaError(f"unexpected {queue[at][1:]}")
    return tree
