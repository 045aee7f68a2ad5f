"""The criteria language of COUNTIF and its kin, compiled to predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.values import Val, field, kind_is

_OPERATOR = re.compile(r"(<>|>=|<=|>|<|=)?(.*)", re.DOTALL)
_NUMBER = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*")
_SPECIAL = set(".^$*+?()[]{}|\\/&~#-")


def wildcard_pattern(text: str) -> str:
    """A Java pattern for text with * (any run), ? (one character) and ~ (escape)."""
    out, k = "", 0
    while k < len(text):
        c = text[k]
        if c == "~" and text[k + 1 : k + 2] in ("*", "?", "~"):
            k += 1
            c = text[k]
            out += "\\" + c
        elif c in "*?":
            out += ".*" if c == "*" else "."
        else:
            out += "\\" + c if c in _SPECIAL else c
        k += 1
    return f"(?isu)^{out}$"


def wildcard_match(s: Column, text: str) -> Column:
    if not set("*?~") & set(text):
        return F.lower(s) == text.lower()
    return s.rlike(wildcard_pattern(text))


def predicate(v: Val, criterion: float | str | bool | None) -> Column:
    """Whether the value meets the criterion; never null. Errors and, unless they are asked for, blanks do not."""
    symbol, operand = "=", criterion
    if isinstance(criterion, str):
        symbol, operand = _OPERATOR.fullmatch(criterion).groups()
        symbol = symbol or "="
        if _NUMBER.fullmatch(operand):
            operand = float(operand)
    if operand is None:
        operand = 0.0
    if isinstance(operand, str):
        hit = wildcard_match(F.coalesce(field(v, "str"), F.lit("")), operand)
        usable = kind_is(v, "str")  # absent cells are never visited
        out = usable & (~hit if symbol == "<>" else hit)
    else:
        x, n = F.coalesce(field(v, "num"), field(v, "bool").cast("double")), F.lit(float(operand))
        out = {"=": x == n, "<>": x != n, ">": x > n, ">=": x >= n, "<": x < n, "<=": x <= n}[symbol]
    if v.err is not None:
        out = out & v.err.isNull()
    return F.coalesce(out, F.lit(False))
