"""Conditions: lookups such as price__gte, comparisons, and boolean texts with & | and parentheses."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, v: c.isNull() if v is None else c == v,
    "ne": lambda c, v: c.isNotNull() if v is None else c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "like": lambda c, v: c.like(v),
    "ilike": lambda c, v: c.ilike(v),
    "in": lambda c, v: c.isin(*v),
}
SIGNS = {"=": "eq", "==": "eq", "!=": "ne", "<>": "ne", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}
TOKEN = re.compile(r"""\s*(?:(?P<open>\()|(?P<close>\))|(?P<and>&&?)|(?P<or>\|\|?)|(?P<term>(?:'(?:[^']|'')*'|\[[^\]]*\]|[^&|()'\[])+))""")
TERM = re.compile(r"^\s*([A-Za-z_][\w.]*?)\s*(>=|<=|!=|<>|==|=|>|<)\s*(\S.*?)\s*$", re.S)


def condition(op: str, column: Column, value) -> Column:
    name = SIGNS.get(op, op.lower())
    if name not in OPERATORS:
        raise ValueError(f"unknown operator {op}")
    return OPERATORS[name](column, value)


def split_lookup(name: str) -> tuple[str, str]:
    """customer__acctbal__gte -> (customer.acctbal, gte)."""
    parts = name.split("__")
    op = parts.pop() if len(parts) > 1 and parts[-1] in OPERATORS else "eq"
    return ".".join(parts), op


def literal(text: str):
    """A quoted text, a list, null, a boolean or a number; anything else is a text, typed by the column it meets."""
    if text[:1] == "'" and text[-1:] == "'" and len(text) > 1:
        return text[1:-1].replace("''", "'")
    if text[:1] == "[":
        return [literal(x.strip()) for x in re.findall(r"'(?:[^']|'')*'|[^,\[\]]+", text[1:-1])]
    if text.lower() in ("null", "true", "false"):
        return {"null": None, "true": True, "false": False}[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


NAME = re.compile(r"[A-Za-z_][\w.]*\Z")


def boolean(text: str, column: Callable[[str], Column], known: Callable[[str], bool] = lambda _: False) -> Column:
    """`a__gt=1 & (b = 'x' | c <= d)`; & binds closer than |. A bare name on the right is a column where `known` says so, else a text."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read condition at {text[at:]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    i = 0

    def take(kind: str) -> bool:
        nonlocal i
        if tokens[i][0] == kind:
            i += 1
            return True
        return False

    def single() -> Column:
        nonlocal i
        if take("open"):
            c = either()
            if not take("close"):
                raise ValueError("a parenthesis is not closed")
            return c
        kind, term = tokens[i]
        m = TERM.match(term) if kind == "term" else None
        if not m:
            raise ValueError(f"not a condition: {term!r}")
        i += 1
        name, sign, value = m.groups()
        path, op = split_lookup(name)
        right = column(value) if NAME.match(value) and known(value) else literal(value)
        return condition(op if sign in "==" and op != "eq" else SIGNS[sign], column(path), right)

    def both() -> Column:
        c = single()
        while take("and"):
            c = c & single()
        return c

    def either() -> Column:
        c = both()
        while take("or"):
            c = c | both()
        return c

    out = either()
    if tokens[i][0] != "end":
        raise ValueError(f"cannot read condition at {tokens[i][1]!r}")
    return out


def all_of(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
