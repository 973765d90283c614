"""Conditions of edges: boolean expressions over the fields of a state, as Spark columns.

Grammar: ``||``, ``&&``, ``!``, comparisons, parentheses, field names (dots reach into objects), numbers, strings,
``true``, ``false``, ``null``. Numbers are doubles. A comparison with an absent field or of different types is false.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|([A-Za-z_]\w*(?:\.\w+)*)|(\|\||&&|[=!<>]=|[<>!()-]))")
Term = Callable[[Column], dict[str, Column]]


class PredicateError(ValueError):
    """A condition that cannot be read."""


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise PredicateError(f"unexpected {text[at:].strip()[:10]!r}")
        out.append(next((k, v) for k, v in zip(("number", "string", "name", "sign"), m.groups(), strict=True) if v is not None))
        at = m.end()
    return out


def _field(path: str) -> Term:
    p = "$." + path
    return lambda v: {k: F.try_variant_get(v, p, t) for k, t in (("number", "double"), ("string", "string"), ("bool", "boolean"))} | {"kind": F.schema_of_variant(F.try_variant_get(v, p, "variant"))}


def _literal(kind: str, value) -> Term:
    names = {"number": "BIGINT", "string": "STRING", "bool": "BOOLEAN"}
    return lambda v: {k: F.lit(value) if k == kind else F.lit(None) for k in names} | {"kind": F.lit(names.get(kind, "VOID"))}


def _compare(op: str, a: Term, b: Term) -> Callable[[Column], Column]:
    ops = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}

    def test(v: Column) -> Column:
        x, y = a(v), b(v)
        numeric = lambda k: k.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|TINYINT|SMALLINT|INT)")
        both = lambda f: f(x["kind"]) & f(y["kind"])
        rest = F.lit(op == "!=")
        if op in ("==", "!="):
            void = lambda k: k.isNull() | (k == "VOID")
            rest = F.when(both(void), F.lit(op == "==")).otherwise(rest)
        else:
            rest = F.lit(False)
        out = F.when(both(numeric), ops[op](x["number"].cast("double"), y["number"].cast("double")))
        out = out.when(both(lambda k: k == "STRING"), ops[op](x["string"].cast("string"), y["string"].cast("string")))
        if op in ("==", "!="):
            out = out.when(both(lambda k: k == "BOOLEAN"), ops[op](x["bool"].cast("boolean"), y["bool"].cast("boolean")))
        return F.coalesce(out.otherwise(rest), F.lit(False))

    return test


def compiled(text: str) -> Callable[[Column], Column]:
    """The condition as a function of a state (JSON text)."""
    tokens, at = [*_tokens(text), ("end", "")], 0

    def take() -> tuple[str, str]:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def either():
        parts = [both()]
        while tokens[at] == ("sign", "||"):
            take()
            parts.append(both())
        return parts[0] if len(parts) == 1 else lambda v: _any([p(v) for p in parts])

    def both():
        parts = [single()]
        while tokens[at] == ("sign", "&&"):
            take()
            parts.append(single())
        return parts[0] if len(parts) == 1 else lambda v: _all([p(v) for p in parts])

    def single():
        if tokens[at] == ("sign", "!"):
            take()
            inner = single()
            return lambda v: ~inner(v)
        if tokens[at] == ("sign", "("):
            take()
            inner = either()
            if take() != ("sign", ")"):
                raise PredicateError("a parenthesis stays open")
            return inner
        left = term()
        if tokens[at][0] == "sign" and tokens[at][1] in ("==", "!=", "<", ">", "<=", ">="):
            return _compare(take()[1], left, term())
        return lambda v: F.coalesce(F.when(left(v)["kind"] == "BOOLEAN", left(v)["bool"].cast("boolean")), F.lit(False))

    def term() -> Term:
        kind, value = take()
        if (kind, value) == ("sign", "-"):
            kind, value = take()
            if kind != "number":
                raise PredicateError("a sign without a number")
            return _literal("number", -float(value))
        if kind == "number":
            return _literal("number", float(value))
        if kind == "string":
            return _literal("string", re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind == "name":
            return _literal("bool", value == "true") if value in ("true", "false") else _literal("null", None) if value in ("null", "nil") else _field(value)
        raise PredicateError(f"unexpected {value or 'end'!r}")

    test = either()
    if tokens[at][0] != "end":
        raise PredicateError(f"unexpected {tokens[at][1]!r}")
    return lambda state: test(F.try_parse_json(state))


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out
