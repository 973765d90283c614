"""State columns: JSON objects, one per row, read by path with VARIANT functions.

A field is absent, cleared (JSON null: a tombstone in a delta) or present. Readers come in two kinds: ``get`` gives null
for what is absent, cleared or of another type, ``typed`` gives the type's zero value for what is absent and raises on a
mismatch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = {"string": "''", "bigint": "0L", "double": "0D", "boolean": "false", "array<string>": "array()"}


def _path(name: str) -> str:
    return "$['" + name.replace("'", "\\'") + "']"


def parsed(state: Column) -> Column:
    """VARIANT of an object; empty text and null give an empty object; anything that is no object gives null."""
    v = F.try_parse_json(F.when(F.trim(F.coalesce(state, F.lit(""))).isin("", "null"), F.lit("{}")).otherwise(state))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def names(state: Column) -> Column:
    return F.coalesce(F.json_object_keys(state), F.array().cast("array<string>"))


def _present(state: Column, name: str) -> Column:
    return F.array_contains(names(state), name)


def has(state: Column, name: str) -> Column:
    """Present and not null."""
    return _present(state, name) & ~is_deleted(state, name)


def is_deleted(state: Column, name: str) -> Column:
    """Present and null."""
    return _present(state, name) & F.coalesce(F.is_variant_null(F.try_variant_get(F.try_parse_json(state), _path(name), "variant")), F.lit(True))


def get(state: Column, name: str, kind: str = "string") -> Column:
    v = F.try_parse_json(state)
    if kind != "bigint":
        return F.try_variant_get(v, _path(name), kind)
    d = F.try_variant_get(v, _path(name), "double")  # an integer must be whole
    return F.when(d == F.floor(d), F.try_variant_get(v, _path(name), "bigint"))


def typed(state: Column, name: str, kind: str) -> Column:
    value = get(state, name, kind)
    return F.when(has(state, name) & value.isNull(), F.raise_error(F.concat(F.lit(f"field {name} is no {kind}: "), state)).cast(kind)).otherwise(F.coalesce(value, F.expr(ZERO[kind]).cast(kind)))


def raw(state: Column, name: str) -> Column:
    """JSON text of a field; null where it is absent."""
    return F.to_json(F.try_variant_get(F.try_parse_json(state), _path(name), "variant"))


def entries(state: Column) -> Column:
    """MAP of field name to JSON text; "null" marks a tombstone."""
    v = F.from_json(state, "map<string,variant>")
    return F.transform_values(v, lambda k, x: F.coalesce(F.to_json(x), F.lit("null")))


def _joined(fields: Column) -> Column:
    quoted = lambda k: F.to_json(F.array(k))
    pair = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(F.expr("''"), F.substr(quoted(e["key"]), F.lit(2), F.length(quoted(e["key"])) - 2), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(pair, ","), F.lit("}"))


def encode(fields: Column) -> Column:
    """JSON object of a MAP of field name to JSON text, fields in order of their names."""
    return _joined(fields)


def overlay(state: Column, delta: Column) -> Column:
    """``state`` with the fields of ``delta`` in their place (both as MAPs); tombstones stay."""
    return F.map_concat(F.map_filter(state, lambda k, v: ~F.array_contains(F.map_keys(delta), k)), delta)


def without_deleted(fields: Column) -> Column:
    return F.map_filter(fields, lambda k, v: v != "null")


def without(fields: Column, *gone: str) -> Column:
    return F.map_filter(fields, lambda k, v: ~k.isin(*gone))


def changed(before: Column, after: Column) -> Column:
    """Fields of ``after`` whose JSON text differs, and tombstones for those that went."""
    new = F.map_filter(after, lambda k, v: ~F.coalesce(F.element_at(before, k) == v, F.lit(False)))
    gone = F.transform_values(F.map_filter(before, lambda k, v: ~F.array_contains(F.map_keys(after), k)), lambda k, v: F.lit("null"))
    return F.map_concat(new, gone)
