"""Ordered per-field folds of the branches of a cohort: one ``groupBy(...).agg(...)`` whatever the reducers.

A reducer is a pair: an aggregate over the members (partial aggregation on the map side wherever order does not matter)
and a merge of that with the value that the cohort started from. Null members are no operands of a combining reducer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Order = Sequence[str]


def _ordered(value: Column, order: Order) -> Column:
    """Members that are not null, in fold order."""
    rows = F.collect_list(F.when(value.isNotNull(), F.struct(*order, value.alias("v_"))))
    return F.transform(F.array_sort(rows), lambda x: x["v_"])


def _as_list(value: Column, kind: str) -> Column:
    return value if kind.startswith("array") else F.array(value)


def _distinct_after(base: Column, more: Column) -> Column:
    """``base`` as it is, then what it lacks, each once, in order of first sight; without a base simply each once."""
    return F.when(base.isNull(), F.array_distinct(more)).otherwise(F.concat(base, F.array_except(F.coalesce(more, base), base)))


def _merge_maps(base: Column | None, maps: Column) -> Column:
    """Entries of maps in order; of equal keys the last one stays."""
    start = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")) if base is None else base
    return F.aggregate(maps, start, lambda a, m: F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(m), k)), m))


#: name -> (aggregate(value, order, type), merge(base, folded))
REDUCERS: dict[str, tuple[Callable[[Column, Order, str], Column], Callable[[Column, Column], Column]]] = {
    "replace": (lambda v, o, k: F.max_by(F.struct(v.alias("v_")), F.struct(*o))["v_"], lambda b, x: F.coalesce(x, b)),
    "append": (lambda v, o, k: F.flatten(_ordered(_as_list(v, k), o)) if k.startswith("array") else _ordered(v, o), lambda b, x: F.when(b.isNull(), x).otherwise(F.concat(b, F.coalesce(x, F.array().cast("array<string>"))))),
    "union": (lambda v, o, k: F.flatten(_ordered(v, o)) if k.startswith("array") else _ordered(v, o), lambda b, x: _distinct_after(b, x)),
    "add": (lambda v, o, k: F.sum(v.cast("double")), lambda b, x: F.when(b.isNull() & x.isNull(), None).otherwise(F.coalesce(b.cast("double"), F.lit(0.0)) + F.coalesce(x, F.lit(0.0)))),
    "min": (lambda v, o, k: F.min(v.cast("double")), lambda b, x: F.least(b.cast("double"), x)),
    "max": (lambda v, o, k: F.max(v.cast("double")), lambda b, x: F.greatest(b.cast("double"), x)),
    "and": (lambda v, o, k: F.bool_and(v), lambda b, x: F.coalesce(b, F.lit(True)) & F.coalesce(x, b)),
    "or": (lambda v, o, k: F.bool_or(v), lambda b, x: F.coalesce(b, F.lit(False)) | F.coalesce(x, b)),
    "concat": (lambda v, o, k: F.array_join(_ordered(v, o), ""), lambda b, x: F.concat(F.coalesce(b, F.lit("")), F.coalesce(x, F.lit("")))),
    "merge": (lambda v, o, k: _merge_maps(None, F.transform(_ordered(F.map_entries(v), o), F.map_from_entries)), lambda b, x: _merge_maps(b, F.array(x))),
}
COMBINING = tuple(k for k in REDUCERS if k != "replace")


def reducer(name: str):
    if name not in REDUCERS:
        raise ValueError(f"unknown reducer {name!r}")
    return REDUCERS[name]


def fold(members: DataFrame, keys: Sequence[str], order: Order, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """One row for each cohort. fields: result -> (reducer, column); order: columns that sort the members."""
    kinds = dict(members.dtypes)
    return members.groupBy(*keys).agg(*[reducer(r)[0](F.col(c), order, kinds[c]).alias(name) for name, (r, c) in fields.items()])


def reduce_onto(base: Column, folded: Column, name: str) -> Column:
    """The folded members merged onto what the cohort started from."""
    return reducer(name)[1](base, folded)


def fan_in(spawns: DataFrame, members: DataFrame, keys: Sequence[str], order: Order, fields: dict[str, tuple[str, str]], status: str = "status") -> DataFrame:
    """Each spawn with its completed members folded onto its own values.

    Spawns without members keep their values (an empty fan-out fires its fan-in). spawns hold ``keys`` and a column for
    each result; members hold ``keys``, ``order``, ``status`` and the named columns.
    """
    folded = fold(members.filter(F.col(status) == "completed"), keys, order, fields).withColumnsRenamed({f: f"{f}_new" for f in fields})
    out = spawns.join(folded, list(keys), "left")
    return out.select(*[c for c in spawns.columns if c not in fields], *[F.when(F.col(f"{f}_new").isNull(), F.col(f)).otherwise(reduce_onto(F.col(f), F.col(f"{f}_new"), r)).alias(f) for f, (r, _) in fields.items()])


def cohort_counters(members: DataFrame, keys: Sequence[str], failed: Column) -> DataFrame:
    """arrivals and failures of each cohort, and whether all of its members succeeded."""
    return members.groupBy(*keys).agg(F.count(F.lit(1)).alias("arrivals"), F.count_if(failed).alias("failures")).withColumn("succeeded", F.col("failures") == 0)
