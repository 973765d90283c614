"""Folds of JSON states by field, and what follows from them: terminal, failed-cohort and final states, failures that climb.

A state or a delta is a MAP of field name to JSON text; "null" in a delta clears the field. A combining reducer skips
cleared operands; an operand of the wrong type is an error of the fold, which names the reducer and the field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braid.functions import state as st
from braid.operators.relational import descendants
from braid.sources.staging import staged

_NUMBERS, _FLAGS, _LISTS = ("add", "min", "max"), ("and", "or"), ("append", "union")


def no_fields() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def quoted(value: Column) -> Column:
    """JSON text of a string column."""
    text = F.to_json(F.array(value))
    return F.substr(text, F.lit(2), F.length(text) - 2)


def text_of(value: Column) -> Column:
    """The string that a JSON text stands for."""
    return F.try_variant_get(F.try_parse_json(value), "$", "string")


def elements(value: Column) -> Column:
    """JSON texts of the elements of an array; another value is one element."""
    some = F.transform(F.from_json(value, "array<variant>"), lambda x: F.coalesce(F.to_json(x), F.lit("null")))
    return F.when(value.startswith("["), some).otherwise(F.array(value))


def _tidy(number: Column) -> Column:
    return F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))


def _mismatch(kind: Column, value: str, base: bool = False) -> Column:
    """Whether the JSON text in a column is no operand of the reducer; as a base, lists must be lists already."""
    v = F.col(value)
    wrong = (
        F.when(kind.isin(*_NUMBERS), F.expr(f"try_cast({value} AS DOUBLE)").isNull()).when(kind.isin(*_FLAGS), ~v.isin("true", "false"))
        .when(kind == "concat", ~v.startswith('"')).when(kind == "merge", ~v.startswith("{"))
    )
    return F.coalesce((wrong.when(kind.isin(*_LISTS), ~v.startswith("[")) if base else wrong).otherwise(F.lit(False)), F.lit(False))


def reduce_states(bases: DataFrame, deltas: DataFrame, keys: list[str], reducers: dict[str, str]) -> DataFrame:
    """(keys, state, error): each base with its deltas folded in, field by field, in one aggregation for all of them.

    bases: keys, base; deltas: keys, o (struct that orders them), delta. Fields without a reducer are replaced by the last
    delta that has them, tombstones included. A field that cannot be folded keeps its base and gives the error.
    """
    changes = deltas.select(*keys, "o", F.explode("delta").alias("field", "value")).filter(~F.col("field").startswith("$"))
    kind = F
    for field, r in reducers.items():
        kind = kind.when(F.col("field") == field, F.lit(r))
    changes = changes.withColumn("kind", kind.otherwise(F.lit("replace")) if reducers else F.lit("replace"))
    live = (F.col("value") != "null") & (F.col("kind") != "replace")
    number, flag = F.expr("try_cast(value AS DOUBLE)"), F.expr("try_cast(value AS BOOLEAN)")
    listed = F.array_sort(F.collect_list(F.when(live & F.col("kind").isin("append", "union", "concat", "merge"), F.struct("o", "value"))))
    a = changes.groupBy(*keys, "field", "kind").agg(
        F.max_by("value", "o").alias("last"), F.sum(F.when(live, number)).alias("add"), F.min(F.when(live, number)).alias("min"), F.max(F.when(live, number)).alias("max"),
        F.bool_and(F.when(live, flag)).alias("and"), F.bool_or(F.when(live, flag)).alias("or"), listed.alias("l"), F.count_if(live).alias("operands"), F.bool_or(live & _mismatch(F.col("kind"), "value")).alias("bad"),
    )
    a = a.join(bases.select(*keys, "base"), keys).withColumn("own", F.nullif(F.element_at("base", F.col("field")), F.lit("null")))
    own, k, texts = F.col("own"), F.col("kind"), F.transform("l", lambda x: x["value"])
    items = F.flatten(F.transform(texts, elements))
    base_items = F.when(own.isNull(), F.array().cast("array<string>")).otherwise(elements(own))
    base_number, base_flag = F.expr("try_cast(own AS DOUBLE)"), F.expr("try_cast(own AS BOOLEAN)")
    merge = F.aggregate(F.transform(texts, st.entries), F.coalesce(st.entries(own), no_fields()), st.overlay)
    as_list = lambda x: F.concat(F.lit("["), F.array_join(x, ","), F.lit("]"))
    bad = (F.col("operands") > 0) & (F.coalesce("bad", F.lit(False)) | (own.isNotNull() & _mismatch(k, "own", base=True)))
    value = (
        F.when(k == "replace", F.col("last"))
        .when(k == "add", _tidy(F.coalesce(base_number, F.lit(0.0)) + F.coalesce("add", F.lit(0.0))))
        .when(k == "min", _tidy(F.least(base_number, "min"))).when(k == "max", _tidy(F.greatest(base_number, "max")))
        .when(k == "and", (F.coalesce(base_flag, F.lit(True)) & F.coalesce("and", F.lit(True))).cast("string")).when(k == "or", (F.coalesce(base_flag, F.lit(False)) | F.coalesce("or", F.lit(False))).cast("string"))
        .when(k == "append", as_list(F.concat(base_items, items)))
        .when(k == "union", as_list(F.when(own.isNull(), F.array_distinct(items)).otherwise(F.concat(base_items, F.array_except(items, base_items)))))
        .when(k == "concat", quoted(F.concat(F.coalesce(text_of(own), F.lit("")), F.array_join(F.transform(texts, text_of), ""))))
        .when(k == "merge", st.encode(merge))
    )
    # a combining reducer whose operands were all cleared leaves the base alone
    a = a.filter((k == "replace") | (F.col("operands") > 0)).withColumn("error", F.when(bad, F.concat(F.lit("reducer '"), k, F.lit("' for field '"), F.col("field"), F.lit("': wrong type"))))
    a = a.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(~bad, F.struct(F.col("field").alias("key"), value.alias("value"))))).alias("new"), F.min("error").alias("error"))
    out = bases.select(*keys, "base").join(a, keys, "left")
    return out.select(*keys, st.overlay(F.col("base"), F.coalesce("new", no_fields())).alias("state"), "error")


# ---- states of stored steps: flow_id, step_id, lineage_id (null outside of cohorts), fan_out_ordinal, step_depth, status,
# ---- task_name, tail (no step follows), state, changes


def terminal_states(steps: DataFrame, reducers: dict[str, str], order: tuple[str, ...] = ("step_id",)) -> DataFrame:
    """(flow_id, lineage_id, state): the first tail's state with the changes of all tails folded in.

    Completed tails count, or all of them where none has completed; lineage_id is that of the first one.
    """
    completed = F.col("status") == "completed"
    tails = steps.filter("tail")
    first = tails.groupBy("flow_id").agg(F.min_by(F.struct("state", "lineage_id"), F.struct(~completed, *order)).alias("first"), F.bool_or(completed).alias("any"))
    used = tails.join(first.select("flow_id", "any"), "flow_id").filter(completed | ~F.col("any"))
    out = reduce_states(first.select("flow_id", F.col("first.state").alias("base")), used.select("flow_id", F.struct(*order).alias("o"), F.col("changes").alias("delta")), ["flow_id"], reducers)
    return out.join(first.select("flow_id", F.col("first.lineage_id").alias("lineage_id")), "flow_id").select("flow_id", "lineage_id", st.without_deleted(F.col("state")).alias("state"))


def cohort_states(cohorts: DataFrame, steps: DataFrame, reducers: dict[str, str]) -> DataFrame:
    """(flow_id, lineage_id, state, error) of cohorts (flow_id, lineage_id): what their fan-in starts from.

    The base is the spawn's state with its own changes; the changes of the completed members follow in order of branch,
    depth and id. A cohort that failed has the same state, though no fan-in follows.
    """
    keys = ["flow_id", "lineage_id"]
    spawns = steps.join(cohorts.select("flow_id", F.col("lineage_id").alias("step_id")), ["flow_id", "step_id"], "left_semi").select("flow_id", F.col("step_id").alias("lineage_id"), "state", "changes", "step_id")
    own = spawns.select(*keys, F.struct(F.lit(-1).alias("fan_out_ordinal"), F.lit(0).alias("step_depth"), "step_id").alias("o"), F.col("changes").alias("delta"))
    members = steps.filter((F.col("status") == "completed") & F.col("lineage_id").isNotNull()).join(cohorts.select(*keys), keys, "left_semi")
    members = members.select(*keys, F.struct(F.col("fan_out_ordinal").cast("int").alias("fan_out_ordinal"), F.col("step_depth").cast("int").alias("step_depth"), "step_id").alias("o"), F.col("changes").alias("delta"))
    out = reduce_states(spawns.select(*keys, F.col("state").alias("base")), own.unionByName(members), keys, reducers)
    return out.select(*keys, st.without_deleted(F.col("state")).alias("state"), "error")


def final_states(steps: DataFrame, reducers: dict[str, str], names: dict[str, list[str]], order: tuple[str, ...] = ("step_id",)) -> DataFrame:
    """(flow_id, state): the terminal state; where its first tail is inside a cohort, which then never met, the cohort's.

    names: task -> the fields that its fan-out gives to each branch; those of all spawns around the first tail are stripped.
    """
    base = staged(terminal_states(steps, reducers, order), "terminal")
    inside = base.filter("lineage_id IS NOT NULL").select("flow_id", "lineage_id")
    states = base.filter("lineage_id IS NULL").select("flow_id", "state").unionByName(cohort_states(inside, steps, reducers).select("flow_id", "state"))
    if not names or inside.isEmpty():
        return states
    links = steps.filter("lineage_id IS NOT NULL").select("flow_id", F.struct("flow_id", F.col("step_id").alias("id")).alias("inner"), F.struct("flow_id", F.col("lineage_id").alias("id")).alias("outer"))
    around = descendants(links, inside.select(F.struct("flow_id", F.col("lineage_id").alias("id")).alias("at")), "inner", "outer")
    tasks = steps.select(F.struct("flow_id", F.col("step_id").alias("id")).alias("node"), "task_name")
    gone = F
    for task, fields in names.items():
        gone = gone.when(F.col("task_name") == task, F.array(*map(F.lit, fields)))
    strip = around.join(tasks, "node").select(F.col("root.flow_id").alias("flow_id"), gone.otherwise(F.array().cast("array<string>")).alias("names")).groupBy("flow_id").agg(F.flatten(F.collect_list("names")).alias("names"))
    out = states.join(strip, "flow_id", "left")
    return out.select("flow_id", F.map_filter("state", lambda k, v: ~F.coalesce(F.array_contains(F.col("names"), k), F.lit(False))).alias("state"))


def climbed(spawns: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spawns with their counters, failed flows): each failed branch arrives at its spawn; a cohort that is complete with a
    failure fails as a branch of the cohort around it, and a flow whose outermost cohort did so fails.

    spawns: step_id, flow_id, lineage_id (null outside of cohorts), cohort_size, cohort_arrivals, cohort_failures; failed: a
    row (step_id) of the spawn of each branch that failed. A round for each depth of nesting, for all flows at once.
    """
    level = staged(failed.groupBy("step_id").agg(F.count(F.lit(1)).alias("new")), "failed")
    lost = spawns.filter(F.lit(False)).select("flow_id")
    while not level.isEmpty():
        met = spawns.join(level, "step_id", "left").withColumn("new", F.coalesce("new", F.lit(0)))
        met = met.withColumns({"cohort_arrivals": F.col("cohort_arrivals") + F.col("new"), "cohort_failures": F.col("cohort_failures") + F.col("new")})
        met = staged(met.withColumn("over", (F.col("new") > 0) & (F.col("cohort_arrivals") >= F.col("cohort_size"))), "climb")
        lost = lost.unionByName(met.filter(F.col("over") & F.col("lineage_id").isNull()).select("flow_id"))
        level = staged(met.filter(F.col("over") & F.col("lineage_id").isNotNull()).groupBy(F.col("lineage_id").alias("step_id")).agg(F.count(F.lit(1)).alias("new")), "failed")
        spawns = met.drop("new", "over")
    return spawns, lost.distinct()
