"""Blueprints as data: all steps of all blueprints in one pass over the readings.

`run_steps` (blueprints.py) makes columns of one blueprint's steps. Here the
steps stay rows: they are bound once per blueprint, travel to the aligned rows
of its devices as one array, and are folded inside the row over a map of
channels. So the readings are scanned and aligned once, and the plan is the
same for two blueprints or two hundred thousand.

A step that looks at earlier readings (B-02) can't run inside a row. Steps
are therefore bound to stages: a stage folds its row-wise steps, then runs its
windowed ones, all blueprints' steps of one function together, and the next
stage sees what they gave. Recipes without windowed steps have one stage.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import algorithms
from ..functions.channels import channel_name
from ..session import shared_folder
from . import windowed
from .align import DEFAULT_INTERVAL_SECONDS, MIN_SLICE_SECONDS, TOLERANCE
from .blueprints import DEVICE

_BOUND = "blueprint_id string, `order` int, function_name string, inputs string, params string, outputs string, stage int, windowed boolean, last_orders string, units string"
_STEP = "array<struct<`order`:int,function_name:string,inputs:map<string,string>,params:map<string,string>,outputs:map<string,string>,stage:int,windowed:boolean,last_orders:map<string,int>>>"
_WRITE = "array<struct<field:string,value:double,written_by:int,step_order:int>>"

# Steps up to which the engine chooses how tables of blueprints are joined.
FEW_STEPS = 10_000


def joined_by(steps: DataFrame) -> tuple[str, ...]:
    """Hints for joins with tables of blueprints and of devices that have one.

    The engine takes such a table for as small as its compressed file and sends
    it to the driver and all executors, where a million blueprints are hundreds
    of megabytes. Beyond a few steps both sides are sorted; what sorting costs
    with a few blueprints, two partitions with all rows, is not met then."""
    return ("merge",) if steps.limit(FEW_STEPS + 1).count() > FEW_STEPS else ()


def hinted(rows: DataFrame, hints: tuple[str, ...]) -> DataFrame:
    for name in hints:
        rows = rows.hint(name)
    return rows


def needed_channels(steps: DataFrame) -> DataFrame:
    """U-03: (blueprint_id, channels), sorted; blueprints that need none are left
    out. The steps of a blueprint meet in one row, so nothing is joined."""
    gathered = lambda name: F.flatten(F.collect_list(F.map_values(name)))
    per = steps.groupBy("blueprint_id").agg(gathered("inputs").alias("read"), gathered("outputs").alias("made"))
    needed = per.select("blueprint_id", F.array_sort(F.array_compact(F.array_except("read", "made"))).alias("channels"))
    return needed.where(F.size("channels") > 0)


def _bind(steps: list[dict], kinds: Mapping[str, tuple[bool, dict]], units: dict) -> list[dict]:
    """The steps of one recipe that can run, in order, with their stages.

    A step runs if its function is known and everything it reads is a channel
    of the device or written by an earlier step. It belongs to the first stage
    in which what it reads is there and those that read the channels it writes,
    before it, have done so.
    """
    made = {c for s in steps for c in s["outputs"].values()}
    current = {c for s in steps for c in s["inputs"].values()} - made
    ready: dict[str, int] = {}  # stage in which a channel's latest value is there
    free: dict[str, int] = {}  # stage from which it may be overwritten
    unit_of, given, last, out = dict(units), {}, {}, []
    for step in sorted(steps, key=lambda s: s["order"]):
        if step["function_name"] not in kinds:
            continue
        is_windowed, output_units = kinds[step["function_name"]]
        read = {arg: unit_of.get(c) for arg, c in step["inputs"].items()}
        for output, channel in step["outputs"].items():
            unit = output_units.get(output)
            if unit and unit.startswith(algorithms.INHERIT):
                unit = read.get(unit.removeprefix(algorithms.INHERIT))
            given[channel] = unit
            unit_of[channel] = unit or unit_of.get(channel)
        if not set(step["inputs"].values()) <= current:
            continue
        writes = [c for o, c in step["outputs"].items() if o in output_units]
        stage = max([ready.get(c, 0) for c in step["inputs"].values()] + [max(ready.get(c, 0), free.get(c, 0)) for c in writes] + [0])
        for c in step["inputs"].values():
            free[c] = max(free.get(c, 0), stage + is_windowed)
        for c in writes:
            current.add(c)
            ready[c] = stage + is_windowed
            last[c] = step["order"]
        out.append({**step, "stage": stage, "windowed": is_windowed})
    return [{**s, "last_orders": last, "units": given} for s in out]


def bound_steps(steps: DataFrame, types: DataFrame | None = None, hints: tuple[str, ...] = ()) -> DataFrame:
    """Steps that can run (`_BOUND`), for all blueprints; a recipe is short, and
    is one row here, so a call binds a batch of them. Units of what the steps
    write are worked out beside."""
    kinds = {
        name: (a.mode == algorithms.WINDOWED, dict(a.output_units))
        for name, a in algorithms.REGISTRY.items()
        if a.mode == algorithms.POINTWISE or a.over
    }
    rows = steps.select(
        "blueprint_id", "order", "function_name", "inputs", F.coalesce("params", F.lit("{}")).alias("params"), "outputs"
    )
    step = F.struct("order", "function_name", "inputs", "params", "outputs")
    whole = rows.groupBy("blueprint_id").agg(F.to_json(F.collect_list(step)).alias("steps"))
    if types is None:
        whole = whole.withColumn("known", F.lit("{}"))
    else:
        known = types.select(channel_name(F.col("payload_kind"), F.col("field_name")).alias("channel"), "native_unit").groupBy("channel").agg(F.max("native_unit").alias("unit"))
        entries = F.map_from_entries(F.collect_list(F.struct("channel", "unit")))
        needed = needed_channels(steps).select("blueprint_id", F.explode("channels").alias("channel"))
        per = needed.join(known, "channel").where("unit is not null").groupBy("blueprint_id").agg(F.to_json(entries).alias("known"))
        whole = whole.join(hinted(per, hints), "blueprint_id", "left").withColumn("known", F.coalesce("known", F.lit("{}")))

    texts = ("inputs", "outputs", "last_orders", "units")
    columns = ["blueprint_id", "order", "function_name", "inputs", "params", "outputs", "stage", "windowed", "last_orders", "units"]

    def bind(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for blueprint, steps, known in zip(frame["blueprint_id"], frame["steps"], frame["known"], strict=True):
                # A field that is null is not in the text.
                recipe = [{"function_name": None, **s, "inputs": s.get("inputs", {}), "outputs": s.get("outputs", {})} for s in json.loads(steps)]
                for s in _bind(recipe, kinds, json.loads(known)):
                    s |= {"blueprint_id": blueprint, **{c: json.dumps(s[c]) for c in texts}}
                    out.append([s[c] for c in columns])
            yield pd.DataFrame(out, columns=columns)

    return whole.select("blueprint_id", "steps", "known").mapInPandas(bind, _BOUND)


def recipes_of(bound: DataFrame) -> DataFrame:
    """(blueprint_id, recipe, stages): a recipe as one array of steps in order."""
    texts = lambda name: F.from_json(name, "map<string,string>").alias(name)
    step = F.struct(
        "order", "function_name", texts("inputs"), texts("params"), texts("outputs"), "stage", "windowed",
        F.from_json("last_orders", "map<string,int>").alias("last_orders"),
    )
    by_order = lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0)
    return bound.groupBy("blueprint_id").agg(
        F.array_sort(F.collect_list(step), by_order).cast(_STEP).alias("recipe"), (F.max("stage") + 1).alias("stages")
    )


# --- alignment, with the channels of each device as data --------------------


def aligned_cells(
    readings: DataFrame, members: DataFrame, steps: DataFrame, min_slice_seconds: int = MIN_SLICE_SECONDS, hints: tuple[str, ...] = ()
) -> DataFrame:
    """J-05 for all blueprints at once: (blueprint_id, mesh_id, node_id, time,
    packet_id, cells), a row per base reading, `cells` a map from channel to
    the reading nearest to it. `members` are devices with a blueprint.

    Base and other channels are those of the device's blueprint; the rules are
    those of `align_nearest`. Readings of a channel and the base readings that
    look for it meet in (device, channel, time slice), in one shuffle. Base
    readings alike in time, packet and value give one row.
    """
    needs = needed_channels(steps).select("blueprint_id", F.element_at("channels", 1).alias("base"), F.slice("channels", 2, 2**30).alias("others"))
    interval = F.coalesce(F.nullif("reading_interval_seconds", F.lit(0)), F.lit(DEFAULT_INTERVAL_SECONDS)).cast("double")
    owned = members.select("mesh_id", F.col("device_id").alias("node_id"), F.col("postprocessing_blueprint_id").alias("blueprint_id"), interval.alias("_interval"))
    us, reach = F.col("_us"), F.col("_reach")
    owned = owned.join(hinted(needs, hints), "blueprint_id")
    rows = readings.where(F.col("value").isNotNull()).join(hinted(owned, hints), list(DEVICE)).select(
        *DEVICE, "blueprint_id", "channel", "base", "others", F.unix_micros("time").alias("_us"), "value", "packet_id",
        F.floor(F.col("_interval") * (TOLERANCE * 1e6)).cast("long").alias("_reach"),
        (F.greatest(F.ceil("_interval"), F.lit(min_slice_seconds)) * 1_000_000).cast("long").alias("_width"),
    )
    is_base, is_other = F.col("channel") == F.col("base"), F.array_contains("others", F.col("channel"))
    number = lambda moment: F.floor(moment / F.col("_width"))
    # A base reading asks for each other channel, or for none; a sample lies in at most two slices.
    asks = F.transform(
        F.when(F.size("others") > 0, F.col("others")).otherwise(F.array(F.lit(None).cast("string"))),
        lambda c: F.struct(c.alias("of"), number(us).alias("slice"), F.lit(1).alias("asks")),
    )
    gives = F.transform(
        F.sequence(number(us - reach), number(us + reach)), lambda s: F.struct(F.col("channel").alias("of"), s.alias("slice"), F.lit(0).alias("asks"))
    )
    spread = rows.where(is_base | is_other).withColumn("_e", F.explode(F.when(is_base, asks).otherwise(gives)))
    spread = spread.select(*DEVICE, "blueprint_id", "base", "others", "_us", "value", "packet_id", "_reach", "_e.*")
    slot = Window.partitionBy(*DEVICE, "of", "slice")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    sample = F.when(F.col("asks") == 0, F.struct(us.alias("us"), "value"))
    met = spread.withColumns(
        {
            "_p": F.last(sample, ignorenulls=True).over(slot.orderBy("_us", "asks", "packet_id").rowsBetween(*so_far)),
            "_n": F.last(sample, ignorenulls=True).over(slot.orderBy(F.desc("_us"), "asks", "packet_id").rowsBetween(*so_far)),
        }
    ).where("asks = 1")
    to_before, to_after = us - F.col("_p.us"), F.col("_n.us") - us
    use_after = F.col("_n").isNotNull() & (F.col("_p").isNull() | (to_after <= to_before))
    near = F.when(use_after, to_after).otherwise(to_before) <= reach
    picked = F.struct(F.col("of").alias("channel"), F.when(use_after, F.col("_n.value")).otherwise(F.col("_p.value")).alias("value"))
    found = met.where(F.col("of").isNull() | near).groupBy(*DEVICE, "blueprint_id", "base", "_us", "value", "packet_id")
    whole = found.agg(F.first("others").alias("others"), F.collect_set(F.when(F.col("of").isNotNull(), picked)).alias("found"))
    own = F.array(F.struct(F.col("base").alias("channel"), "value"))
    return whole.where(F.size("found") == F.size("others")).select(
        "blueprint_id", *DEVICE, F.timestamp_micros("_us").alias("time"), "packet_id", F.map_from_entries(F.concat(own, "found")).alias("cells")
    )


# --- evaluation -------------------------------------------------------------


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often `body` names it."""
    return F.transform(F.array(value), body)[0]


def _put(cells: Column, entries: Column) -> Column:
    """A map with some entries replaced; of two for one channel the later counts."""
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda f: f["field"] == e["field"]))
    rest = F.map_filter(cells, lambda k, _: ~F.exists(entries, lambda e: e["field"] == k))
    replaced = F.map_concat(rest, F.map_from_entries(F.transform(last, lambda e: F.struct(e["field"], e["value"]))))
    return F.when(F.size(entries) > 0, replaced).otherwise(cells)


def _written(step: Column, result: Column) -> Column:
    """What a step writes: the outputs its function has, under the channels they are bound to."""
    bound = F.filter(F.map_entries(step["outputs"]), lambda e: F.map_contains_key(result, e["key"]))
    return F.transform(
        bound,
        lambda e: F.struct(
            e["value"].alias("field"), F.element_at(result, e["key"]).alias("value"), step["order"].alias("written_by"),
            F.element_at(step["last_orders"], e["value"]).alias("step_order"),
        ),
    )


def _all_there(cells: Column, step: Column) -> Column:
    return F.forall(F.map_values(step["inputs"]), lambda c: F.try_element_at(cells, c).isNotNull())


def _after(state: Column, outcome: Column) -> Column:
    """The state after a step that wrote `entries` and `failed` or not."""
    return F.struct(
        _put(state["cells"], outcome["entries"]).alias("cells"),
        F.concat(state["writes"], outcome["entries"]).alias("writes"),
        F.concat(state["failed"], outcome["failed"]).alias("failed"),
    )


def _fold(state: Column, step: Column) -> Column:
    """One row-wise step on one row."""
    cells, name = state["cells"], step["function_name"]
    chosen = F
    for algorithm in algorithms.REGISTRY.values():
        if algorithm.mode == algorithms.POINTWISE:
            inputs = {a: F.try_element_at(cells, F.try_element_at(step["inputs"], F.lit(a))) for a in algorithm.inputs}
            results = algorithm.call(inputs, step["params"])
            pairs = [x for o, c in results.items() for x in (F.lit(o), c.cast("double"))]
            chosen = chosen.when(name == algorithm.name, F.create_map(*pairs))
    none = F.array().cast("array<string>")

    def outcome(ready: Column, computed: Column) -> Column:
        works = ready & F.coalesce(F.forall(F.map_values(computed), lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False))
        entries = F.when(works, _written(step, computed)).otherwise(F.array().cast(_WRITE))
        return F.struct(entries.alias("entries"), F.when(ready & ~works, F.array(name)).otherwise(none).alias("failed"))

    made = _with(
        F.struct(_all_there(cells, step).alias("ready")),
        lambda r: _with(F.when(r["ready"], chosen.otherwise(F.lit(None))), lambda computed: outcome(r["ready"], computed)),
    )
    return _with(made, lambda o: _after(state, o))


def _kept(rows: DataFrame, name: str) -> DataFrame:
    folder = f"{shared_folder(rows.sparkSession)}/{name}-{uuid4().hex}"
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _run_windowed(rows: DataFrame, stage: int, width_seconds: int) -> DataFrame:
    """The windowed steps of a stage: a row per step and aligned row that has all
    its inputs, a pass per function, and the results back in their rows."""
    mine = F.filter("recipe", lambda s: (s["stage"] == stage) & s["windowed"])
    each = rows.where(F.size(mine) > 0).select("blueprint_id", *DEVICE, "time", "packet_id", "_r1", "_r2", "state", F.explode(mine).alias("step"))
    each = each.where(_all_there(F.col("state.cells"), F.col("step")))
    given = each.select(
        "blueprint_id", *DEVICE, "time", "packet_id", "_r1", "_r2", F.col("step.order").alias("step_order"), "step.function_name", "step.params",
        F.transform_values("step.inputs", lambda _, c: F.try_element_at("state.cells", c)).alias("inputs"),
    )
    results = []
    for algorithm in algorithms.REGISTRY.values():
        if algorithm.mode == algorithms.WINDOWED and algorithm.over:
            own = given.where(F.col("function_name") == algorithm.name)
            inputs = {a: F.try_element_at("inputs", F.lit(a)) for a in algorithm.inputs}
            out = algorithm.over(own, inputs, F.col("params"), ("blueprint_id", *DEVICE, "step_order"), width_seconds)
            results.append(out.select("_r1", "_r2", "step_order", "result"))
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    per_row = found.groupBy("_r1", "_r2").agg(F.map_from_entries(F.collect_list(F.struct("step_order", "result"))).alias("results"))

    def take(state: Column, step: Column) -> Column:
        result = F.try_element_at("results", step["order"])
        there = F.coalesce(F.forall(F.map_values(result), lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False))
        entries = F.when(there, _written(step, result)).otherwise(F.array().cast(_WRITE))
        failed = F.when(result.isNotNull() & ~there, F.array(step["function_name"])).otherwise(F.array().cast("array<string>"))
        return _with(F.struct(entries.alias("entries"), failed.alias("failed")), lambda o: _after(state, o))

    joined = rows.join(per_row, ["_r1", "_r2"], "left")
    return joined.withColumn("state", F.aggregate(mine, F.col("state"), take)).drop("results")


def run_recipes(
    aligned: DataFrame, recipes: DataFrame, width_seconds: int = MIN_SLICE_SECONDS, hints: tuple[str, ...] = ()
) -> DataFrame:
    """B-01, B-02, B-04: aligned rows with `state`: the channels as the steps left
    them, what was written in order, and the functions that failed.

    A step with an input that is missing is passed over; one whose result has
    a missing or non-number member fails as a whole, keeps the old values and
    writes nothing. The driver sees a row per stage.
    """
    found = recipes.select(F.explode("recipe").alias("s")).groupBy("s.stage").agg(F.bool_or("s.windowed").alias("windowed")).collect()
    windowed_stages = {r["stage"] for r in found if r["windowed"]}
    stages = max((r["stage"] + 1 for r in found), default=0)
    start = F.struct(F.col("cells"), F.array().cast(_WRITE).alias("writes"), F.array().cast("array<string>").alias("failed"))
    rows = aligned.join(hinted(recipes.drop("stages"), hints), "blueprint_id").withColumn("state", start).drop("cells")
    # Two hashes of what tells rows of a device apart name the row.
    named = ("blueprint_id", *DEVICE, "time", "packet_id")
    names = {f"_r{i}": F.xxhash64(F.lit(i), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in named], F.to_json("state.cells")) for i in (1, 2)}
    rows = rows.withColumns(names)
    for stage in range(stages):
        mine = F.filter("recipe", lambda s: (s["stage"] == stage) & ~s["windowed"])
        rows = rows.withColumn("state", F.aggregate(mine, F.col("state"), _fold))
        if stage in windowed_stages:
            rows = _run_windowed(_kept(rows, f"recipes-{stage}"), stage, width_seconds)
    return rows.drop("_r1", "_r2", "recipe")


def derived_rows(run: DataFrame) -> DataFrame:
    """S-07: one row per written value, as `blueprints.derived_rows` gives them.

    An inner explode would have the engine ask first, below its joins, whether
    there is anything to explode, and run all steps once more for the answer."""
    each = run.select("blueprint_id", *DEVICE, "time", F.explode_outer("state.writes").alias("w"))
    return each.where("w is not null").select(
        *DEVICE, "blueprint_id", F.col("w.step_order").alias("step_order"), F.col("w.written_by").alias("written_by"),
        F.col("w.field").alias("field"), "time", F.col("w.value").alias("value"),
    )


def failure_counts(run: DataFrame) -> DataFrame:
    """A-15 over all blueprints."""
    each = run.select(F.explode_outer("state.failed").alias("function_name")).where("function_name is not null")
    return each.groupBy("function_name").agg(F.count(F.lit(1)).alias("rows_skipped"))


def unit_table(bound: DataFrame) -> DataFrame:
    """B-06: (blueprint_id, field_units), the units of what a blueprint writes that have one."""
    units = bound.groupBy("blueprint_id").agg(F.first("units").alias("units"))
    given = F.map_filter(F.from_json("units", "map<string,string>"), lambda _, u: F.coalesce(u, F.lit("")) != "")
    return units.select("blueprint_id", F.when(F.size(given) > 0, given).alias("field_units"))


def derived_discoveries(derived: DataFrame, bound: DataFrame, seen_at: Column) -> DataFrame:
    """S-09: the derived channels of each device, for the catalog; fields of a
    device are bounded by the outputs of its blueprint."""
    fields = derived.groupBy("mesh_id", F.col("node_id").alias("device_id"), "blueprint_id").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    return fields.join(unit_table(bound), "blueprint_id", "left").select(
        "mesh_id", "device_id", F.lit("derived").alias("payload_kind"), "fields", "field_units", seen_at.alias("seen_at"), F.lit("upsert").alias("op")
    )
