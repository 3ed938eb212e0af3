"""Notification cool-down over a finished alarm table (T-06, batch form).

An alarm is kept if it comes at least the cool-down after the last *kept* one
of its key. That is a chain through the key's whole history, so no window
function states it, and one key may hold nearly all alarms. The chain is
followed by pointer doubling, all of it as joins on (key, moment), which
spread a key like any other rows:

1. every alarm gets an edge to the first alarm that may be sent after it. Time
   slices find it: within a slice by a backward scan, beyond by the slice
   heads;
2. edges are doubled until none leads on: after k rounds an edge spans 2^k
   alarms that would be sent. Only alarms that some edge leads to take part;
3. marks start at each key's first alarm and are spread by the edges from the
   longest to the shortest, after which exactly the sent alarms are marked.

No row holds more than one alarm. A chain of a million alarms takes twenty
rounds. Rounds are written to the shared folder, so their lineage is short.
"""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, Window, functions as F

from ..session import shared_folder
from ..sources import files

COOLDOWN_SECONDS = 3600
# Cool-downs in a slice, within which the next alarm is found by a scan.
SLICE_COOLDOWNS = 24

_KEY = ("_k1", "_k2")


def _edges(alarms: DataFrame, cooldown: int, slice_cooldowns: int) -> DataFrame:
    """(_k1, _k2, us, next) of distinct (_k1, _k2, us): the first alarm at or
    after the end of the cool-down that `us` starts, null where there is none."""
    width = cooldown * slice_cooldowns
    probe = F.struct((F.col("us") + cooldown).alias("at"), F.col("us").alias("from"))
    alarm = F.struct(F.col("us").alias("at"), F.lit(None).cast("long").alias("from"))
    rows = alarms.select(*_KEY, F.explode(F.array(alarm, probe)).alias("r")).select(
        *_KEY, F.floor(F.col("r.at") / width).alias("slice"), "r.at", "r.from"
    )
    is_alarm = F.when(F.col("from").isNull(), F.col("at"))
    # From the far end back, an alarm at the very moment comes before the probe.
    back = Window.partitionBy(*_KEY, "slice").orderBy(F.desc("at"), F.col("from").isNotNull())
    inside = F.last(is_alarm, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    heads = rows.groupBy(*_KEY, "slice").agg(F.min(is_alarm).alias("head"))
    later = Window.partitionBy(*_KEY).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("beyond", F.last("head", ignorenulls=True).over(later)).drop("head")
    found = rows.withColumn("inside", inside).where(F.col("from").isNotNull())
    return found.join(heads, [*_KEY, "slice"]).select(
        *_KEY, F.col("from").alias("us"), F.coalesce("inside", "beyond").alias("next")
    )


def _marked(edges: DataFrame, folder: str) -> DataFrame:
    """(_k1, _k2, us) of the alarms on each key's chain from its first alarm on."""
    spark = edges.sparkSession

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    whole = written(edges, "edges")
    first = whole.groupBy(*_KEY).agg(F.min("us").alias("us"))
    # An alarm no edge leads to is sent only if it is its key's first.
    met = whole.where("next is not null").select(*_KEY, F.col("next").alias("us")).union(first.select(*_KEY, "us")).distinct()
    jumps = [written(whole.join(met, [*_KEY, "us"], "left_semi").where("next is not null"), "jumps-0")]
    while True:
        ahead = jumps[-1].select(*_KEY, F.col("us").alias("next"), F.col("next").alias("then"))
        twice = jumps[-1].join(ahead, [*_KEY, "next"]).select(*_KEY, "us", F.col("then").alias("next"))
        twice = written(twice, f"jumps-{len(jumps)}")
        if twice.isEmpty():
            break
        jumps.append(twice)
    marks = written(first, "marks")
    for level in range(len(jumps) - 1, -1, -1):
        reached = marks.join(jumps[level], [*_KEY, "us"]).select(*_KEY, F.col("next").alias("us"))
        marks = written(marks.union(reached), f"marks-{level}")
    for name in ("edges", "marks", *(f"jumps-{i}" for i in range(len(jumps) + 1)), *(f"marks-{i}" for i in range(1, len(jumps)))):
        files.remove(spark, f"{folder}/{name}")
    return marks


def cool_down(
    alarms: DataFrame,
    keys: Sequence[str] = ("mesh_id", "device_id", "channel", "detector"),
    time: str = "triggered_at",
    tie: Sequence[str] = ("message",),
    cooldown_seconds: int = COOLDOWN_SECONDS,
    slice_cooldowns: int = SLICE_COOLDOWNS,
    last_sent: DataFrame | None = None,
) -> DataFrame:
    """Alarms that would be sent. `tie` chooses among alarms of one instant.

    `last_sent` (the keys and `sent_at`) are alarms sent before: a key's first
    alarm must come a cool-down after. Null members of keys are equal to each
    other. An alarm without a time is not sent. A cool-down of zero or less
    sends one alarm per instant.
    """
    spark = alarms.sparkSession
    cooldown = max(cooldown_seconds * 1_000_000, 1)
    others = [c for c in alarms.columns if c not in {*keys, time, *tie}]
    # Two hashes of the key stand for it in the joins; null members hash by their place.
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in keys]
    hashes = {name: F.xxhash64(F.lit(i), *parts) for i, name in enumerate(_KEY)}
    # At most one alarm per key and instant can be sent.
    single = (
        alarms.where(F.col(time).isNotNull())
        .groupBy(*keys, time)
        .agg(F.min(F.struct(*tie, *others)).alias("_row"))
        .withColumns(hashes)
        .withColumn("us", F.unix_micros(time))
    )
    if last_sent is not None:
        before = last_sent.select(*[p.alias(f"_p{i}") for i, p in enumerate(parts)], F.unix_micros("sent_at").alias("_sent"))
        before = before.select(
            *[F.xxhash64(F.lit(i), *[f"_p{j}" for j in range(len(keys))]).alias(name) for i, name in enumerate(_KEY)], "_sent"
        )
        single = single.join(before, list(_KEY), "left").where(F.coalesce(F.col("us") >= F.col("_sent") + cooldown, F.lit(True))).drop("_sent")
    folder = f"{shared_folder(spark)}/cooldown-{uuid4().hex}"
    single.write.parquet(f"{folder}/alarms")
    single = spark.read.schema(single.schema).parquet(f"{folder}/alarms")
    marks = _marked(_edges(single.select(*_KEY, "us"), cooldown, slice_cooldowns), folder)
    sent = single.join(marks, [*_KEY, "us"], "left_semi")
    return sent.select(*[F.col(c) if c in (*keys, time) else F.col(f"_row.{c}").alias(c) for c in alarms.columns])
