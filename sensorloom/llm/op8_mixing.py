"""Mixing of sources to target weights by repetition rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import WORD, cut, ranked, table

WEIGHTS = (3, 1, 2)
CAP = 2.0
SHARE = 1.5
SEED = "mix"
#: Draws have 48 bits: exact in a double.
DRAWS = float(1 << 48)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Target of each source from (source, source_size).

    Sources ordered by code point, null last, take the weights in turn. The mix is `share` times all
    sizes, dealt by weight; no target is above `cap` times its source's size, and what a capped source
    leaves is dealt anew among the others until none is above. The loop works on the table of sources
    and reads two sums per round; each round caps at least one source.
    """
    # A source is compared by its bytes, which is code point order in UTF-8; null goes last.
    order = sizes.select("source", "source_size", F.col("source").isNull().alias("last"))
    rank = ranked(order, "last", "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = cut(rank.select("source", "source_size", weight.alias("weight"), F.lit(False).alias("full")))
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    while True:
        held, open_weight = rows.agg(
            F.sum(F.when(F.col("full"), F.col("source_size") * cap)), F.sum(F.when(~F.col("full"), F.col("weight")))
        ).first()
        level = (total - (held or 0.0)) / open_weight if open_weight else 0.0
        wish = F.lit(level) * F.col("weight")
        above = ~F.col("full") & (wish > F.col("source_size") * cap)
        if rows.where(above).isEmpty():
            return rows.select(
                "source", "source_size", F.when(F.col("full"), F.col("source_size") * cap).otherwise(wish).alias("target")
            )
        rows = cut(rows.withColumn("full", F.col("full") | above))


def draw(seed: str, key: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the key alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), key))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / DRAWS


def rated(
    docs: DataFrame,
    size: Column | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: str = SEED,
) -> DataFrame:
    """Every document with `mix`: struct(size, source_size, target, rate, copies).

    Rate is target over source size; a document is taken floor(rate) times, and once more if its draw is
    below the fraction. A draw is hashed from the seed, doc_id and text; rows that have both in common also draw
    by their place in the input, or a group of equal rows would be taken or left as one. Sizes are summed per source with a map-side
    part, so a source with a third of all rows is reduced before it is moved, and targets join back on
    the source; the table of sources is broadcast only if the engine finds it below its threshold.

    Null text has size 0, a null source is a source of its own, a null doc_id draws as the empty id. Reruns
    agree on the same input; where rows are equal, on input that is split alike. A source without words has target and rate 0. No rows give no rows. Other
    columns are kept; `mix` replaces a column of that name.
    """
    size = word_count(F.col("text")) if size is None else size
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary")))
    mixed = docs.withColumn("mix", F.struct(size.cast("long").alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("place")))
    # Keys that several rows have: none as a rule, few where copies are many.
    repeated = mixed.groupBy(F.col("mix.key").alias("__key")).count().where("count > 1").select("__key", F.lit(True).alias("__repeated"))
    mixed = mixed.join(repeated, F.col("mix.key") == F.col("__key"), "left")
    key = F.concat_ws(":", "mix.key", F.when(F.col("__repeated"), F.col("mix.place")))
    sizes = mixed.groupBy("source").agg(F.sum("mix.size").alias("source_size"))
    goal = targets(sizes, weights, share, cap).select(
        F.col("source").alias("__source"), F.struct("source_size", "target").alias("__goal")
    )
    joined = mixed.join(goal, F.col("source").eqNullSafe(F.col("__source")), "left")
    all_, goal_size = F.col("__goal.target"), F.col("__goal.source_size")
    rate = F.when(goal_size > 0, all_ / goal_size).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + (draw(seed, key) < rate - whole).cast("long")
    fields = [F.col("mix.size"), goal_size.alias("source_size"), all_.alias("target"), rate.alias("rate"), copies.alias("copies")]
    return joined.withColumn("mix", F.struct(*fields)).drop("__source", "__goal", "__key", "__repeated")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as many times as its rate and draw say, columns unchanged."""
    rows = rated(docs.withColumn("__kept", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), **options)
    copies = F.sequence(F.lit(1), F.col("mix.copies"))
    rows = rows.where("mix.copies > 0").select("__kept", F.explode(copies).alias("__copy"))
    return rows.select(*[F.col("__kept").getField(c).alias(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    m = F.col("mix")
    return rated(docs).select(
        "doc_id",
        m.size.alias("size"),
        m.source_size.alias("source_size"),
        m.target.alias("target"),
        (m.copies * m.size).alias("taken"),
        m.copies.alias("copies"),
    )


#: Rows of the given tables differ in id or text, so places take no part. The level at which no open source is above its cap: sources by rising cap per unit of weight, the
#: first k capped; the right k is the smallest whose level caps none of the others.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size,
    ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM s
), r AS (
  SELECT *, row_number() OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source) AS k,
    (SELECT sum(source_size)::DOUBLE * 1.5::DOUBLE FROM w) AS total
  FROM w
), l AS (
  SELECT k, source_size, weight,
    (total - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r
), f AS (
  SELECT k, level FROM l WHERE level * weight <= source_size * 2.0::DOUBLE ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size,
    CASE WHEN k < (SELECT k FROM f) THEN source_size * 2.0::DOUBLE ELSE (SELECT level FROM f) * weight END AS target
  FROM r
), c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix:' || d.key), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  ((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size)::BIGINT AS taken,
  (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM c
"""
