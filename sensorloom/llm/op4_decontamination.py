"""Benchmark passages in documents: SimHash of item-sized windows, Hamming blocks, exact verification.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import scratch, stage, table

SHINGLE = 5
SIMILARITY = 0.8
#: A fingerprint has 128 bits in blocks of 8, and blocks are looked up with up to PROBE bits turned. If two
#: fingerprints differ in at most RADIUS places, some block differs in at most PROBE, so it is found.
BLOCKS, BLOCK_BITS, PROBE = 16, 8, 2
RADIUS = BLOCKS * (PROBE + 1) - 1
#: Shingles of a benchmark up to which they are broadcast: a hash table of about 100 MB. A larger
#: benchmark is joined by a shuffle.
BROADCAST_SHINGLES = 2_000_000


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case, so that case and punctuation hide nothing."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column, n: Column) -> Column:
    """Hashes of the n-word shingles in order; of all words as one if they are fewer; none of none."""
    last = F.greatest(F.size(w) - n, F.lit(0)) + 1
    return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(w, i, n)))).otherwise(
        F.array().cast("array<bigint>")
    )


def simhash(hashes: Column) -> Column:
    """64 bits: bit b is the majority of bit b of all shingles, each weighing as often as it occurs. Ties
    go to 1 in every other place."""
    ones = lambda b: F.size(F.filter(hashes, lambda g: F.getbit(g, b) == 1)) * 2
    wins = lambda b: (ones(b) > F.size(hashes)) | ((ones(b) == F.size(hashes)) & (b % 2 == 1))
    none = F.lit(0).cast("bigint")
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), none,
        lambda acc, b: acc.bitwiseOR(F.when(wins(b), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(none)),
    )


def marks(grams: Column) -> Column:
    """The fingerprint of a window in two halves, the second of the shingles hashed again. Shingles are what
    similarity is made of, so the angle between two windows follows from it; words would let unlike windows
    of a small vocabulary pass."""
    return F.struct(simhash(grams).alias("high"), simhash(F.transform(grams, lambda h: F.xxhash64(h))).alias("low"))


def blocks(mark: Column, probe: int = 0) -> Column:
    """(block, bits): the blocks of a fingerprint, each with every choice of up to `probe` bits turned."""
    turns = [0] + [1 << i for i in range(BLOCK_BITS)] * (probe > 0)
    turns += [1 << i | 1 << j for i in range(BLOCK_BITS) for j in range(i)] * (probe > 1)
    half = BLOCKS // 2
    parts = [
        F.shiftrightunsigned(mark["high" if b < half else "low"], b % half * BLOCK_BITS).bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")
        for b in range(BLOCKS)
    ]

    def turned(number: int, part: Column) -> Column:
        return F.transform(F.array(*map(F.lit, turns)), lambda t: F.struct(F.lit(number).alias("block"), part.bitwiseXOR(t).alias("bits")))

    return F.flatten(F.array(*[turned(b, p) for b, p in enumerate(parts)]))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a["high"].bitwiseXOR(b["high"])) + F.bit_count(a["low"].bitwiseXOR(b["low"]))


def overlap(x: Column, y: Column) -> Column:
    """Sum over shingles of the smaller of their two counts."""
    count = lambda g, a: F.size(F.filter(a, lambda v: v == g))
    plain = (F.size(F.array_distinct(x)) == F.size(x)) & (F.size(F.array_distinct(y)) == F.size(y))
    counted = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda acc, g: acc + F.least(count(g, x), count(g, y)))
    return F.when(plain, F.size(F.array_intersect(x, y))).otherwise(counted)


def benchmark_items(items: DataFrame) -> DataFrame:
    """(item_id, item, size, n, grams, mark) of items with words; repeated rows once."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0").distinct()
    n = F.least(F.size("w"), F.lit(SHINGLE))
    g = w.select("item_id", F.size("w").alias("size"), n.alias("n"), shingles(F.col("w"), n).alias("grams"))
    # Two texts under one id are two items.
    return g.withColumns({"item": F.xxhash64("item_id", "grams"), "mark": marks(F.col("grams"))})


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, item_id, start, window_words, similarity): for each document text and item the
    best window, if its weighted similarity (sum of smaller over sum of larger counts of shingles) is at
    least the given one. `start` is the first word of the window, from 0.

    1. Windows have the size of an item. They are cut from whole documents wherever a shingle of any item of
       that size stands, so that it stands where it does in the item; a window that is similar at all has
       such a shingle. Items that share a line share these places. A text shorter than an item is one
       window. Where the benchmark's shingles are broadcast, windows are cut in the same pass, and nothing
       of a document but its windows is moved.
    2. The 128-bit SimHash of a window is looked up among those of all items of its size: its blocks meet
       the items' blocks with up to two bits turned, which finds every fingerprint within the radius of 47.
       Two windows of similarity 0.8 differ in 19 bits on average with a deviation of 4, so some 1e-11 of
       them are beyond it; it is about 1e-3 for the worst of repetitive items, a few shingles shared equally often. Of
       unlike windows 2 in 1,000 are within.
    3. Candidates are verified on the shingles themselves.

    The work grows with the documents and the windows; no group is gathered, and a passage in a third of all
    documents costs a few rows each. Null, empty and wordless texts hold no leak and are none; items below
    five words are one shingle; a null doc_id is an id like another; repeated rows give one row; ties take
    the first window; other columns are not read; no documents or no items give no rows.
    """
    with scratch(docs.sparkSession) as keep:
        bench = stage(benchmark_items(items.select("item_id", "text")), "items")
        anchors = stage(bench.select("n", "size", F.posexplode("grams").alias("off", "gram")).distinct(), "anchors")
        hot = anchors.count() <= BROADCAST_SHINGLES
        lengths = [r[0] for r in bench.select("n").distinct().collect()]  # at most five
        texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where("text is not null")
        split = texts.select("doc_id", "text_hash", words(F.col("text")).alias("w")).where("size(w) > 0")
        at = ["doc_id", "text_hash", "size", "start"]
        start = F.greatest(F.least(F.col("pos") - F.col("off"), F.col("n_words") - F.col("size")), F.lit(0)).alias("start")
        cells = None
        for n in lengths or [SHINGLE]:
            own = anchors.where(F.col("n") == n)
            spread = split.select("doc_id", "text_hash", "w", F.size("w").alias("n_words"), F.posexplode(shingles(F.col("w"), F.lit(n))).alias("pos", "gram"))
            if hot:
                found = spread.join(F.broadcast(own), "gram").select("doc_id", "text_hash", "n", "size", start, "w")
            else:
                places = spread.drop("w").join(own, "gram").select("doc_id", "text_hash", "n", "size", start).distinct()
                same = [F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in at[:2]]
                found = places.alias("p").join(split.alias("s"), same).select("p.*", "s.w")
            found = found.withColumn("w", F.slice("w", F.col("start") + 1, F.col("size")))
            cells = found if cells is None else cells.union(found)
        cells = cells.groupBy(*at, "n").agg(F.first("w").alias("w"))  # equal for equal places
        cells = cells.select(*at, F.size("w").alias("window_words"), shingles(F.col("w"), F.col("n")).alias("grams"))
        cells = stage(cells.withColumn("mark", marks(F.col("grams"))), "cells")
        probe = cells.select(*at, "mark", F.inline(blocks(F.col("mark"))))
        index = bench.select("item", "size", F.col("mark").alias("item_mark"), F.inline(blocks(F.col("mark"), PROBE)))
        close = probe.join(index, ["size", "block", "bits"]).where(distance(F.col("mark"), F.col("item_mark")) <= RADIUS)
        close = stage(close.select(*at, "item").distinct(), "close")
        same = [F.col(f"h.{k}").eqNullSafe(F.col(f"e.{k}")) for k in at]
        pairs = close.alias("e").join(cells.alias("h"), same).select("h.*", "e.item")
        pairs = pairs.join(bench.select("item", "item_id", F.col("grams").alias("item_grams")), "item")
        exact = pairs.withColumn("both", overlap(F.col("grams"), F.col("item_grams")))
        value = F.col("both") / (F.size("grams") + F.size("item_grams") - F.col("both"))
        exact = exact.withColumn("similarity", value).where(F.col("similarity") >= similarity)
        best = F.min(F.struct((-F.col("similarity")).alias("less"), "start", "window_words")).alias("b")
        found = exact.groupBy("doc_id", "text_hash", "item", "item_id").agg(best).select(
            "doc_id", "text_hash", "item_id", F.col("b.start").alias("start"), F.col("b.window_words").alias("window_words"), (-F.col("b.less")).alias("similarity")
        )
        return keep(found, "found")


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no passage of the benchmark; columns and other rows unchanged."""
    out = stage(leaks(docs, items, **options).select("doc_id", "text_hash").distinct(), "leaks").alias("out")
    rows = docs.alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("out.doc_id")) & (F.xxhash64("d.text") == F.col("out.text_hash"))
    return rows.join(out, same, "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


#: All windows of a document that begin where any shingle of the item does, without fingerprints.
ORACLE = r"""
WITH d AS (
  SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL
), i AS (
  SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark WHERE text IS NOT NULL
), ig AS (
  SELECT item_id, w, len(w) AS size, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS off FROM i WHERE len(w) > 0
), igs AS (
  SELECT item_id, size, off, array_to_string(w[off:off + 4], ' ') AS gram FROM ig
), dg AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS pos FROM d WHERE len(w) > 0
), dgs AS (
  SELECT doc_id, len(w) AS n_words, pos, array_to_string(w[pos:pos + 4], ' ') AS gram FROM dg
), c AS (
  SELECT DISTINCT g.doc_id, s.item_id, s.size, least(g.n_words, s.size) AS window_words,
    greatest(least(g.pos - s.off, g.n_words - s.size), 0) AS start
  FROM dgs g JOIN igs s USING (gram)
), wc AS (
  SELECT c.doc_id, c.item_id, c.start, c.size, c.window_words, g.gram, count(*) AS n
  FROM c JOIN dgs g ON g.doc_id = c.doc_id AND g.pos - 1 >= c.start AND g.pos - 1 <= c.start + greatest(c.window_words - 5, 0)
  GROUP BY ALL
), ic AS (
  SELECT item_id, gram, count(*) AS n FROM igs GROUP BY ALL
), m AS (
  SELECT wc.doc_id, wc.item_id, wc.start, wc.window_words,
    sum(least(wc.n, coalesce(ic.n, 0))) AS "both",
    max(greatest(wc.window_words - 5, 0) + 1 + greatest(wc.size - 5, 0) + 1) AS total
  FROM wc LEFT JOIN ic ON ic.item_id = wc.item_id AND ic.gram = wc.gram GROUP BY 1, 2, 3, 4
), s AS (
  SELECT *, "both"::DOUBLE / (total - "both")::DOUBLE AS similarity FROM m
)
SELECT doc_id, item_id, start::INT AS start, window_words::INT AS window_words, similarity FROM s WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""
