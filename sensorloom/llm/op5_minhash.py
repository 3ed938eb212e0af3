"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import scratch, stage, table, words_of
from sensorloom.llm.components import components, forest


@dataclass(frozen=True)
class Near:
    """Settings. A pair of similarity s shares a band with probability 1 - (1 - s**rows)**bands: all
    but 5e-7 of the pairs at 0.8, 4e-5 of those at 0.1."""

    words: int = 5
    percent: int = 80
    rows: int = 6
    bands: int = 48
    seed: int = 17
    #: Rounds in which groups of a bucket are tried by one member each before all pairs of groups are.
    star_rounds: int = 2
    #: Members above which a bucket is compared in blocks, and documents of a block.
    large: int = 64
    block: int = 256
    #: Two sets of similarity 0.8 differ in 12.8 of the SKETCH low bits of their signatures on average, with
    #: a deviation of 3.4; pairs that differ in more than this are not fetched.
    sketch_bits: int = 32


#: Bits of a sketch: the lowest of so many coordinates.
SKETCH = 128


def shingle_set(text: str | None, n: int) -> set:
    """Distinct n-word shingles; fewer words make one shingle of all; no words make none."""
    words = words_of(text)
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(n)), strict=False))


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: list[bytes], n: int, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    if len(cache) > 500_000:
        cache.clear()
    one = []
    for w in words:
        h = cache.get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w)
            if len(w) <= 64:
                cache[w] = h
        one.append(h)
    h = np.array(one, np.uint64)
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = _mix64(out + h[i : i + len(out)] + np.uint64(i + 1))
    return np.unique(out)


def _permute(x: np.ndarray) -> None:
    """A fixed permutation of the 32-bit numbers, in place: xor-shifts and odd factors."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)


def signature(hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Circulant MinHash. The first permutation scatters the shingles over the circle of 32-bit numbers;
    coordinate k is the minimum of the second permutation shifted by k places round that circle."""
    start = (hashes >> np.uint64(32)).astype(np.uint32) + np.uint32(seed)
    start *= np.uint32(0x9E3779B1)
    _permute(start)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    step = max(1, 16_384 // max(1, min(len(start), 2_048)))
    for at in range(0, len(start), 2_048):
        part = start[None, at : at + 2_048]
        for k in range(0, size, step):
            x = part - shifts[k : k + step]
            _permute(x)
            np.minimum(out[k : k + step], x.min(axis=1), out=out[k : k + step])
    return out


def band_keys(sig: np.ndarray, near: Near) -> np.ndarray:
    rows = sig.reshape(near.bands, near.rows).astype(np.uint64)
    out = np.arange(near.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(near.rows):
        out = _mix64(out + rows[:, i] + np.uint64(1))
    return out.view(np.int64)


def _signed(frame: DataFrame, near: Near) -> DataFrame:
    """(id, n, d1, d2, s1, s2, bands) of every row of (id, text): set size, digest of the set, sketch, band keys."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[bytes, int] = {}
        for frame in frames:
            rows = []
            for text in frame["text"]:
                hashes = shingle_hashes(words_of(text), near.words, cache)
                if len(hashes):
                    digest = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.int64)
                    sig = signature(hashes, near.bands * near.rows, near.seed)
                    bits = np.packbits((sig[:SKETCH] & np.uint32(1)).astype(np.uint8)).view(np.int64)
                    rows.append((len(hashes), *map(int, (*digest, *bits)), band_keys(sig, near)))
                else:
                    rows.append((0, 0, 0, 0, 0, np.empty(0, np.int64)))
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pd.DataFrame({"id": frame["id"], **dict(zip(("n", "d1", "d2", "s1", "s2", "bands"), columns, strict=True))})

    return frame.mapInPandas(make, "id long, n long, d1 long, d2 long, s1 long, s2 long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """Those of the pairs (a, b) whose full sets meet the threshold."""

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        @lru_cache(maxsize=64)  # ends of hot pairs come again and again
        def members(text: str) -> frozenset:
            return frozenset(shingle_set(text, near.words))

        for frame in frames:
            good = []
            for ta, tb in zip(frame["ta"], frame["tb"], strict=True):
                x, y = members(ta), members(tb)
                both = len(x & y)
                good.append(100 * both >= near.percent * (len(x) + len(y) - both))
            yield frame.loc[good, ["a", "b"]]

    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInPandas(check, "a long, b long")


def _pairs(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def near_links(docs: DataFrame, near: Near) -> tuple[DataFrame, DataFrame]:
    """Rows (id, n) of all documents with an id, and links (a, b) whose components are those of all
    pairs at or above the threshold.

    1. Each text becomes its set's digest and band keys in one pass. Equal digests form a class; only its
       smallest id goes on, so thousands of copies cost one row each and no pair.
    2. Ids that share a band key form a bucket. Nothing is ever paired within a bucket at large: one
       member stands for each component found so far, and that of the largest is compared with the others.
       Every comparison is exact, on the sets of the whole texts. Rounds and buckets differ in who stands
       for a component, so a member that is not similar to one of it meets many others.
    3. What different components still share buckets is compared in full, so no link is lost to a star
       whose centre is not similar to two members that are similar to each other. Members of small buckets
       are paired; large buckets go by blocks (`_block_links`).

    Pairs whose sizes rule out the threshold, or whose sketches make it a matter of one in a million, are
    dropped before texts are fetched.
    """
    rows = docs.where("id is not null").select("id", "text")
    signed = stage(_signed(rows, near), "minhash")
    full = signed.where("n > 0")
    classes = full.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = stage(classes, "classes")
    copies = full.join(classes.where("copies > 1"), ["d1", "d2"]).where("id <> rep").select(*_pairs("rep", "id"))
    reps = full.join(classes.select("d1", "d2", F.col("rep").alias("id")), ["d1", "d2", "id"], "left_semi")
    cells = reps.select("id", "n", "s1", "s2", F.explode("bands").alias("key"))
    shared = cells.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    members = stage(cells.join(shared.select("key"), "key").select("key", "id", "n", "s1", "s2").distinct(), "buckets")
    texts = stage(rows.join(members.select("id").distinct(), "id", "left_semi").dropDuplicates(["id", "text"]), "texts")
    # Rows that share an id but not a text are one vertex; its links are those of its representative rows.
    apart = F.bit_count(F.col("s1").bitwiseXOR(F.col("c1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("c2")))
    able = (F.least("n", "cn") * 100 >= F.greatest("n", "cn") * near.percent) & (apart <= near.sketch_bits)
    other = [F.col(f"c.m.{x}").alias(y) for x, y in (("id", "cid"), ("n", "cn"), ("s1", "c1"), ("s2", "c2"))]
    placed = members.withColumn("part", F.col("id"))
    links = tried = None
    for turn in range(near.star_rounds):
        chance = F.xxhash64("id", "key", F.lit(turn)) if turn else F.xxhash64("id")
        order = F.struct(chance.alias("h"), "id", "n", "s1", "s2")
        stands = placed.groupBy("key", "part").agg((-F.count("*")).alias("less"), F.min(order).alias("m"))
        if not turn:
            stands = placed.select("key", F.lit(-1).alias("less"), order.alias("m"))
        centre = stands.groupBy("key").agg(F.min(F.struct("less", "m")).alias("c"))
        near_pairs = stands.join(centre, "key").select("m.*", *other).where("id <> cid").where(able)
        pairs = near_pairs.select(*_pairs("id", "cid")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stage(pairs, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        found = stage(_verified(pairs, texts, near), "links")
        links = found if links is None else links.union(found)
        placed = _still_mixed(members, stage(components(links, "a", "b"), "parts"))
        if placed.isEmpty():
            return signed.select("id", "n"), links.union(copies)
    sizes = placed.groupBy("key").agg(F.count("*").alias("m"))
    small = placed.join(sizes.where(F.col("m") <= near.large).select("key"), "key", "left_semi")
    far = [F.col(x).alias(y) for x, y in (("id", "cid"), ("n", "cn"), ("s1", "c1"), ("s2", "c2"), ("part", "cpart"))]
    met = small.join(small.select("key", *far), "key").where("part < cpart").where(able)
    pairs = met.select(*_pairs("id", "cid")).distinct()
    pairs = stage(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    links = links.union(stage(_verified(pairs, texts, near), "links"))
    large = stage(placed.join(sizes.where(F.col("m") > near.large).select("key"), "key", "left_semi").select("key", "id", "part"), "large")
    if not large.isEmpty():
        links = links.union(stage(_block_links(large, texts, near), "links"))
    return signed.select("id", "n"), links.union(copies)


def _still_mixed(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with their component as `part`."""
    placed = members.join(parts, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    mixed = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    return stage(placed.join(mixed.select("key"), "key", "left_semi"), "mixed")


def _block_links(large: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """Links between different components among the members (key, id, part) of large buckets.

    Buckets that share members form a cluster, so that what meets in many bands is compared once. A
    cluster's largest component and its other members are dealt to blocks of near.block documents; every
    block of others meets every other block and every block of the largest, which needs no comparison
    within itself. A task holds two blocks, counts common shingles of all its pairs at once, and
    returns a spanning forest of the links between components.
    """
    low = large.groupBy("key").agg(F.min("id").alias("low"))
    clusters = components(large.join(low, "key").select("id", "low"), "id", "low").select("id", F.col("component").alias("cluster"))
    rows = large.select("id", "part").distinct().join(clusters, "id")
    counts = rows.groupBy("cluster", "part").agg(F.count("*").alias("m"))
    top = counts.groupBy("cluster").agg(F.max(F.struct("m", "part")).alias("top"), F.sum("m").alias("all"))
    blocks = lambda m: F.greatest(F.ceil(m / F.lit(float(near.block))), F.lit(1))
    top = top.select("cluster", F.col("top.part").alias("main"), blocks(F.col("top.m")).alias("mains"), blocks(F.col("all") - F.col("top.m")).alias("others"))
    rows = rows.join(top, "cluster")
    is_main = F.col("part") == F.col("main")
    own = F.pmod(F.xxhash64("id"), F.when(is_main, F.col("mains")).otherwise(F.col("others")))
    each = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    cell = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    with_others = F.transform(each(F.col("others")), lambda b: cell("m", b, own))
    of_other = F.concat(
        F.transform(each(F.col("others")), lambda b: cell("o", F.least(own, b), F.greatest(own, b))),
        F.transform(each(F.col("mains")), lambda b: cell("m", own, b)),
    )
    dealt = rows.select("cluster", "id", "part", F.inline(F.when(is_main, with_others).otherwise(of_other)))
    dealt = dealt.join(texts, "id").select("cluster", "kind", "x", "y", "id", "part", "text")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set(t, near.words) for t in frame["text"]]
        seen = Counter(s for x in sets for s in x)
        column = {s: i for i, s in enumerate(s for s, k in seen.items() if k > 1)}
        cells = [np.array([column[s] for s in x if s in column], np.int64) for x in sets]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, len(column), 4096):
            part = np.zeros((len(sets), 4096), np.float32)
            for i, c in enumerate(cells):
                part[i, c[(c >= at) & (c < at + 4096)] - at] = 1
            both += part @ part.T
        n = np.array([len(x) for x in sets], np.float64)
        group = frame["part"].to_numpy(np.int64)
        near_enough = 100 * both.astype(np.float64) >= near.percent * (n[:, None] + n[None, :] - both)
        i, j = np.nonzero(np.triu(near_enough & (group[:, None] != group[None, :]), 1))
        a, b = forest(group[i], group[j])
        return pd.DataFrame({"a": a, "b": b})

    return dealt.groupBy("cluster", "kind", "x", "y").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of (doc_id, text).

    component_id is the smallest doc_id reachable over links, the row's own id where there are none.
    Null or empty texts and texts of white space have an empty set and link with nothing; texts with
    fewer words than a shingle are one shingle. Rows with a null id are kept, in no component. Rows that
    repeat an id are one vertex; each gets its own row. Order and ties don't matter: only minima of ids
    decide. Other columns are not read. No rows give no rows. Texts are taken whole, at any length.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    with scratch(docs.sparkSession) as keep:
        sizes, links = near_links(docs, near)
        parts = components(links, "a", "b")
        known = sizes.join(parts, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
        nameless = docs.where("id is null")
        nameless = _signed(nameless, near).select("id", "n", F.lit(None).cast("long").alias("component"))
        found = known.union(nameless).select(
            F.col("id").cast(kind).alias("doc_id"),
            F.col("n").alias("n_shingles"),
            F.col("component").cast(kind).alias("component_id"),
            F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
        )
        return keep(found, "near_duplicates")


def deduplicated(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """The documents with one of each group kept, the one with the smallest doc_id; columns unchanged.

    Rows are told apart by doc_id and text, so different texts under one id are documents of their own, and
    rows with a null id, the last in order, are compared too. Of rows that repeat id and text one stays,
    except those with neither an id nor a word, which all stay.
    """
    keyed = docs.withColumn("__key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))
    with scratch(docs.sparkSession) as keep:
        links = near_links(keyed.select(F.col("__key").alias("id"), F.col("text").cast("string").alias("text")), near)[1]
        parts = components(links, "a", "b").select(F.col("id").alias("__key"), "component")
        named = keyed.where("doc_id is not null or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
        keys = named.groupBy("__key").agg(F.min("doc_id").alias("own"), F.count("*").alias("times"))
        keys = stage(keys.join(parts, "__key", "left"), "keys")
        order = F.struct(F.col("own").isNull(), "own", "__key")
        grouped = keys.where("component is not null")
        # What stays is a table of keys of its own; members meet it by key, so a large group is many tasks' work.
        first = stage(grouped.groupBy("component").agg(F.min_by("__key", order).alias("__key")).select("__key"), "first")
        lost = stage(grouped.join(first, "__key", "left_anti").select("__key", F.lit(False).alias("keep")), "lost")
        again = keys.where("times > 1").join(lost, "__key", "left_anti").select("__key", F.lit(True).alias("keep"))
        ids = keep(lost.union(again), "dropped")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = keyed.join(ids, "__key", "left_anti").select(*columns)
    again = ids.where("keep").select("__key")
    if again.isEmpty():
        return once
    rows = keyed.join(again, "__key", "left_semi")
    whole = F.struct(*columns)
    chosen = rows.groupBy("__key").agg(F.min_by(whole, F.to_json(whole)).alias("r"))
    return once.unionByName(chosen.select(*[F.col("r").getField(c).alias(c) for c in docs.columns]))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Near(words=2))
