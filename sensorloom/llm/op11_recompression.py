"""Removal of long repeats: recompressed word sequences whose shared symbols say where windows recur."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import scratch, stage, table
from sensorloom.llm.parsing import Level, Prints, Words, first_level, next_level

#: Words of a window.
WINDOW = 50
#: The round whose symbols anchor windows, and the one whose symbols are blocks; a round makes symbols longer
#: by a third.
ANCHOR_ROUND, BLOCK_ROUND = 4, 14
#: Words that are parsed together, unless one text has more.
CHUNK = 200_000
NOTHING = hashlib.sha256(b"").hexdigest()


def _most(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where the least of values[first:last] is, for many ranges that are not empty."""
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    steps = [rank]
    while 2 ** len(steps) <= int((last - first).max(initial=1)):
        half = 2 ** (len(steps) - 1)
        steps.append(np.minimum(steps[-1][:-half], steps[-1][half:]) if len(steps[-1]) > half else steps[-1])
    level = np.frexp((last - first).astype(np.float64))[1] - 1
    out = np.empty(len(first), np.int64)
    for k in range(len(steps)):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(steps[k][first[at]], steps[k][last[at] - 2**k])
    return order[out]


class Parsed:
    """Some texts, parsed together.

    offsets   first word of each text; a separator stands before each and after the last
    starts    words that a window begins at
    anchor    for each of these, the fingerprint of its anchor: of the stable symbols in the window, those
              of the highest round that has any, the one with the least fingerprint. It depends on the words
              of the window alone, so equal windows have equal anchors.
    blocks    first words of the blocks that windows begin in
    """

    def __init__(self, words: Words, texts: list[list[bytes]], window: int):
        words.trim()
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.cumsum(self.sizes + 1) - self.sizes
        total = int((self.sizes + 1).sum()) + 1
        separators = np.append(self.offsets - 1, total - 1)
        places = [words.places(t) for t in texts]
        inside = np.ones(total, bool)
        inside[separators] = False
        marks = []
        for found in words.look_up(np.concatenate(places) if places else np.empty(0, np.int64)):
            mark = np.zeros(total, np.uint64)
            mark[inside] = found
            marks.append(mark)
        self.prints = Prints(marks)
        left = np.zeros(total, np.int64)  # words from here to the end of the text
        left[inside] = np.repeat(self.offsets + self.sizes, self.sizes) - np.flatnonzero(inside)
        self.ends = np.arange(total) + left
        self.starts = np.flatnonzero(left >= window)
        self.text_of = np.repeat(np.arange(len(texts)), self.sizes)[np.cumsum(inside)[self.starts] - 1] if len(self.starts) else self.starts
        levels = [first_level(marks[0], separators)]
        while len(levels) <= ANCHOR_ROUND:
            levels.append(next_level(levels[-1], len(levels)))
        self.anchor = self._anchors(levels, window)
        top = levels[-1]
        for number in range(ANCHOR_ROUND + 1, BLOCK_ROUND + 1):
            top = next_level(top, number)
        at = top.at[~top.separator]
        self.block_of = np.searchsorted(at, self.starts, "right") - 1
        used, self.block_of = np.unique(self.block_of, return_inverse=True)
        self.blocks = at[used]
        bounds = np.append(top.at, total)
        self.block_ends = bounds[np.searchsorted(bounds, self.blocks, "right")]

    def _anchors(self, levels: list[Level], window: int) -> np.ndarray:
        out = np.zeros(len(self.starts), np.uint64)
        open_ = np.arange(len(self.starts))
        for number in range(len(levels) - 1, -1, -1):
            x = levels[number]
            fine = ~x.separator & (x.high - x.low <= window)
            low, high = x.low[fine], x.high[fine]
            at = self.starts[open_]
            first, last = np.searchsorted(low, at, "left"), np.searchsorted(high, at + window, "right")
            has = last > first
            if has.any():
                value = self.prints.of(low, high, 0) ^ np.uint64(number)
                best = _most(value, first[has], last[has])
                out[open_[has]] = value[best]
            open_ = open_[~has]
        return out


def _chunks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Rows with the words of their texts, so many at a time that a chunk has about CHUNK words."""
    for batch in batches:
        begun, held, texts = 0, 0, []
        for i, value in enumerate(batch.column(text)):
            raw = value.as_py()
            texts.append(raw.split() if raw else [])
            held += len(texts[-1])
            if held >= CHUNK:
                yield batch.slice(begun, i + 1 - begun), texts
                begun, held, texts = i + 1, 0, []
        if texts:
            yield batch.slice(begun), texts


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    """Values in the order of their owners 0..n-1 as one list for each."""
    ends = np.cumsum(np.bincount(owner, minlength=n))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values))


PARSED = "doc_id long, mark long, n_words long, sha string, at long, ends long, h1 long, h2 long, anchors array<long>"


def parsed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each text with its number of words and digest (at is null), and one for each block of it in
    which a window begins: its words [at, ends) are those of all such windows. Rows without an id have no
    blocks, as they are neither earlier nor later than others."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        schema = pa.schema(
            [(c, pa.int64()) for c in ("doc_id", "mark", "n_words")] + [("sha", pa.string())]
            + [(c, pa.int64()) for c in ("at", "ends", "h1", "h2")] + [("anchors", pa.list_(pa.int64()))]
        )
        for rows, texts in _chunks(batches, "raw"):
            n = len(texts)
            sha = [hashlib.sha256(b" ".join(t)).hexdigest() for t in texts]
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("mark"), pa.array([len(t) for t in texts], pa.int64()), pa.array(sha, pa.string()),
                 none, none, none, none, pa.nulls(n, pa.list_(pa.int64()))], schema=schema,
            )
            named = np.flatnonzero(rows.column("doc_id").is_valid().to_numpy(zero_copy_only=False))
            p = Parsed(words, [texts[i] for i in named], window)
            m = len(p.blocks)
            if not m:
                continue
            ends = np.minimum(p.block_ends + window - 1, p.ends[p.blocks])
            # An anchor of a block once for each stretch of windows that has it.
            new = np.ones(len(p.starts), bool)
            new[1:] = (p.anchor[1:] != p.anchor[:-1]) | (p.block_of[1:] != p.block_of[:-1])
            text_of = np.empty(m, np.int64)
            text_of[p.block_of] = p.text_of
            row = pa.array(named[text_of])
            off = p.offsets[text_of]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(row), rows.column("mark").take(row), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()),
                 pa.array(p.blocks - off), pa.array(ends - off),
                 pa.array(p.prints.of(p.blocks, ends, 0).view(np.int64)), pa.array(p.prints.of(p.blocks, ends, 1).view(np.int64)),
                 _lists(p.anchor[new].view(np.int64), p.block_of[new], m)], schema=schema,
            )

    return docs.select("doc_id", "mark", "raw").mapInArrow(parse, PARSED)


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, mark, at, w1, w2): windows of (doc_id, mark, raw, blocks, anchors) that begin in one of the
    blocks and whose anchor is one of the anchors, with two fingerprints."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for rows, texts in _chunks(batches, "raw"):
            p = Parsed(words, texts, window)
            if not len(p.starts):
                continue
            shared = np.unique(rows.column("anchors").flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
            blocks = rows.column("blocks")
            owner = np.repeat(np.arange(len(texts)), blocks.value_lengths().to_numpy(zero_copy_only=False))
            wanted = blocks.flatten().to_numpy(zero_copy_only=False) + p.offsets[owner]
            good = np.isin(p.blocks, wanted)[p.block_of] & np.isin(p.anchor, shared)
            at, row = p.starts[good], p.text_of[good]
            if len(at):
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column("doc_id").take(pa.array(row)), "mark": rows.column("mark").take(pa.array(row)),
                    "at": pa.array(at - p.offsets[row]), "w1": pa.array(p.prints.of(at, at + window, 0).view(np.int64)),
                    "w2": pa.array(p.prints.of(at, at + window, 1).view(np.int64)),
                })

    return docs.select("doc_id", "mark", "raw", "blocks", "anchors").mapInArrow(parse, "doc_id long, mark long, at long, w1 long, w2 long")


def _without(docs: DataFrame) -> DataFrame:
    """(row's columns, sha) of (doc_id, raw, n_words, n_removed, spans): the digest of the words outside the spans."""

    def hash_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _chunks(batches, "raw"):
            sha = []
            for words, spans in zip(texts, rows.column("spans").to_pylist(), strict=True):
                kept, at = [], 0
                for span in spans:
                    kept += words[at : span["at"]]
                    at = span["ends"]
                sha.append(hashlib.sha256(b" ".join(kept + words[at:])).hexdigest())
            yield pa.RecordBatch.from_pydict(
                {**{c: rows.column(c) for c in ("doc_id", "n_words", "n_removed")}, "kept_sha256": pa.array(sha, pa.string())}
            )

    columns = docs.select("doc_id", "n_words", "n_removed", "raw", "spans")
    return columns.mapInArrow(hash_rest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _removed(spans: DataFrame) -> DataFrame:
    """(doc_id, mark, n_removed, spans) of spans (doc_id, mark, at, ends) that may overlap; those that touch are
    made one. A text's spans are ordered, not gathered."""
    one = spans.groupBy("doc_id", "mark", "at").agg(F.max("ends").alias("ends"))
    ordered = Window.partitionBy("doc_id", "mark").orderBy("at")
    before = F.max("ends").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("at") > F.col("before"), F.lit(True))
    island = F.sum(F.col("opens").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = one.withColumn("before", before).withColumn("opens", opens).withColumn("island", island)
    whole = marked.groupBy("doc_id", "mark", "island").agg(F.min("at").alias("at"), F.max("ends").alias("ends"))
    return whole.groupBy("doc_id", "mark").agg(
        F.sum(F.col("ends") - F.col("at")).alias("n_removed"), F.array_sort(F.collect_list(F.struct("at", "ends"))).alias("spans")
    )


def repeats(docs: DataFrame, found: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, n_removed, spans): what is to go of the texts (doc_id, mark, raw) that `parsed` gave `found` for;
    and the rows of all texts that may lose a part, which are the only ones still needed with their words.

    1. Blocks. All windows that begin in a block lie in its words, so where these also stand in an earlier
       text, one row says that all of them go. The rest are blocks that stand nowhere earlier; the first text that
       holds a window holds it in such a block.
    2. Anchors of these blocks. A window that stands in two texts has one anchor in both, so windows whose anchor
       is in one text alone are done. Nearly all of what is no repeat ends here, with a row per anchor.
    3. The other windows are compared by 128 bits of fingerprints of their words; the smallest id that has a window
       decides.

    Smallest ids are aggregates, reduced before they are shuffled, in tables of their own, so the engine may
    split what is joined to them where one block or window is in a third of all texts.
    """
    blocks = found.where("at is not null")
    first = stage(blocks.groupBy("h1", "h2").agg(F.min("doc_id").alias("first")), "first_blocks")
    copied = F.col("first") < F.col("doc_id")
    judged = blocks.join(first, ["h1", "h2"]).select("doc_id", "mark", "at", "ends", F.when(~copied, F.col("anchors")).alias("anchors"))
    judged = stage(judged, "judged_blocks")
    fresh = judged.where("anchors is not null")
    anchors = fresh.select("doc_id", "mark", F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    shared = stage(shared.select("anchor"), "shared_anchors")
    hits = anchors.join(shared, "anchor", "left_semi").groupBy("doc_id", "mark").agg(F.collect_set("anchor").alias("anchors"))
    own = F.collect_set(F.when(F.col("anchors").isNotNull(), F.col("at")))
    texts = judged.groupBy("doc_id", "mark").agg(own.alias("blocks"), F.count_if(F.col("anchors").isNull()).alias("copied"))
    texts = texts.join(hits, ["doc_id", "mark"], "left").where("size(blocks) > 0 and (copied > 0 or anchors is not null)")
    texts = texts.withColumn("anchors", F.coalesce("anchors", F.array().cast("array<bigint>")))
    asked = stage(docs.join(stage(texts.drop("copied"), "asked"), ["doc_id", "mark"]), "asked_texts")
    windows = stage(_windows(asked.where("size(anchors) > 0"), window), "windows")
    recur = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    recur = stage(recur.select("w1", "w2", "first"), "recurring_windows")
    again = windows.join(recur, ["w1", "w2"]).where("first < doc_id").select("doc_id", "mark", "at", (F.col("at") + window).alias("ends"))
    return _removed(again.union(judged.where("anchors is null").select("doc_id", "mark", "at", "ends"))), asked


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of (doc_id, text).

    A word goes if a window of `window` words that covers it begins in a text with a smaller doc_id too; all is
    judged on the texts as given. Names of runs and pairs are hashes, the same in all tasks, so rounds need
    no shuffle; what is shuffled are blocks, anchors, windows that may recur, the texts once to find those that may
    lose a part, and these once more. Equal fingerprints of 128 bits count as equal words.

    Null and empty texts have no words and the digest of nothing. Rows without an id keep all words and take
    none from others; so do texts shorter than a window. Rows that share an id don't take words from each other;
    repeated rows have repeated results. A text is one row and is parsed by one task, in memory that grows
    with it. Other columns are not read. No rows give no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("raw"))
    with scratch(docs.sparkSession) as keep:
        found = stage(parsed(docs, window), "parsed")
        gone, texts = repeats(docs, found, window)
        gone = stage(gone, "removed")
        rows = found.where("at is null").select("doc_id", "mark", "n_words", "sha").join(gone.drop("spans"), ["doc_id", "mark"], "left")
        rows = rows.withColumn("n_removed", F.coalesce("n_removed", F.lit(0).cast("long")))
        part = (F.col("n_removed") > 0) & (F.col("n_removed") < F.col("n_words"))
        sha = F.when(F.col("n_removed") == 0, F.col("sha")).otherwise(NOTHING)
        plain = rows.where(~part).select("doc_id", "n_words", "n_removed", sha.alias("kept_sha256"))
        cut = rows.where(part).select("doc_id", "mark", "n_words").distinct().join(gone, ["doc_id", "mark"])
        rest = _without(texts.drop("blocks", "anchors").join(stage(cut, "cut"), ["doc_id", "mark"]))
        return keep(plain.union(rest).withColumn("doc_id", F.col("doc_id").cast(kind)), "without_repeats")


def op11_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
