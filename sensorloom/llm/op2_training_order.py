"""Token-id sequences in training order: a keyed permutation of slots, written as fixed-stride shards."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import file_paths, opened, scratch, stage, table, work_folder, written
from sensorloom.llm.subwords import Cache, load, packed, segments

MODEL = "piece_bpe_32k.model"
LENGTH = 2048
#: Slots of a shard; 2 * LENGTH bytes each.
SHARD = 1024
#: Documents of a task whose ids settle the code of sequences on their way. It decides their size alone.
SAMPLE_DOCS = 2_000
#: Characters of the texts whose new segments are encoded together, unless one text has more.
TOGETHER = 1_000_000
KEY = 20_240_229
ROUNDS = 6
END = 2  # the end token's id
PAD = 0


def feistel(slots: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0..n-1. A balanced Feistel network permutes the numbers of the smallest even
    width that holds n; numbers that leave the range walk on along their cycle until they are back in it,
    which is under four steps on average."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)

    def turn(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for r in range(ROUNDS)[:: -1 if inverse else 1]:
            if inverse:
                left, right = right, left
            f = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64(((key + 1) * 0xBF58476D1CE4E5B9 + r * 0x94D049BB133111EB) % 2**64)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            left = left ^ ((f ^ (f >> np.uint64(32))) & mask)
            if not inverse:
                left, right = right, left
        return (left << shift) | right

    out = turn(np.asarray(slots, np.uint64))
    while (far := out >= n).any():
        out[far] = turn(out[far])
    return out.astype(np.int64)


class Code:
    """Ids in one byte if they are frequent, else in two, then deflated: half the size of two-byte ids.

    `order` has all ids by falling frequency. The first byte tells the rank of a frequent id, or the upper
    part of another rank; the lower parts follow behind all first bytes."""

    def __init__(self, order: np.ndarray):
        self.order = np.asarray(order, np.int64)
        self.rank = np.empty(len(order), np.int64)
        self.rank[self.order] = np.arange(len(order))
        self.short = next(n for n in range(255, -1, -1) if n + -(-max(0, len(order) - n) // 256) <= 256)

    def encode(self, raw: bytes) -> bytes:
        rank = self.rank[np.frombuffer(raw, "<u2")]
        far = rank - self.short
        first = np.where(far < 0, rank, self.short + (far >> 8)).astype(np.uint8)
        return zlib.compress(first.tobytes() + (far[far >= 0] & 255).astype(np.uint8).tobytes(), 1)

    def decode(self, data: bytes, n: int) -> bytes:
        data = np.frombuffer(zlib.decompress(data), np.uint8)
        rank, low = data[:n].astype(np.int64), data[n:]
        long = rank >= self.short
        rank[long] = self.short + ((rank[long] - self.short) << 8) + low
        return self.order[rank].astype("<u2").tobytes()


def frequent_order(docs: DataFrame, model_path: str, sample: int = SAMPLE_DOCS) -> np.ndarray:
    """All ids of a model, those frequent in the first documents of one partition first."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(model_path)
        cache, left = Cache(model, packed), sample
        total = np.zeros(model.get_piece_size(), np.int64)
        for frame in frames:
            for text in frame["text"].iloc[: max(0, left)]:
                ids = np.frombuffer(b"".join(map(cache.__getitem__, segments(text))), "<u2")
                total += np.bincount(ids, minlength=len(total))
            left -= len(frame)
        yield pd.DataFrame({"total": [total]})

    rows = docs.select("text").where("text is not null").mapInPandas(count, "total array<long>").take(1)
    total = np.array(rows[0]["total"]) if rows else np.zeros(load(model_path).get_piece_size(), np.int64)
    return np.argsort(-total, kind="stable")


def lots(batch: pa.RecordBatch, together: int = TOGETHER) -> Iterator[tuple[list, list[str]]]:
    """Names and texts of a batch, as many at a time as have `together` characters, but one at least; those
    without text are left out. Only a lot's texts are Python's, the others stay in the batch's own bytes."""
    batch = batch.filter(pc.greater(pc.fill_null(pc.utf8_length(batch.column("text")), 0), 0))
    ends = np.cumsum(pc.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + together, side="right")))
        some = batch.slice(first, last - first)
        yield some.column("doc_id").to_pylist(), some.column("text").to_pylist()
        first = last


def sequences(docs: DataFrame, model_path: str, code: Code, length: int = LENGTH) -> DataFrame:
    """(tokens, n_tokens, first_doc, n_docs): texts with an end token each, laid end to end within a
    partition of the input and cut every `length` tokens; only a partition's last sequence is shorter.

    tokens are encoded ids. Ids of frequent segments come from a bounded cache of the worker.
    Null and empty texts, and null ids, add nothing or no name; repeated rows are repeated.
    """

    columns = ["tokens", "n_tokens", "first_doc", "n_docs"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        cache = Cache(model, packed)
        stride, end = 2 * length, packed([END])
        rows: list[tuple] = []
        rest, names = b"", []

        def flush(part: bytes) -> None:
            rows.append((code.encode(part), len(part) // 2, next((x for x in names if x is not None), None), len(names)))

        def given() -> pa.RecordBatch:
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string(), pa.int64()), strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, names=columns)

        for batch in batches:
            for doc_ids, texts in lots(batch):
                for name, ids in zip(doc_ids, cache.encoded(texts), strict=True):
                    rest += ids + end
                    names.append(name)
                    at = 0
                    while len(rest) - at >= stride:
                        flush(rest[at : at + stride])
                        at += stride
                        names = [name] if len(rest) > at else []
                    rest = rest[at:]
                if rows:
                    yield given()
        if rest:
            flush(rest)
            yield given()

    # Ids go as text: longs with nulls among them would come as floats.
    ids = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = ids.mapInArrow(pack, "tokens binary, n_tokens long, first_doc string, n_docs long")
    return rows.withColumn("first_doc", F.col("first_doc").cast("long"))


def numbered(rows: DataFrame, key: int = KEY) -> tuple[DataFrame, int]:
    """The staged sequences with their slot. Number = sequences of the files before + row in its file,
    read from the files themselves, so no shuffle is needed and every reader finds the same numbers; the
    driver sees a count per file. The slot is the permuted number."""
    rows = stage(rows, "sequences").withColumns({"__file": F.col("_metadata.file_name"), "__row": F.col("_metadata.row_index")})
    counts = sorted((r[0], r[1]) for r in rows.groupBy("__file").count().collect())
    before, n = {}, 0
    for name, size in counts:
        before[name], n = n, n + size
    base = rows.sparkSession.sparkContext.broadcast(before)  # an entry per file

    @F.pandas_udf("long")
    def slot(name: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series(feistel(name.map(base.value).to_numpy(np.int64) + row.to_numpy(np.int64), n, key))

    return rows.withColumn("slot", slot("__file", "__row")).drop("__file", "__row"), n


def write_shards(rows: DataFrame, folder: str, n: int, code: Code, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """Write the sequences in slot order to `folder`/shard-NNNNNNNN.u16 and return where each lies.

    Shards are dealt by range, so a shard is one task's and its slots come in order; slot s begins at byte
    (s % shard) * 2 * length of shard s // shard. A shard is written as a stream and takes its name when it
    is whole: a repeated task writes the same bytes under the same name. To resume, skip the shards that
    are there and seek within the next.
    """
    parts = max(1, min(-(-n // shard), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    per_part = -(-(-(-n // shard)) // parts) * shard if n else 1
    stride = 2 * length

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, file, out = -1, None, None
        try:
            for frame in frames:
                crcs = []
                for s, tokens, size in zip(frame["slot"], frame["tokens"], frame["n_tokens"], strict=True):
                    if s // shard != now:
                        if file:
                            file.__exit__(None, None, None)
                        now = s // shard
                        file = written(f"{folder}/shard-{now:08d}.u16")
                        out = file.__enter__()
                    raw = code.decode(tokens, size) + packed([PAD] * (length - size))
                    out.write(raw)
                    crcs.append(zlib.crc32(raw))
                yield frame.drop(columns="tokens").assign(crc=crcs)
            if file:
                file.__exit__(None, None, None)
                file = None
        except BaseException as error:
            if file:
                try:
                    file.__exit__(type(error), error, None)
                except BaseException:  # the first error is the one to tell
                    pass
            raise

    dealt = rows.withColumn("part", F.expr(f"slot div {per_part}"))
    dealt = dealt.repartitionByRange(parts, "part").sortWithinPartitions("slot")
    placed = dealt.select("slot", "n_tokens", F.col("first_doc").cast("string").alias("first_doc"), "n_docs", "tokens").mapInPandas(
        write, "slot long, n_tokens long, first_doc string, n_docs long, crc long"
    )
    return placed.withColumns({"first_doc": F.col("first_doc").cast("long"), "shard": F.expr(f"slot div {shard}"), "offset": F.expr(f"slot % {shard} * {stride}")})


def read_slots(folder: str, first: int, length: int = LENGTH, shard: int = SHARD) -> Iterator[np.ndarray]:
    """Sequences from a slot on, read one after the other: where a training run resumes."""
    stride = 2 * length
    paths = {p.rpartition("/")[2]: p for p in file_paths(folder)}
    while path := paths.get(f"shard-{first // shard:08d}.u16"):
        with opened(path) as file:
            skip = first % shard * stride
            while skip > 0:
                skip -= len(file.read(min(skip, 1 << 20)))
            while len(raw := file.read(stride)) == stride:
                yield np.frombuffer(raw, "<u2")
                first += 1
        if first % shard:
            return


def training_order(
    docs: DataFrame, model_path: str, folder: str | None = None, length: int = LENGTH, shard: int = SHARD, key: int = KEY
) -> DataFrame:
    """Tokenise, pack, permute and write; (slot, shard, offset, n_tokens, first_doc, n_docs, crc) for every
    sequence. crc is that of the bytes written, padding included. Documents without text add no sequence;
    no documents write no shard and give no rows. Equal input files, split alike, give equal shards.
    """
    folder = folder or work_folder(docs.sparkSession, "shards")
    with scratch(docs.sparkSession) as keep:
        code = Code(frequent_order(docs, model_path))
        rows, n = numbered(sequences(docs, model_path, code, length), key)
        return keep(write_shards(rows, folder, n, code, length, shard), "index")


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return training_order(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
