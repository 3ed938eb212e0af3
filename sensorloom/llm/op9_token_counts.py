"""Token counts of texts by a two-tier lookup on the side of the scan."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import table
from sensorloom.llm.subwords import Cache, encode_segment, load, segments

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Documents of a task whose segments fill the table of frequent ones, and its entries. They bound the
#: broadcast (some 1 MB) and decide speed alone: a segment that is missing is encoded where it is met.
SAMPLE_DOCS, FREQUENT = 2_000, 30_000
#: Segments longer than this are not worth a place in the table.
LONGEST = 32


def frequent_lengths(docs: DataFrame, model_path: str, sample: int = SAMPLE_DOCS, entries: int = FREQUENT) -> dict[str, int]:
    """Lengths in tokens of frequent segments: the most frequent of the first `sample` documents of a
    partition. `take` runs one task and more only while it lacks rows, and no text reaches the driver."""
    if sample <= 0 or entries <= 0:
        return {}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        left = sample
        for frame in frames:
            for text in frame["text"].iloc[: max(0, left)]:
                seen.update(s for s in segments(text) if len(s) <= LONGEST)
            left -= len(frame)
        top = [s for s, _ in seen.most_common(entries)]
        if top:
            yield pd.DataFrame({"segment": top})

    rows = docs.select("text").where("text is not null").mapInPandas(count, "segment string").take(entries)
    model = load(model_path)
    return {r["segment"]: len(encode_segment(model, r["segment"])) for r in rows}


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT, **sizes: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row.

    A broadcast table holds the lengths of frequent segments; a worker keeps those of others in a bounded
    cache and encodes what is in neither. Nothing is shuffled. Null and empty texts have 0 bytes and 0
    tokens; ids may be null or repeated, each row is counted; long texts are counted whole, in one pass
    over their segments; other columns are not read; an empty table gives no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, model_path, **sizes))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Cache(load(model_path), len, known.value)
        for frame in frames:
            texts = [t or "" for t in frame["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"],
                    "n_bytes": [len(t.encode()) for t in texts],
                    "n_tokens": [sum(map(cache.__getitem__, segments(t))) for t in texts],
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = ids.mapInPandas(count, "doc_id string, n_bytes long, n_tokens long")
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
