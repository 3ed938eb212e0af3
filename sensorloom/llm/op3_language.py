"""Language of texts by Bayesian fusion of text, declared markup, address and host."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import scratch, stage, table

#: Character triples are hashed to so many cells.
CELLS = 1 << 15
#: Distinct texts of a declared language that fit the text model, about; a documented bound.
SAMPLE = 6_000
#: Rows with another source of evidence weigh at most as much as so many triples of text.
TEXT_WEIGHT = 60.0
#: Distinct texts of a declared language below which it gets no model.
LEAST_TEXTS = 5
UNKNOWN = "und"
#: Share of a text's triples that may be noise in any language: keys, names, typing errors.
NOISE = 0.1
#: How many rows of its parent a host, or of the corpus a domain, counts for.
PARENT_ROWS = 20.0
KEEP = 0.5


def triples(text: str) -> np.ndarray:
    """Hashed triples of letters of a text in lower case; whatever is no letter is one space."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = (code >= 0xAA) | ((code >= 97) & (code <= 122))
    code = np.where(letter, code, 32).astype(np.uint32)
    code = code[np.r_[True, (code[1:] != 32) | (code[:-1] != 32)]] if len(code) else code
    if len(code) < 3:
        return np.empty(0, np.int64)
    mixed = (code[:-2] * np.uint32(0x9E3779B1) + code[1:-1] * np.uint32(0x85EBCA77) + code[2:] * np.uint32(0xC2B2AE3D))
    return ((mixed ^ (mixed >> np.uint32(15))) % np.uint32(CELLS)).astype(np.int64)


def fit_text_model(rows: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities of triples from some `sample` distinct texts of each declared language
    in the rows (text, declared), chosen by a hash of the text, so that order, partitions and copies don't
    matter. Languages of fewer than LEAST_TEXTS texts are left out.

    Each task sums its rows' triples per language; the driver adds tables whose size does not depend on
    the rows. The last language is the unknown one: every triple is as likely there.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for text, lang in zip(frame["text"], frame["declared"], strict=True):
                cells = triples(text)
                # Every document weighs alike, so one long text is not a language's model.
                sums[lang] = sums.get(lang, 0) + np.bincount(cells, minlength=CELLS) * (1000.0 / max(1000, len(cells)))
        if sums:
            yield pd.DataFrame({"lang": list(sums), "cells": [x.astype(np.float64) for x in sums.values()]})

    labelled = rows.where("text is not null and declared is not null").select("text", "declared")
    hashed = labelled.withColumn("hash", F.xxhash64("text"))
    texts = hashed.select("declared", "hash").distinct().groupBy("declared").count().where(F.col("count") >= LEAST_TEXTS)
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count")) * (1 << 30)
    limits = stage(texts.select("declared", share.cast("long").alias("share")), "language_shares")
    drawn = hashed.join(limits, "declared").where(F.pmod("hash", F.lit(1 << 30)) < F.col("share"))
    seen = drawn.select("declared", "text").distinct().repartition(4)
    parts = seen.mapInPandas(count, "lang string, cells array<double>").collect()
    total = {}
    for r in parts:
        total[r["lang"]] = total.get(r["lang"], 0) + np.array(r["cells"])
    langs = sorted(total)
    table_ = np.full((len(langs) + 1, CELLS), -np.log(CELLS), np.float32)
    for i, x in enumerate(langs):
        smooth = total[x] + 0.05
        table_[i] = np.log((1 - NOISE) * smooth / smooth.sum() + NOISE / CELLS)
    return [*langs, UNKNOWN], table_


def address_suffix(url: Column) -> Column:
    """The two-letter language part of the path, else the last label of the host."""
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*/([a-zA-Z]{2})(?:[/?#.]|$)", 1)
    host = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#:]*?([^./?#:]+)(?:[:/?#]|$)", 1)
    return F.lower(F.when(path != "", path).otherwise(F.when(host != "", F.concat(F.lit("."), host))))


def host_name(url: Column) -> Column:
    host = F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1)
    return F.lower(F.when(host != "", host))


def domain_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)


def markup_language(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1)
    return F.lower(F.when(found != "", found))


def _with(rows: DataFrame, key: list[str], counts: DataFrame) -> DataFrame:
    """Left join whose null keys meet nothing."""
    return rows.join(counts, key, "left")


def languages(rows: DataFrame, sample: int = SAMPLE, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """(id, lang, confidence, kept, text_lang, n_triples) of rows (id, text, declared, suffix, host).

    Log posterior = text likelihood + log P(declared | language) + log P(suffix | language) + log prior of
    the host. The text likelihood is the mean over all triples of the whole text times their number,
    TEXT_WEIGHT at most, since neighbouring triples are no independent witnesses. The other tables are
    grouped counts over all rows of what the text alone says: of (declared, language), of (suffix,
    language), and of the language per host, smoothed towards its domain, that towards the corpus. A
    host with a third of all rows is summed before it is moved and joined back as rows, not gathered.

    kept: the most likely language is a known one with KEEP or more. Texts without three letters have no
    likelihood and are unknown, as are null ones. Missing declared, suffix or host is no evidence.
    Repeated ids and rows each get their row; ties take the first language in order. No rows, or none
    with a declared language and no model given, give rows of unknown language.
    """
    with scratch(rows.sparkSession) as keep:
        langs, logs = model or fit_text_model(rows.select("text", "declared"), sample)
        shared = rows.sparkSession.sparkContext.broadcast(logs)  # a fixed number of cells per language
        width = len(langs)

        def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            logs = shared.value
            for frame in frames:
                sizes, lls = [], []
                for text in frame["text"]:
                    cells = triples(text or "")
                    sizes.append(len(cells))
                    ll = np.zeros(width)
                    for at in range(0, len(cells), 1 << 16):
                        ll += logs[:, cells[at : at + (1 << 16)]].sum(axis=1, dtype=np.float64)
                    lls.append(ll * (min(len(cells), TEXT_WEIGHT) / max(1, len(cells))))
                yield frame.drop(columns="text").assign(n_triples=sizes, ll=lls)

        fields = rows.select("id", "declared", "suffix", "host", "text")
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields.schema if f.name != "text")
        read_ = fields.mapInPandas(read, kinds + ", n_triples long, ll array<double>")
        top = F.array_position("ll", F.array_max("ll")).cast("int") - 1
        # Of the unknown language, only texts without triples or less likely than chance in all others.
        text_lang = F.when(F.col("n_triples") == 0, F.lit(width - 1)).otherwise(top)
        seen = stage(read_.withColumn("t", text_lang), "text_languages")

        def counts(by: str, name: str, source: DataFrame = seen) -> DataFrame:
            cells = [F.sum((F.col("t") == i).cast("double")) for i in range(width)]
            return source.where(F.col(by).isNotNull()).groupBy(by).agg(F.array(*cells).alias(name))

        per_lang = [float(x or 0) for x in seen.agg(*[F.sum((F.col("t") == i).cast("double")) for i in range(width)]).first()]
        total = sum(per_lang)
        corpus = [(n + 1) / (total + width) for n in per_lang]
        array = lambda values: F.array(*[F.lit(float(v)) for v in values])
        domain = domain_of(F.col("host"))
        out = seen.withColumn("domain", F.when(domain != "", domain).otherwise(F.col("host")))
        hosts = counts("host", "host_n")
        domains = counts("domain", "domain_n", out)
        out = _with(out, ["declared"], counts("declared", "declared_n"))
        out = _with(out, ["suffix"], counts("suffix", "suffix_n"))
        out = _with(_with(out, ["domain"], domains), ["host"], hosts)
        add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        smooth = lambda n, prior: F.when(n.isNull(), prior).otherwise(
            F.zip_with(n, prior, lambda c, p: (c + p * PARENT_ROWS) / (add(n) + PARENT_ROWS))
        )
        prior = smooth(F.col("host_n"), smooth(F.col("domain_n"), array(corpus)))
        # P(value | language) with one row of the value's average spread over the languages.
        given = lambda n: F.when(n.isNull(), array([1.0] * width)).otherwise(
            F.zip_with(n, array(per_lang), lambda c, m: (c + 0.5) / (m + 0.5 * width))
        )
        parts = F.arrays_zip(
            F.col("ll").alias("ll"), prior.alias("p"), given(F.col("declared_n")).alias("d"), given(F.col("suffix_n")).alias("s")
        )
        post = F.transform(parts, lambda x: x["ll"] + F.log(x["p"]) + F.log(x["d"]) + F.log(x["s"]))
        out = out.withColumn("post", post).withColumn("high", F.array_max("post"))
        best = F.array_position("post", F.col("high")).cast("int")
        sure = 1 / add(F.transform("post", lambda x: F.exp(x - F.col("high"))))
        silent = F.col("n_triples") == 0
        lang = F.when(silent, F.lit(UNKNOWN)).otherwise(F.element_at(F.array(*map(F.lit, langs)), best))
        named = F.element_at(F.array(*map(F.lit, langs)), F.col("t") + 1)
        out = out.select("id", lang.alias("lang"), F.when(silent, 0.0).otherwise(sure).alias("confidence"), named.alias("text_lang"), "n_triples")
        return keep(out.withColumn("kept", (F.col("lang") != UNKNOWN) & (F.col("confidence") >= KEEP)), "languages")


def document_rows(docs: DataFrame, wanted: Sequence[str] = ()) -> DataFrame:
    """Documents as rows of evidence: `lang` is what their markup declared, `source` their host."""
    lang = F.lower(F.col("lang"))
    return docs.select(
        F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), F.when(lang != "", lang).alias("declared"),
        F.lit(None).cast("string").alias("suffix"), F.col("source").cast("string").alias("host"),
    )


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as rows of evidence; their text is what stands outside tags, scripts and styles."""
    bare = F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    return pages.select(
        F.col("page_id").alias("id"), bare.alias("text"), markup_language(F.col("html")).alias("declared"),
        address_suffix(F.col("url")).alias("suffix"), host_name(F.col("url")).alias("host"),
    )


def identified(docs: DataFrame, **options) -> DataFrame:
    """The documents whose language is known with enough confidence; columns unchanged.

    Each row is judged by itself, whatever its doc_id: rows are told apart by their id and all evidence.
    """
    # Null fields are left out of the JSON, so a null is no value of its own and differs from every other.
    key = F.to_json(F.struct("doc_id", "lang", "source", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("text")))
    keyed = docs.withColumn("__key", key)
    rows = document_rows(keyed.withColumn("doc_id", F.col("__key")))
    out = stage(languages(rows, **options).where("not kept").select(F.col("id").alias("__key")).distinct(), "rejected")
    return keyed.join(out, "__key", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = languages(document_rows(table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("id", "doc_id")


def op3_language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator where all four kinds of evidence are at hand."""
    found = languages(page_rows(table(spark, sf_dir, "pages")))
    return found.withColumnRenamed("id", "page_id")
