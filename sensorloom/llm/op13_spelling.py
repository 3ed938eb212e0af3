"""Spelling variants: asymmetric chunks and positional grams of words, joined, verified and rooted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import lower_ascii, scratch, stage, table

#: Code points of a word at least, its occurrences at least, and how much more frequent its form is.
LETTERS, OCCURRENCES, RATIO = 7, 2, 10
#: Runs whose checksum this number divides lose a code point.
NOISE = 31
#: A key with more candidate pairs than this is split by chunks of what the key leaves over.
PAIRS = 4_096


def word_counts(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of whole texts. Runs shorter than a word are passed over by the pattern itself: the first
    match that is long enough begins where its run begins, and takes the run whole."""
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit("[A-Za-z\\u00C0-\\u00FF]{%d,}" % letters), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    each = each.select("doc", lower_ascii(F.col("run")).alias("run"))
    each = each.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = each.select(F.when(F.col("h") % NOISE == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.length("word") >= letters) & (F.col("n") >= occurrences))


def _split(rows: DataFrame) -> DataFrame:
    """Two entries for each: one by each half of the rest of the shorter word, of m code points. In the
    longer word, whose rest has m + longer, the second half is shifted by `longer`."""
    half = F.floor(F.col("m") / 2).cast("int")
    shift = F.when(F.col("side") == "gram", F.col("longer")).otherwise(0)
    first, behind = F.substring("rest", F.lit(1), half), F.substring("rest", half + 1, F.length("rest"))
    second, before = F.substring("rest", half + shift + 1, F.length("rest")), F.substring("rest", F.lit(1), half + shift)
    entry = lambda name, chunk, rest, m: F.struct(
        F.xxhash64("key", "longer", "m", F.lit(name), chunk).alias("key"), rest.alias("rest"), m.alias("m")
    )
    both = F.array(entry("first", first, behind, F.col("m") - half), entry("second", second, before, half))
    return rows.select("side", "word", "n", "longer", F.explode(both).alias("e")).select("side", "word", "n", "longer", "e.key", "e.rest", "e.m")


def near_words(words: DataFrame) -> DataFrame:
    """(a, an, b, bn): every two different words of (word, n) with one inserted, deleted or replaced code
    point between them, once.

    A word gives two disjoint chunks, its halves, once for words of its own length and once for those longer
    by one. The other word gives its grams of the lengths of such chunks, with their positions. An edit
    leaves one chunk whole, shifted by one at most. Of the grams within shift one those are needed that leave
    the ends of both words aligned: the first chunk unshifted, the second shifted by the difference of
    lengths; where the first chunk is shifted, the edit lies before it, and the second is whole and shifted
    too. Lengths, chunk and gram make one key, so all is one equal join. What remains of two words beside
    the chunk differs by one edit as well, so keys with very many pairs are split by chunks of it, as often
    as needed, until one code point is left. Keys only make candidates; all are verified.
    """
    n = F.length("word")
    sides = F.array(
        F.struct(F.lit("both").alias("side"), F.lit(0).alias("longer"), n.alias("m")),
        F.struct(F.lit("chunk").alias("side"), F.lit(1).alias("longer"), n.alias("m")),
        F.struct(F.lit("gram").alias("side"), F.lit(1).alias("longer"), (n - 1).alias("m")),
    )
    rows = words.select("word", "n", F.explode(sides).alias("s")).select("s.*", "word", "n", F.col("word").alias("rest"), F.lit(0).cast("long").alias("key"))
    found = None
    while True:
        rows = stage(_split(rows), "entries")
        sizes = rows.groupBy("key").agg(
            F.count_if(F.col("side") != "gram").alias("c"), F.count_if(F.col("side") != "chunk").alias("g"), F.count("*").alias("all")
        )
        met = rows.join(sizes.where("c > 0 and g > 0 and all > 1").select("key", (F.col("c") * F.col("g")).alias("pairs")), "key")
        met = stage(met, "entries_that_meet")
        large = (F.col("pairs") > PAIRS) & (F.col("m") > 1)
        small = met.where(~large)
        left = small.where("side <> 'gram'").select("key", F.col("word").alias("a"), F.col("n").alias("an"))
        right = small.where("side <> 'chunk'").select("key", F.col("word").alias("b"), F.col("n").alias("bn"))
        # Words of one length are on both sides: one order of the two is enough.
        ordered = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
        some = left.join(right, "key").where(ordered & (F.levenshtein("a", "b", 1) == 1)).select("a", "an", "b", "bn")
        some = stage(some, "pairs")
        found = some if found is None else found.union(some)
        rows = met.where(large).drop("pairs")
        if rows.isEmpty():
            return found.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last form on the way. A form is `RATIO` times as frequent as its
    word, so ways end and have few steps; each round doubles what is passed of them."""
    known = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = known.join(ahead, "root", "left")
        known = stage(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if known.where("moved").isEmpty():
            return known.select("word", "root")
        known = known.select("word", "root")


def spelling_variants(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of (doc_id, text).

    Words are runs of Latin letters, A-Z in lower case, some of which lose a code point by a checksum of
    document and run. A null doc_id counts as an empty one; null and empty texts have no words, and no
    words give no rows. Repeated rows count again. Counts are reduced before the one shuffle of words, so a
    word that makes up a third of a corpus is a row per task. Ties of forms: the smallest in code-point
    order, which is that of the bytes Spark compares. Other columns are not read.
    """
    with scratch(docs.sparkSession) as keep:
        words = stage(word_counts(docs, letters, occurrences), "words")
        pairs = stage(near_words(words), "near_words")
        turned = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("bn").alias("on")).union(
            pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("an").alias("on"))
        )
        best = turned.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("on")).alias("minus"), "other")).alias("best"))
        enough = -F.col("best.minus") >= ratio * F.col("n")
        judged = words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n"),
        )
        judged = stage(judged, "judged")
        out = judged.join(roots(judged.where("form is not null")), "word", "left")
        return keep(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "spelling_variants")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
