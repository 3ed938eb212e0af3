"""Benchmark passages against all windows."""

from __future__ import annotations

from collections import Counter

import pytest

from sensorloom.llm import op4_decontamination as op4

from .brute import AWKWARD, prose, table


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, " ".join(prose(100 + i, n))) for i, n in enumerate((16, 40, 59, 3, 5, 200))] + [(50, None), (51, ""), (1, " ".join(prose(101, 40)))]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_passages_are_found_where_they_stand(spark, items):
    texts = {r.item_id: r.text for r in items.where("text <> ''").collect()}
    edited = texts[5].split()
    edited[20] = "changed"
    rows = [
        (1, " ".join(prose(1, 50)) + "\n" + texts[0].upper() + ". " + " ".join(prose(2, 70))),
        (2, " ".join(prose(3, 300))),
        (3, texts[1]),
        (4, " ".join(prose(4, 9) + edited + prose(5, 9))),
        (5, texts[2] + " x " + texts[2] + " y " + texts[4]),
        (6, " ".join(texts[1].split()[:20])),
        (7, "so: " + texts[3]),
        (None, texts[0]),
        (8, texts[0].replace(" ", ", ")),
    ]
    found = {(r.doc_id, r.item_id): r for r in op4.leaks(table(spark, rows), items).collect()}
    assert set(found) == {(1, 0), (3, 1), (4, 5), (5, 2), (5, 4), (7, 3), (None, 0), (8, 0)}
    assert found[1, 0].start == 50 and found[1, 0].similarity == 1.0 and found[1, 0].window_words == 16
    assert found[5, 2].start == 0
    n = 200 - 4
    assert found[4, 5].similarity == pytest.approx((n - 5) / (n + 5))


def test_similarity_is_that_of_counts(spark):
    item = "a b c d e a b c d e a b c d e a b c d e"
    doc = "z " + item[:-2] + " q"

    def bag(words):
        return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))

    words, y = doc.split(), bag(item.split())
    windows = [bag(words[i : i + 20]) for i in range(len(words) - 19)]
    want = [(x & y).total() / (x | y).total() for x in windows]
    frame = spark.createDataFrame([(1, item)], "item_id long, text string")
    [row] = op4.leaks(table(spark, [(1, doc)]), frame).collect()
    assert row.similarity == pytest.approx(max(want)) and row.start == want.index(max(want))


def test_awkward_rows_and_filter(spark, items):
    rows = [*AWKWARD, (9, "x " + items.where("item_id = 0").first().text), (None, items.where("item_id = 2").first().text)]
    docs = table(spark, rows)
    kept = op4.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == len(AWKWARD)
    assert op4.leaks(docs.limit(0), items).collect() == []
    assert op4.leaks(docs, items.limit(0)).collect() == []
    assert op4.decontaminated(docs, items.limit(0)).count() == len(rows)


def test_blocks_find_all_fingerprints_within_the_radius(spark):
    import random

    r = random.Random(1)
    rows = []
    for _ in range(300):
        mark = r.getrandbits(128)
        other = mark
        for b in r.sample(range(128), op4.RADIUS):
            other ^= 1 << b
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for m in (mark, other) for x in (m >> 64, m & (2**64 - 1))))
    frame = spark.createDataFrame(rows, "a long, b long, c long, d long").selectExpr("named_struct('high', a, 'low', b) x", "named_struct('high', c, 'low', d) y")
    assert frame.where(op4.distance(frame.x, frame.y) != op4.RADIUS).count() == 0
    found = frame.withColumn("p", op4.blocks(frame.x)).withColumn("q", op4.blocks(frame.y, op4.PROBE))
    assert found.where("not arrays_overlap(p, q)").count() == 0
    assert len(found.first().p) == 16 and len(set(found.first().q)) == 16 * 37


def test_fingerprints_choose(spark, items):
    """Windows that hold a shingle of an item and are unlike it are no candidates; edited ones are."""
    import random

    r = random.Random(2)
    texts = {x.item_id: x.text.split() for x in items.where("item_id in (1, 2, 5)").collect()}
    rows, near = [], set()
    for i in range(300):
        item = r.choice(sorted(texts))
        words = list(texts[item])
        if i % 2:
            for _ in range(max(1, len(words) // 45)):
                words[r.randrange(len(words))] = "edited"
            near.add(i)
        else:
            at = r.randrange(len(words) - 5)
            words = prose(5_000 + i, at) + words[at : at + 5] + prose(6_000 + i, len(words) - at - 5)
        rows.append((i, " ".join(words)))
    frame = table(spark, [(*x, None, None) for x in rows])
    cells = frame.select("doc_id", op4.words(frame.text).alias("w")).withColumn("mark", op4.marks(op4.shingles(op4.F.col("w"), op4.F.lit(5))))
    bench = op4.benchmark_items(items).where("size >= 40").selectExpr("size item_size", "mark item_mark")
    pairs = cells.join(bench, op4.F.size("w") == op4.F.col("item_size")).withColumn("far", op4.distance(op4.F.col("mark"), op4.F.col("item_mark")))
    close = {x.doc_id for x in pairs.where(op4.F.col("far") <= op4.RADIUS).collect()}
    assert near <= close and len(close - near) < 8
    assert {x.doc_id for x in op4.leaks(frame, items).collect()} == exact_leaks(rows, {k: " ".join(v) for k, v in texts.items()})


def exact_leaks(rows, texts):
    def bag(words):
        return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))

    out = set()
    for doc, text in rows:
        words = text.split()
        for item in texts.values():
            y, size = bag(item.split()), len(item.split())
            for s in range(max(1, len(words) - size + 1)):
                x = bag(words[s : s + size])
                if (x & y).total() >= 0.8 * (x | y).total():
                    out.add(doc)
    return out


def test_a_benchmark_too_large_to_broadcast(spark, items, monkeypatch):
    texts = [(i, f"before it {x.text} and after") for i, x in enumerate(items.where("text <> ''").collect())] + [(None, None), (None, "none of it")]
    docs = table(spark, [(*x, None, None) for x in texts])
    want = sorted(map(str, op4.leaks(docs, items).collect()))
    monkeypatch.setattr(op4, "BROADCAST_SHINGLES", 0)
    assert sorted(map(str, op4.leaks(docs, items).collect())) == want and want


def test_main_path_has_no_python(spark, items):
    plan = op4.leaks(table(spark, AWKWARD), items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_short_windows_with_ties_are_within_the_radius(spark):
    """Two shingles twice each, and once another in the item: a quarter of all bits differ on average."""
    texts = [(i, " ".join([f"a{i}", f"b{i}"] * 4)) for i in range(100)]
    items = spark.createDataFrame([(i, f"{t} c{i}") for i, t in texts], "item_id long, text string")
    found = op4.leaks(table(spark, texts), items).collect()
    assert sorted((r.doc_id, r.item_id, r.similarity) for r in found) == [(i, i, 0.8) for i in range(100)]
