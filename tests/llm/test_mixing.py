"""Targets and copies of sources."""

from __future__ import annotations

import pytest

from sensorloom.llm import op8_mixing as op8

from .brute import AWKWARD, WORD, table


def model(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        level = (total - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in rest) if rest else 0
        above = {s for s in rest if level * weight[s] > 2 * sizes[s]}
        if not above:
            return {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in order}
        full |= above


def test_targets_and_takes(spark):
    rows = [(i, "word " * (i % 9), None, f"s{i % 5}" if i % 11 else None) for i in range(3_000)] + [(i, "big " * 50, None, "s1") for i in range(3_000, 4_500)]
    found = op8.rated(table(spark, rows)).select("doc_id", "text", "source", "mix.*").collect()
    sizes: dict = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t))
    want = model(sizes)
    assert {r.source: r.target for r in found} == pytest.approx(want)
    assert all(r.source_size == sizes[r.source] and r.size == len(WORD.findall(r.text)) and 0 <= r.copies <= 2 for r in found)
    for s in sizes:
        assert sum(r.copies * r.size for r in found if r.source == s) == pytest.approx(want[s], rel=0.1)
    again = op8.rated(table(spark, rows)).select("doc_id", "mix.copies").collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in found)


def test_rows_alike_draw_on_their_own(spark):
    """Null ids, repeated ids and equal rows: the words taken still come near the target."""
    rows = [(None, f"text {i} of a row without an id", None, "a") for i in range(400)]
    rows += [(None, "the same text in all of these rows", None, "b")] * 400 + [(7, f"text {i} of one id", None, "c") for i in range(400)]
    rows += [(i, "some other words of a long source " * 3, None, "d") for i in range(300)]
    frame = table(spark, rows).repartition(4)
    frame.persist()
    found = op8.rated(frame).select("source", "mix.*").collect()
    for source in "abcd":
        mine = [r for r in found if r.source == source]
        assert sum(r.copies * r.size for r in mine) == pytest.approx(mine[0].target, rel=0.12)
    frame.unpersist()


def test_awkward_rows(spark):
    docs = table(spark, AWKWARD)
    mixed = op8.mix(docs)
    assert mixed.columns == docs.columns
    rated = op8.rated(docs).select("doc_id", "text", "mix.*").collect()
    assert len(rated) == len(AWKWARD)
    assert mixed.count() == sum(r.copies for r in rated)
    assert op8.mix(table(spark, [])).collect() == []
    assert op8.rated(table(spark, [(1, None, None, "a")])).first()["mix"].target == 0.0
