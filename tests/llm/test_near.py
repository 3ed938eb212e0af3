"""MinHash groups and components against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sensorloom.llm.components import components
from sensorloom.llm.op5_minhash import Near, band_keys, deduplicated, near_duplicates, shingle_hashes, shingle_set, signature, words_of

from .brute import AWKWARD, DOCS, prose, roots, shingles, table


def corpus():
    r = random.Random(4)
    rows, i = [], 0
    for base in range(25):
        words = prose(base, r.choice((6, 30, 120)))
        for _ in range(r.choice((1, 2, 6))):
            copy = list(words)
            for _ in range(r.choice((0, 0, 1, 3))):
                copy[r.randrange(len(copy))] = f"x{r.randrange(1000)}"
            rows.append((i, " ".join(copy).title() if r.random() < 0.3 else " ".join(copy)))
            i += 1
    chain = prose(99, 100)
    for _ in range(40):  # neighbours are similar, ends are not
        rows.append((i, " ".join(chain)))
        chain = [*chain[3:], *prose(i, 3)]
        i += 1
    return rows


@pytest.mark.parametrize("n", [2, 5])
def test_groups_are_those_of_all_pairs(spark, n):
    rows = corpus()
    sets = {i: shingles(t, n) for i, t in rows}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    want = roots(sets, links)
    found = {r.doc_id: r for r in near_duplicates(table(spark, rows), Near(words=n)).collect()}
    assert {i: r.component_id for i, r in found.items()} == want
    assert {i: r.n_shingles for i, r in found.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (i == want[i]) for i, r in found.items())
    assert len(set(want.values())) < len(want)


def test_large_buckets_in_blocks(spark):
    """Copies of one text with so many edits that most are not similar to the original."""
    r = random.Random(3)
    base = prose(1, 148)
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(r.randrange(0, 9)):
            words[r.randrange(148)] = f"e{r.randrange(200)}"
        rows.append((i, " ".join(words)))
    sets = {i: shingles(t, 5) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    found = near_duplicates(table(spark, rows), Near(star_rounds=1, large=10, block=16)).collect()
    assert {x.doc_id: x.component_id for x in found} == want
    assert 10 < len(set(want.values())) < 160


def test_awkward_rows(spark):
    found = near_duplicates(table(spark, AWKWARD)).collect()
    assert len(found) == len(AWKWARD)
    by_id = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found}
    assert by_id[1] == (0, 1, True) and by_id[2] == (0, 2, True) and by_id[3] == (0, 3, True)
    assert by_id[4] == (1, 4, True) and by_id[5] == (1, 4, False)
    assert by_id[None][1:] == (None, True)
    assert by_id[6][0] == 8


def test_one_of_each_group_stays_with_all_columns(spark):
    docs = table(spark, AWKWARD)
    kept = deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted([(False, i) for i in (1, 2, 3, 4, 6, 7)] + [(True, 0)])
    twice = deduplicated(table(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "z")]))
    assert sorted(r.doc_id for r in twice.collect()) == [1, 2]


def test_rows_of_one_id_or_none_are_documents_of_their_own(spark):
    one, two, three = (" ".join(prose(i, 60)) for i in (1, 2, 3))
    rows = [(1, one), (1, two), (2, one), (None, two), (None, three), (None, three), (None, three + " end"), (None, ""), (None, None), (None, " ")]
    kept = deduplicated(table(spark, rows)).collect()
    assert sorted(r.text for r in kept if r.doc_id == 1) == sorted([one, two])
    rest = [r.text for r in kept if r.doc_id is None]
    assert len(kept) == 6 and sum(bool((t or "").strip()) for t in rest) == 1 and len(rest) == 4


def test_empty_tables(spark):
    assert near_duplicates(table(spark, [])).collect() == []
    assert deduplicated(table(spark, [])).collect() == []


def test_hashes_count_shingles_and_signatures_estimate_similarity():
    a, b = " ".join(prose(1, 3000)), " ".join(prose(1, 2500) + prose(2, 500))
    ha, hb = (shingle_hashes(words_of(t), 2, {}) for t in (a, b))
    assert len(ha) == len(shingle_set(a, 2)) == len(shingles(a, 2))
    x, y = signature(ha, 2048, 1), signature(hb, 2048, 1)
    true = len(np.intersect1d(ha, hb)) / len(np.union1d(ha, hb))
    assert abs((x == y).mean() - true) < 0.05


def test_components_of_stars_chains_and_loops(spark):
    links = [(i, 1000) for i in range(50)] + [(i, i + 1) for i in range(2000, 2070)] + [(7, 7), (None, 3), (1000, 5), (1000, 5)]
    frame = spark.createDataFrame(links, "a long, b long")
    ids = {x for a, b in links if a is not None and a != b for x in (a, b)}
    want = roots(ids, [(a, b) for a, b in links if a is not None])
    assert {r.id: r.component for r in components(frame, "a", "b").collect()} == {i: want[i] for i in ids}
    assert components(frame.limit(0), "a", "b").collect() == []


def test_the_schema_of_the_fixture_has_clashing_names():
    assert " id long" in DOCS


def test_one_shared_key_is_enough_in_small_buckets(spark):
    """Two texts with one word in common, and a third with it that is similar to neither and may stand between them."""
    near = Near(words=1, rows=1, bands=128, percent=1, sketch_bits=128, star_rounds=1)
    rows = []
    for k in range(300):
        for j, n in enumerate((40, 40, 400)):
            rows.append((3 * k + j, " ".join([f"p{k}", *(f"{'abx'[j]}{k}x{m}" for m in range(n - 1))])))
    keys = [set(band_keys(signature(shingle_hashes(words_of(t), 1, {}), 128, near.seed), near).tolist()) for _, t in rows]
    found = {r.doc_id: r.component_id for r in near_duplicates(table(spark, rows), near).collect()}
    shared = [k for k in range(300) if keys[3 * k] & keys[3 * k + 1]]
    assert len(shared) > 150 and all(found[3 * k + 1] == 3 * k for k in shared)
