"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from pathlib import Path

import pytest

from sensorloom.llm import op13_spelling as op13

from .brute import AWKWARD, LOWER, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLDER = Path("/root/testdata/sf0.001")


def within_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counts(rows):
    n = Counter()
    for doc, text, *_ in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def plain(rows):
    n = counts(rows)
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    near = {w: [v for d in (-1, 0, 1) for v in by_size.get(len(w) + d, []) if v != w and within_one(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def got(frame):
    rows = [tuple(r) for r in op13.spelling_variants(frame).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(seed, kinds, edits, letters="abcdefghéÿ"):
    """Words with variants of theirs, and variants of those; frequent ones far more often."""
    r = random.Random(seed)
    stems = ["".join(r.choices(letters, k=r.randint(6, 12))) for _ in range(kinds)]
    words = []
    for s in stems:
        words += [s] * r.choice((2, 30, 400))
        for _ in range(edits):
            i, c = r.randrange(len(s)), r.choice(letters)
            v = r.choice((s[:i] + c + s[i:], s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :]))
            words += [v] * r.choice((1, 2, 3, 25))
            words += [v[:3] + c + v[3:]] * 2
    r.shuffle(words)
    return [(i, r.choice((" ", "\n", "7", "-")).join(words[i::40]), "en", "a") for i in range(40)]


@pytest.mark.parametrize("limit", [op13.PAIRS, 3])
def test_all_pairs(spark, monkeypatch, limit):
    """With a limit of three pairs nearly all keys are split, down to single code points."""
    monkeypatch.setattr(op13, "PAIRS", limit)
    rows = [*made(1, 60, 6), *AWKWARD, *AWKWARD]
    want = plain(rows)
    assert sum(f is not None for _, f, *_ in want) > 20 and any(f not in (None, r) for _, f, r, *_ in want)
    assert got(table(spark, rows)) == want


def test_words_that_share_a_half(spark):
    """A hot chunk: 2,000 words with one first half and 2,000 with one second half."""
    r = random.Random(3)
    words = {"common" + "".join(r.choices("abcdefghij", k=6)) for _ in range(2_000)}
    words |= {"".join(r.choices("abcdefghij", k=6)) + "ending" for _ in range(2_000)}
    words = sorted(words)
    rows = [(i, " ".join(words[i::7] * 2), "en", "a") for i in range(7)]
    assert got(table(spark, rows)) == plain(rows)


def test_given_table(spark):
    if not FOLDER.exists():
        pytest.skip("the given tables are not here")
    frame = spark.read.parquet(str(FOLDER / "documents.parquet"))
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    found = {tuple(r) for r in op13.op13_spelling(spark, str(FOLDER)).collect()}
    assert found == plain(rows) and len(found) > 100


def test_ties_and_edges(spark):
    same = "wordwor"
    rows = [(1, " ".join(["wordworx"] * 40 + ["wordwora"] * 40 + [same] * 2), "en", "a"), (2, "A" * 200_000 + " " + "A" * 200_000, "en", "a")]
    want = plain(rows)
    assert got(table(spark, rows)) == want
    # The smaller of two forms that are as frequent.
    assert {(w, f) for w, f, *_ in want if w == same} == {(same, "wordwora")}
    assert got(table(spark, [])) == set()
    assert got(table(spark, [(1, None, None, None), (None, "", None, None), (2, "short ones 12", None, None)])) == set()
