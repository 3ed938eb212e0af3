"""Removed repeats against sets of all windows, and the parse against its promises."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import numpy as np
import pytest

from sensorloom.llm import op11_recompression as op11
from sensorloom.llm.op11_recompression import Parsed, without_repeats
from sensorloom.llm.parsing import Words, first_level, next_level

from .brute import AWKWARD, WORD, prose, table

FOLDER = Path("/root/testdata/sf0.001")


def plain(rows, size=50):
    first = {}
    texts = [(doc, WORD.findall(text or "")) for doc, text, *_ in rows]
    for doc, words in texts:
        if doc is not None:
            for i in range(len(words) - size + 1):
                w = tuple(words[i : i + size])
                first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, words in texts:
        gone = np.zeros(len(words), bool)
        if doc is not None:
            for i in range(len(words) - size + 1):
                if first[tuple(words[i : i + size])] < doc:
                    gone[i : i + size] = True
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc, len(words), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(frame, **options):
    return sorted((tuple(r) for r in without_repeats(frame, **options).collect()), key=str)


def corpus(seed, n=60, vocabulary=400):
    """Texts with passages of 30 to 400 words that others have too, whole copies, and runs."""
    r = random.Random(seed)
    passages = [prose(seed + 100 + i, r.randint(30, 400), vocabulary) for i in range(12)]
    passages += [["again"] * 130, ["to", "and", "fro"] * 60, ["again"] * 49]
    texts = []
    for i in range(n):
        words = []
        for _ in range(r.randint(0, 4)):
            words += prose(seed * 1_000 + i * 10 + len(words), r.randint(0, 200), vocabulary)
            p = r.choice(passages)
            a, b = sorted((r.randint(0, len(p)), r.randint(0, len(p))))
            words += r.choice((p, p[a:b]))
        texts.append(words)
    for i in range(0, n, 7):  # copies, some with a word changed
        words = list(texts[i])
        if words and i % 2:
            words[len(words) // 2] = "other"
        texts.append(words)
    order = list(range(len(texts)))
    r.shuffle(order)
    return [(order[i], r.choice((" ", "\n", " \t ")).join(w), "en", "a") for i, w in enumerate(texts)]


@pytest.mark.parametrize("seed", range(3))
def test_against_all_windows(spark, seed):
    rows = [*corpus(seed, vocabulary=(400, 8, 4_000)[seed]), *((None if d is None else d + 500, *x) for d, *x in AWKWARD)]
    want = plain(rows)
    assert sum(0 < g < n for _, n, g, _ in want) > 10 and sum(0 < g == n for _, n, g, _ in want) > 3
    assert found(table(spark, rows).repartition(5)) == want


def test_small_windows(spark):
    rows = corpus(9, 30, 20)
    assert found(table(spark, rows), window=5) == plain(rows, 5)
    assert found(table(spark, rows), window=1) == plain(rows, 1)


def test_repeated_ids_nulls_and_hot_passages(spark):
    p = " ".join(prose(1, 80))
    rows = [(i, f"{' '.join(prose(50 + i, 60))} {p} {' '.join(prose(900 + i, 30))}", None, None) for i in range(60)]
    rows += [(7, p, None, None), (7, p, None, None), (7, f"{p} {p}", None, None), (None, p, None, None), (None, p, None, None)]
    rows += [(1_000 + i, p, None, None) for i in range(40)]
    rows += [(2**60 + 1, p, None, None), (2**60 + 2, None, None, None)]
    assert found(table(spark, rows)) == plain(rows)
    assert found(table(spark, [])) == []
    assert found(table(spark, [(1, None, None, None), (None, "", None, None)])) == plain([(1, None), (None, "")])


def test_given_table(spark):
    if not FOLDER.exists():
        pytest.skip("the given tables are not here")
    frame = spark.read.parquet(str(FOLDER / "documents.parquet"))
    got = sorted((tuple(r) for r in op11.op11_recompression(spark, str(FOLDER)).collect()), key=str)
    assert got == plain([(r.doc_id, r.text) for r in frame.collect()])


def test_symbols_depend_on_their_stretch_alone():
    """Equal stretches have a symbol in common wherever they stand: its name and place follow from [low, high)."""
    r = random.Random(5)
    words = [r.choice("abcd") for _ in range(6_000)] + ["e"] * 40 + [r.choice("abcdefgh") for _ in range(2_000)]
    text = [w.encode() for w in words + words[1_000:4_000]]
    known = Words()
    marks = known.look_up(known.places(text))[0]
    marks = np.concatenate([[0], marks, [0]]).astype(np.uint64)
    level = first_level(marks, np.array([0, len(marks) - 1]))
    for number in range(1, 9):
        level = next_level(level, number)
        held = {}
        ends = np.append(level.at[1:], len(marks))
        for name, at, low, high, end, no in zip(level.name, level.at, level.low, level.high, ends, level.separator, strict=True):
            if not no and low > 0 and high < len(marks):
                assert low <= at < end <= high
                key = (tuple(text[low - 1 : high - 1]), at - low)
                assert held.setdefault(key, (name, end - at)) == (name, end - at)
        assert len(level) < len(marks)


def test_anchors_depend_on_the_window_alone():
    rows = corpus(2, 40, 30)
    texts = [WORD.findall(t.decode()) for t in (x[1].encode() for x in rows)]
    texts = [[w.encode() for w in t] for t in texts]
    anchors = {}
    for lot in (texts[:10], texts[10:], texts[5:15][::-1]):
        p = Parsed(Words(), lot, 50)
        for at, row, anchor in zip(p.starts, p.text_of, p.anchor, strict=True):
            at -= p.offsets[row]
            window = tuple(lot[row][at : at + 50])
            assert len(window) == 50 and anchors.setdefault(window, anchor) == anchor
    assert len(set(anchors.values())) < len(anchors) / 3
