"""Token counts, packing and the order of slots."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest

from sensorloom.llm import op2_training_order as op2
from sensorloom.llm.op9_token_counts import token_counts
from sensorloom.llm.subwords import encode_segment, load, segments

from .brute import AWKWARD, table

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return load(PATH)


def test_segments_encode_as_the_text_does(model):
    r = random.Random(8)
    signs = list("ab the\n\t  ▁é\r<s>|{}();  　\xa0😀\x00\x0b\x85 ,.")
    for _ in range(3_000):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 14)))
        assert [i for s in segments(text) for i in encode_segment(model, s)] == model.encode(text)


@pytest.mark.parametrize("sample", [0, 2_000])
def test_counts_are_the_librarys(spark, model, sample):
    found = token_counts(table(spark, AWKWARD), PATH, sample=sample).collect()
    want = sorted((str(i), len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t, *_ in AWKWARD)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in found) == want
    assert token_counts(table(spark, []), PATH).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 65_537])
def test_slots_are_a_permutation(n):
    slots = op2.feistel(np.arange(n), n)
    assert sorted(slots) == list(range(n))
    assert (op2.feistel(slots, n, inverse=True) == np.arange(n)).all()
    if n > 100:
        assert (op2.feistel(np.arange(n), n, key=1) != slots).any()
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.2


def test_shards_hold_every_token_once_and_resume(spark, model, tmp_path):
    rows = [(i, f"text number {i} " * (i % 37)) for i in range(400)] + AWKWARD
    folder = str(tmp_path / "shards")
    index = op2.training_order(table(spark, rows), PATH, folder, length=64, shard=16)
    found = {r.slot: r for r in index.collect()}
    assert sorted(found) == list(range(len(found)))
    read = list(op2.read_slots(folder, 0, 64, 16))
    assert len(read) == len(found)
    for slot in (0, 15, 16, 33):
        assert (next(op2.read_slots(folder, slot, 64, 16)) == read[slot]).all()
        assert (found[slot].shard, found[slot].offset) == (slot // 16, slot % 16 * 128)
    # Back in the order of packing, partitions are the texts end to end.
    order = op2.feistel(np.arange(len(read)), len(read))
    stream = np.concatenate([read[s][: found[s].n_tokens] for s in order]).tolist()
    texts: list[list[int]] = [[]]
    for i in stream:
        texts[-1].append(i) if i != op2.END else texts.append([])
    want = sorted(model.encode(t) for _, t, *_ in rows if t)
    assert texts.pop() == [] and sorted(texts) == want
    assert sum(r.n_tokens for r in found.values()) == len(stream)


def test_no_documents_no_shards(spark, tmp_path):
    assert op2.training_order(table(spark, []), PATH, str(tmp_path / "none")).collect() == []
    assert list(op2.read_slots(str(tmp_path / "none"), 0)) == []


def test_long_ids_next_to_null_ones(spark):
    rows = [(2**60 + 1, "a text with a long id"), (None, "one without an id"), (2**60 + 3, "another"), (2**53 + 1, "a b c " * 50)]
    frame = table(spark, [(*r, None, None) for r in rows]).coalesce(1)
    found = op2.training_order(frame, PATH, length=8).collect()
    assert {r.first_doc for r in found} <= {2**60 + 1, 2**60 + 3, 2**53 + 1}
    assert {2**60 + 1, 2**53 + 1} <= {r.first_doc for r in found}


def test_segments_encoded_together(model):
    from sensorloom.llm.subwords import Cache, packed

    r = random.Random(3)
    texts = ["".join(r.choice("ab the\n\t  ▁é<s>|;😀\x00") for _ in range(r.randint(0, 40))) for _ in range(500)] + ["long" * 500, " " * 90]
    want = [packed(model.encode(t)) for t in texts]
    cache = Cache(model, packed, {" the": packed(model.encode("the"))})
    assert cache.joined([segments(t) for t in texts]) == want == cache.joined([segments(t) for t in texts])
    assert all(len(s) <= 64 for s in cache)


def test_segments_are_cut_in_the_bytes_of_all_texts(model):
    """Packing cuts texts where `segments` does, without a string for each segment."""
    from sensorloom.llm.subwords import Cache, cut, packed

    r = random.Random(4)
    texts = ["".join(r.choice("ab the\n\t  ▁é<s>|;😀\x00\r\u00a0") for _ in range(r.randint(0, 30))) for _ in range(500)]
    texts += ["", "▁", " ", "\n", "a", "", " \n", "\t  x  ", "long" * 500, " " * 90, ""]
    for some in (texts, texts[:1], ["", ""], []):
        pieces, counts = cut(some)
        assert pieces.to_pylist() == [s for t in some for s in segments(t)]
        assert counts.tolist() == [len(segments(t)) for t in some]
        assert Cache(model, packed).encoded(some) == [packed(model.encode(t)) for t in some]
    assert "segments" not in op2.sequences.__code__.co_names and all("segments" not in f.co_names for f in op2.sequences.__code__.co_consts if hasattr(f, "co_names"))


def test_texts_are_taken_a_lot_at_a_time():
    """A worker holds one lot's texts as Python's, not those of a whole batch; rows without text are left out."""
    import pyarrow as pa

    texts = ["abc", None, "", "déf", "x" * 50, "g", "hi"]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(6)] + [None]), pa.array(texts)], names=["doc_id", "text"])
    assert list(op2.lots(batch, 6)) == [(["0", "3"], ["abc", "déf"]), (["4"], ["x" * 50]), (["5", None], ["g", "hi"])]
    assert list(op2.lots(batch.slice(1, 2), 6)) == []
    assert op2.TOGETHER <= 1_000_000
