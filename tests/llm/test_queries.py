"""Registered queries against their SQL, and the pipeline as a whole."""

from __future__ import annotations

from pathlib import Path

import pytest

import corpus_pipeline
from sensorloom.llm import op4_decontamination, op5_minhash
from sensorloom.llm.common import table
from sensorloom.llm.queries import ORACLES, QUERIES

from .brute import shingles

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the given tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = QUERIES[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    relation = connection.sql(ORACLES[name])
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    key = lambda row: [(v is None, str(v)) for v in row]
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    assert found == sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=key)


def test_all_operators_are_registered():
    assert {n for n in range(1, 14) if sum(q.startswith(f"op{n}_") for q in QUERIES) == 1} == set(range(1, 14))


def test_pipeline(spark):
    docs = table(spark, str(FOLDER), "documents")
    columns, frames = docs.columns, []
    for name, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, str(FOLDER))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            docs = docs.cache()
            frames.append({(r.doc_id, r.text) for r in docs.collect()})
    language, near, clean, mixed = frames
    assert mixed <= clean <= near <= language
    sets = {i: shingles(t, 5) for i, t in near}
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            assert not both or 100 * both < 80 * len(sets[a] | sets[b])
    # What went as a near copy has its like among the kept.
    assert all(any(100 * len(shingles(t, 5) & s) >= 50 * len(shingles(t, 5) | s) for s in sets.values()) for i, t in language - near)
    items = [op4_decontamination.benchmark_items(table(spark, str(FOLDER), "benchmark")).count()]
    assert items[0] > 0
    bench = [" ".join(r.text.lower().split()) for r in table(spark, str(FOLDER), "benchmark").collect()]
    held = {i for i, t in near if any(b in " ".join(t.lower().split()) for b in bench)}
    assert held and {i for i, _ in near - clean} == held
    assert docs.count() > 0 and docs.select("slot").distinct().count() == docs.count()


def test_near_settings_of_the_pipeline():
    assert (op5_minhash.Near().words, op5_minhash.Near().percent) == (5, 80)
