"""Languages from text, markup, addresses and hosts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.llm import op3_language as op3

from .brute import AWKWARD, table

EN = "the house of the king and the river of the north with all its stones and bridges that were there"
DE = "das haus des königs und der fluss im norden mit allen seinen steinen und brücken die dort waren"


def docs():
    rows = [(i, (EN if i % 2 else DE) + f" {i}", "en" if i % 2 else "de", f"h{i % 3}") for i in range(60)]
    return rows


def test_text_decides_against_a_wrong_declaration(spark):
    rows = [*docs(), (100, DE, "en", "h1"), (101, "%%% 123 ###", "en", "h0"), (102, EN, None, None)]
    found = {r.doc_id: r for r in op3.languages(op3.document_rows(table(spark, rows))).withColumnRenamed("id", "doc_id").collect()}
    assert found[100].lang == "de" and found[102].lang == "en"
    assert found[101].lang == op3.UNKNOWN and not found[101].kept
    assert all(found[i].lang == ("en" if i % 2 else "de") and found[i].kept for i in range(60))


FR = "la maison du roi et le fleuve dans le nord avec toutes ses pierres et tous les ponts qui furent là"


def test_a_rare_language_gets_a_model(spark):
    """Eight French texts of 1,300 rows, 400 of which are copies of one text."""
    rows = [(i, f"{EN if i % 2 else DE} {i}", "en" if i % 2 else "de", None) for i in range(892)]
    rows += [(1_000 + i, EN, "en", None) for i in range(400)] + [(2_000 + i, f"{FR} {'abcdefgh'[i]}", "fr", None) for i in range(8)]
    found = {r.id: r for r in op3.languages(op3.document_rows(table(spark, rows))).collect()}
    assert all(found[2_000 + i].lang == "fr" and found[2_000 + i].kept for i in range(8))
    langs, logs = op3.fit_text_model(op3.document_rows(table(spark, rows)).select("text", "declared"))
    once = op3.fit_text_model(op3.document_rows(table(spark, [*rows[:893], *rows[-8:]])).select("text", "declared"))
    assert langs == ["de", "en", "fr", op3.UNKNOWN] and (logs == once[1]).all()


def test_priors_decide_where_text_is_thin(spark):
    rows = op3.document_rows(table(spark, docs())).withColumn("host", F.when(F.col("declared") == "de", "a.example.de").otherwise("a.example.com"))
    thin = spark.createDataFrame([(200, "ein an", None, None, "a.example.de"), (201, "ein an", None, None, "b.example.de")], rows.schema)
    found = {r.id: r for r in op3.languages(rows.unionByName(thin)).collect()}
    assert found[200].lang == found[201].lang == "de"


def test_addresses_and_markup(spark):
    urls = [
        ("http://a.b.example.com/fr/1?x", "fr", "a.b.example.com"), ("https://x.de", ".de", "x.de"), ("http://x.co:80/english/", ".co", "x.co"),
        ("nonsense", None, None), (None, None, None),
    ]
    frame = spark.createDataFrame(urls, "url string, suffix string, host string")
    for r in frame.select("*", op3.address_suffix(F.col("url")).alias("s"), op3.host_name(F.col("url")).alias("h")).collect():
        assert (r.s, r.h) == (r.suffix, r.host)
    html = spark.createDataFrame([("<html class=x lang='DE-at'>", "de"), ("<p lang=fr>", None), (None, None)], "html string, want string")
    assert all(r.found == r.want for r in html.select("want", op3.markup_language(F.col("html")).alias("found")).collect())


def test_declared_language_behind_a_long_preamble(spark):
    late = [("<!-- " + "licence " * 5_000 + "--><html lang=nl>", "nl"), ("<html " + "data-x=1 " * 400 + "lang='fr'>", "fr"), (" " * 9_000 + "<p>", None)]
    html = spark.createDataFrame(late, "html string, want string")
    assert all(r.found == r.want for r in html.select("want", op3.markup_language(F.col("html")).alias("found")).collect())


def test_a_rejected_row_takes_no_other_of_its_id_along(spark):
    rows = [*docs(), (None, None, "en", "h0"), (None, "%%% 1", None, None), (None, f"{EN} x", "en", "h1"), (7, "### 2", "de", "h1")]
    kept = op3.identified(table(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, i) for i in range(60)] + [(True, 0)]
    assert all(r.text.startswith((EN, DE)) for r in kept)


def test_awkward_rows(spark):
    frame = table(spark, [*docs(), *AWKWARD])
    found = op3.languages(op3.document_rows(frame)).collect()
    assert len(found) == 60 + len(AWKWARD)
    assert [r.kept for r in found if r.n_triples == 0] == [False] * 3
    kept = op3.identified(frame)
    assert kept.columns == frame.columns and kept.count() >= 60
    assert op3.languages(op3.document_rows(table(spark, []))).collect() == []
    alone = op3.languages(op3.document_rows(table(spark, [(1, "some text", None, None)]))).collect()
    assert [r.lang for r in alone] == [op3.UNKNOWN]
