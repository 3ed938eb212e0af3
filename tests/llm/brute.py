"""Plain models the operators are held against, and small tables."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: doc_id, text, lang, source and columns whose names the operators use inside.
DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, n long, rank long, mix string, size long, key string, part long"
)
AWKWARD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n", None, "b"),
    (4, "one", "en", None),
    (5, "one", "en", "b"),
    (5, "one", "en", "b"),
    (None, "the words of a row without an id stand here in one line", "en", "a"),
    (6, "the words of a long text stand here " * 3_000, "en", "c"),
    (7, "Ünïcode ▁ tokens <s> &amp; \x00 　 end\r\n", "de", ""),
]


def table(spark, rows, schema=DOCS):
    width = len(schema.split(","))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


def shingles(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def roots(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def prose(seed, n, words=400):
    r = random.Random(seed)
    return [f"w{int(words * r.random() ** 2)}" for _ in range(n)]
