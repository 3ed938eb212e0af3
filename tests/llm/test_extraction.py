"""Main text of pages in layouts the trees have not seen."""

from __future__ import annotations

import numpy as np
import pytest

from sensorloom.llm import op1_extraction as op1
from sensorloom.llm.dom import flatten, measured, node_text, parse

SCHEMA = "page_id long, url string, html string, text string, n_chars int, label int"

P = "It was a long day in the north of the country, and people came to see what had become of the old bridge."
ARTICLE = f"<h1>The bridge</h1><p>{P}</p><p>{P} {P}</p><p>{P}</p>"
TEXT = f"The bridge {P} {P} {P} {P}"
MENU = "".join(f'<li><a href="/{i}">Topic {i}</a></li>' for i in range(6))
LAYOUTS = {
    "semantic": f"<body><nav><ul>{MENU}</ul></nav><article>{ARTICLE}</article><footer>&copy; Paper</footer></body>",
    "divs": f'<body><div id="menu"><ul>{MENU}</ul></div><div class="post-content">{ARTICLE}</div><div class="sidebar"><h3>More</h3><ul>{MENU}</ul></div></body>',
    "comments": f'<body><main>{ARTICLE}</main><div class="comments"><h2>2 comments</h2><div class="comment"><p>{P}</p></div><div class="comment"><p>No, no.</p></div></div></body>',
    "noise": f'<body><div class="cookie-notice">We use cookies, please agree. <button>OK</button></div><div class="ad">Buy this now!</div><article>{ARTICLE}</article><form><label>Mail</label><input><button>Join</button></form></body>',
    "hidden": f"<head><title>x</title><style>p{{}}</style></head><body><script>var p='</p>'</script><!-- no --><article>{ARTICLE}</article></body>",
}


@pytest.fixture(scope="module")
def model():
    return op1.trained()


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts(model, name):
    assert op1.main_texts(model, [LAYOUTS[name]]) == [TEXT]


def test_layouts_of_other_seeds(model):
    wrong = total = 0
    for i in range(150):
        nodes = flatten(parse(op1._Writer(7_000_000 + i).page()))
        x, parent = measured(nodes)
        keep, truth = op1.decoded(model.log_odds(np.array(x)), parent), op1._truth(nodes)
        leaves = [j for j, n in enumerate(nodes) if n.tag == "#text"]
        wrong += sum(bool(keep[j]) != bool(truth[j]) for j in leaves)
        total += len(leaves)
        for j in range(1, len(nodes)):
            assert not keep[j] or keep[parent[j]]
    assert wrong / total < 0.03


def test_decoding_is_the_best_of_all_labellings():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(2, 9))
        parent = [-1, *[int(rng.integers(0, i)) for i in range(1, n)]]
        odds = rng.normal(size=n) * 2
        best, choice = -np.inf, None
        for bits in range(1 << n):
            keep = [bool(bits >> i & 1) for i in range(n)]
            if any(keep[i] and not keep[parent[i]] for i in range(1, n)):
                continue
            # Below a dropped node nothing is left to chance.
            score = sum(-np.logaddexp(0, -odds[i] if keep[i] else odds[i]) for i in range(n) if i == 0 or keep[parent[i]])
            if score > best:
                best, choice = score, keep
        assert op1.decoded(odds, parent).tolist() == choice


def test_text_of_blocks():
    nodes = flatten(parse("<p>a<b>b</b>\n c&amp;d<br>e<p>f<ul><li>g<li>h</ul>i &eacute;&#33; <em>j</em>"))
    assert [node_text(n) for n in nodes if n.tag == "#text"] == ["ab c&d e", "f", "g", "h", "i é! j"]
    deep = flatten(parse("<div>" * 5_000 + "x"))
    assert len(deep) == 5_002


def test_awkward_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", LAYOUTS["semantic"]), (4, "u", "<p"), (5, "u", "<div><div></div>"), (5, "u", "<div><div></div>"), (6, "u", ARTICLE * 200)]
    frame = spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], SCHEMA)
    found = op1.extracted(frame).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    by_id = {r.page_id: r for r in found}
    assert by_id[None].text == TEXT and {by_id[i].text for i in (1, 2, 5)} == {""}
    assert op1.extracted(frame.limit(0)).collect() == []


def test_the_largest_sibling_may_stand_behind_many_others():
    page = "<body>" + "<div><p>x</p></div>" * 60 + f"<div><p>{TEXT * 20}</p></div></body>"
    nodes = flatten(parse(page))
    features, parent = measured(nodes)
    blocks = [i for i, x in enumerate(nodes) if x.tag == "div"]
    assert len(blocks) == 61 and {parent[i] for i in blocks} == {parent[blocks[0]]}
    assert len({features[i][-3] for i in blocks}) == 1 and features[blocks[0]][-3] == features[blocks[-1]][-27]


@pytest.mark.parametrize("name", ["math", "svg", "object", "canvas", "audio", "video", "noscript"])
def test_text_of_such_elements_stays(model, name):
    page = f"<body><nav><ul>{MENU}</ul></nav><article><h1>The bridge</h1><p>{P}</p><p>Let <{name}>x</{name}> be. {P}</p><p>{P}</p></article></body>"
    assert op1.main_texts(model, [page]) == [f"The bridge {P} Let x be. {P} {P}"]


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 50_000 + "<p>end", "<b>" * 350_000 + "end", "<b>x<div>" + "<i>" * 30_000 + "</b>" * 30_000, "<p>" + "<span>" * 100_000 + "</p>" * 50_000,
        "<ul>" + "<li><p>x" * 60_000, "<table>" + "<tr><td>x" * 50_000, "</x>" * 200_000 + "<b></b>" * 100_000, "<div class='a menu content'>" * 20_000,
    ],
)
def test_deep_and_unclosed_pages(page):
    import resource
    import time

    begun, before = time.process_time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    x, parent = measured(flatten(parse(page)))
    op1.decoded(np.zeros(len(x)), parent)
    assert time.process_time() - begun < 10
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # kB
