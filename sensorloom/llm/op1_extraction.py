"""Main text of pages: boosted trees over nodes of the page's tree, decoded from the root down."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.boosting import Boosted
from sensorloom.llm.common import table
from sensorloom.llm.dom import MARK, Node, flatten, measured, node_text, parse

#: Pages drawn from the layouts below to fit the trees; a documented bound.
TRAINING_PAGES = 700
SEED = 3


# Layouts. There are no labelled pages, so the trees learn from pages written here, whose blocks are marked
# as kept or not; the mark is no feature. They vary in elements, names, order, length and in how well they
# are closed, and often bear no telling name at all.


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.style = ""  # how the article of the page is written; what is around it is plain
        self.syllables = ["".join(self.r.choice("bcdfghlmnprstvwaeiouéäñ") for _ in range(self.r.randint(1, 3))) for _ in range(60)]

    def word(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.choice((1, 1, 2, 2, 3))))

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high))).capitalize()

    def prose(self, low: int, high: int) -> str:
        left, out = self.r.randint(low, high), []
        while left > 0:
            n = min(left, self.r.randint(1, 18))
            left -= n
            out.append(self.phrase(n, n) + self.r.choice((".", ".", ".", "!", "?", ", " + self.word() + ".")))
        text = " ".join(out)
        if self.style == "signs":
            text = " ".join(w + self.r.choice(("***", "###", "&amp;&amp;&amp;", "%%%", "$$$")) for w in text.split())
        elif self.style == "bars":
            text = " | ".join(text.split())
        elif self.style == "loud":
            text = " ".join(w + "!!" for w in text.upper().split())
        return text

    def tag(self, name: str, names: str, inner: str, keep: int) -> str:
        words = names.split("/")
        label = self.r.choice(words)
        kind = self.r.choice(("class", "class", "id"))
        attrs = f' {kind}="{label}"' if label and self.r.random() < 0.8 else ""
        return f'<{name}{attrs} {MARK}="{keep}">{inner}</{name}>'

    def link(self) -> str:
        return f'<a href="/{self.word()}">{self.phrase(1, 4)}</a>'

    def menu(self) -> str:
        items = "".join(f"<li>{self.link()}</li>" for _ in range(self.r.randint(2, 12)))
        inner = f"<ul>{items}</ul>" if self.r.random() < 0.7 else " | ".join(self.link() for _ in range(self.r.randint(2, 9)))
        return self.tag(self.r.choice(("nav", "nav", "div", "ul")), "menu/nav/navbar/breadcrumbs//main-menu/top-nav", inner, 0)

    def head(self) -> str:
        inner = self.r.choice((f"<h1>{self.phrase(1, 4)}</h1>", f"<div>{self.phrase(1, 5)}</div>", "")) + (self.menu() if self.r.random() < 0.5 else "")
        return self.tag(self.r.choice(("header", "header", "div")), "header/masthead/site-header/top/", inner + f"<p>{self.phrase(2, 9)}</p>", 0)

    def foot(self) -> str:
        text = f"&copy; {self.word()}.com &middot; {self.prose(2, 20)}"
        inner = self.r.choice((text, f"<p>{text}</p>", f"<p>{text}</p>" + self.menu(), "".join(self.link() for _ in range(4)) + text))
        return self.tag(self.r.choice(("footer", "footer", "div")), "footer/site-footer/copyright/bottom/", inner, 0)

    def side(self) -> str:
        blocks = []
        for _ in range(self.r.randint(1, 4)):
            items = "".join(f"<li>{self.link()}</li>" for _ in range(self.r.randint(2, 7)))
            blocks.append(self.r.choice((f"<h3>{self.phrase(1, 4)}</h3><ul>{items}</ul>", f"<p>{self.prose(5, 40)}</p>", f"<div>{self.prose(3, 25)}</div>")))
        return self.tag(self.r.choice(("aside", "aside", "div", "section")), "sidebar/side/widget/related/popular/rail/more-stories", "".join(blocks), 0)

    def advert(self) -> str:
        inner = self.r.choice((self.prose(3, 25), f"<p>{self.prose(3, 25)}</p>", self.link() + " " + self.prose(2, 10)))
        return self.tag(self.r.choice(("div", "div", "aside", "section", "p")), "ad/ads/advert/advertisement/banner/sponsored/promo/ad-slot", inner, 0)

    def notice(self) -> str:
        inner = self.r.choice((self.prose(5, 40), f"<p>{self.prose(5, 40)}</p><button>{self.phrase(1, 2)}</button>"))
        return self.tag(self.r.choice(("div", "div", "section", "aside", "dialog")), "cookie/cookie-notice/consent/notice/popup/gdpr/alert/privacy-banner", inner, 0)

    def form(self) -> str:
        inner = f"<label>{self.phrase(1, 4)}</label><input name=q><select><option>{self.word()}<option>{self.word()}</select><textarea>{self.phrase(1, 5)}</textarea>"
        inner += self.r.choice(("", f"<p>{self.prose(3, 20)}</p>")) + f"<button>{self.word()}</button>"
        return self.tag(self.r.choice(("form", "form", "form", "div")), "search/newsletter/login/subscribe/signup/", inner, 0)

    def talk(self) -> str:
        posts = "".join(
            self.tag(self.r.choice(("div", "li", "article")), "comment/reply/", f"<b>{self.word()}</b><p>{self.prose(3, 70)}</p>", 0)
            for _ in range(self.r.randint(1, 7))
        )
        inner = self.r.choice(("", f"<h3>{self.phrase(1, 3)}</h3>", f"<h2>{self.r.randint(1, 40)} {self.word()}</h2>")) + posts
        return self.tag(self.r.choice(("section", "div", "div", "ol", "aside")), "comments/discussion/commentlist/replies/reader-comments/disqus", inner, 0)

    def body(self) -> tuple[str, str]:
        """Blocks of an article and what they are to be wrapped in."""
        long = self.r.random() < 0.85
        blocks = []
        self.style = self.r.choices(("", "signs", "bars", "loud"), (80, 8, 6, 6))[0]
        if self.r.random() < 0.75:
            title = f"<h1>{self.phrase(1, 10)}</h1>"
            blocks.append(f"<header>{title}</header>" if self.r.random() < 0.12 else title)
        line = self.prose(1, 9) if self.r.random() < 0.15 else None
        many = self.r.choices((6, 14, 40, 90), (30, 45, 15, 10))[0]
        most = self.r.choices((12, 120, 500), (15, 65, 20))[0]
        for _ in range(self.r.randint(1, many) if long else self.r.randint(0, 3)):
            text = self.prose(*((1, most) if long else (1, 12)))
            if line and self.r.random() < 0.7:  # one line again and again
                text = line
            elif self.r.random() < 0.02:
                text = " ".join([self.word()] * self.r.randint(2, 300))
            if self.r.random() < 0.15:
                w = text.split()
                text = " ".join(f'<a href="/x">{x}</a>' if self.r.random() < 0.1 else x for x in w)
            blocks.append(self.r.choices(
                (f"<p>{text}</p>", f"<p><b>{text}<br>", f"<p>{text}", f"<div>{text}</div>", f"<h2>{self.phrase(1, 8)}</h2>", f"<blockquote><p>{text}</p></blockquote>",
                 "<ul>" + "".join(f"<li>{self.prose(1, 20)}</li>" for _ in range(self.r.randint(1, 6))) + "</ul>",
                 f"<table><tr><th>{self.word()}<td>{self.phrase(1, 4)}<tr><th>{self.word()}<td>{self.phrase(1, 9)}</table>",
                 f"<pre>{self.prose(2, 30)}</pre>", f"<figure><img src=x><figcaption>{self.prose(2, 12)}</figcaption></figure>", text + "<br><br>"),
                (60, 8, 6, 4, 6, 3, 4, 2, 1, 2, 4),
            )[0])
            if self.r.random() < 0.05:
                style, self.style = self.style, ""
                blocks.append(self.r.choice((self.advert, self.side, self.form, self.notice))())
                self.style = style
        self.style = ""
        return "".join(blocks), self.r.choice(("article", "article", "article", "main", "div", "div", "div", "section", "td"))

    def page(self) -> str:
        inner, name = self.body()
        names = "content/article/post/entry-content/story/main/post-body//text/page-content"
        main = self.tag(name, names, inner, 1) if name != "td" else f"<table><tr>{self.tag('td', names, inner, 1)}</tr></table>"
        before = [x() for x in (self.head, self.menu, self.advert, self.notice, self.side, self.form) if self.r.random() < 0.45]
        after = [x() for x in (self.side, self.advert, self.talk, self.form, self.notice, self.foot, self.menu) if self.r.random() < 0.45]
        self.r.shuffle(before)
        for wrap in range(self.r.choice((0, 0, 0, 1, 1, 2))):
            near = (before, after)[wrap % 2]
            main = self.tag(self.r.choice(("div", "main", "section")), "wrapper/container/main/page//row", "".join(near[-1:]) + main if near is before else main + "".join(near[:1]), 2)
            del near[-1 if near is before else 0 : None if near is before else 1]
        head = f'<head><meta charset="utf-8"><title>{self.phrase(1, 8)}</title><style>p{{}}</style></head>'
        return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{main}{''.join(after)}</body></html>"


def _truth(nodes: list[Node]) -> list[int]:
    """1 for nodes with main text in or below them. Marks hold for what is below; 2 marks a wrapper."""
    own: dict[int, int] = {}
    for x in nodes:
        inherited = own[id(x.parent)] if x.parent is not None else 2
        own[id(x)] = inherited if x.marked is None or inherited == 0 else int(x.marked)
    keep = {id(x): int(own[id(x)] == 1) for x in nodes}
    for x in reversed(nodes):
        if own[id(x)] == 2:
            keep[id(x)] = int(any(keep[id(c)] for c in x.children))
    return [keep[id(x)] for x in nodes]


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> Boosted:
    """The trees, fitted to pages of the layouts; the same for equal arguments.

    They learn from nodes whose parent is kept: what they give is the odds of a node under a kept parent,
    since under a dropped one there is nothing to decide."""
    xs, ys = [], []
    for i in range(pages):
        nodes = flatten(parse(_Writer(seed * 100_003 + i).page()))
        features, parent = measured(nodes)
        truth = _truth(nodes)
        for x, y, p in zip(features, truth, parent, strict=True):
            if p < 0 or truth[p]:
                xs.append(x)
                ys.append(y)
    return Boosted().fit(np.array(xs), np.array(ys, np.float64))


def decoded(odds: np.ndarray, parent: list[int]) -> np.ndarray:
    """The most likely labelling in which nothing below a dropped node is kept.

    odds are those of a node to be kept if its parent is. From the leaves up, a node has the best score of
    its subtree if it is kept, where each child is better kept or dropped, and its own score alone if it is
    dropped, which settles all below; from the root down, the better one is taken."""
    n = len(odds)
    kept, dropped = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    for i in range(n - 1, 0, -1):
        kept[parent[i]] += max(kept[i], dropped[i])
    out = np.zeros(n, bool)
    for i in range(n):
        out[i] = (i == 0 or out[parent[i]]) and kept[i] > dropped[i]
    return out


def main_texts(model: Boosted, pages: list[str]) -> list[str]:
    trees = [flatten(parse(p)) for p in pages]
    rows = [measured(t) for t in trees]
    odds = model.log_odds(np.array([f for x, _ in rows for f in x])) if rows else np.empty(0)
    out, at = [], 0
    for nodes, (x, parent) in zip(trees, rows, strict=True):
        keep = decoded(odds[at : at + len(x)].copy(), parent)
        at += len(x)
        out.append(" ".join(t for node, k in zip(nodes, keep, strict=True) if k and node.tag == "#text" and (t := node_text(node))))
    return out


def extracted(pages: DataFrame, training_pages: int = TRAINING_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html).

    A page is a tree of blocks with runs of text as leaves. Boosted trees give each node the odds that it
    holds main text, from its element and those above, words in its attributes, the text, links and
    punctuation of its subtree, depth and siblings; labels are then chosen for the tree as a whole, so that
    no text is kept below a block that is dropped. Text of kept runs is joined in page order.

    Null and empty pages, and pages without text, give an empty text. A page without markup is one run and
    judged like any other. Pages are taken whole; deep nesting and unclosed elements are fine. Repeated rows
    and null ids each get a row; other columns are not read; no rows give no rows.
    """
    model = pages.sparkSession.sparkContext.broadcast(trained(training_pages))  # some 100 kB

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts: list[str] = []
            for at in range(0, len(frame), 64):
                texts += main_texts(model.value, [h or "" for h in frame["html"].iloc[at : at + 64]])
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = rows.mapInPandas(extract, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast(kind))


def op1_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
