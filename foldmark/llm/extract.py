"""Main text of web pages: gradient-boosted trees over DOM blocks and a hierarchical decoding.

Every block (element, or text beside elements) gets features of its subtree (length, text and link density, marks of
sentences, controls), its place (depth, order, siblings of its kind), and the words in class, id and role of itself and
of what holds it. Boosted trees give the log odds that a block holds main text. Decoding is a maximum over the tree
in which a dropped block drops all below it, so an ancestor and a descendant never contradict each other.

The trees are fitted on a bounded sample of pages that mark their article: blocks of it are main, others not. Each
page is also learned in ``VARIANTS`` rebuilt forms, with its parts under other elements and names and with
sidebars, notices, adverts, forms and reader comments made of its own sentences, so that the model knows pages that
are marked up in other ways. A share of these forms has plain elements only, without names or with names that mean nothing, so
that lengths, links and places have to decide.

Edge cases: null or empty html has empty text; broken markup is parsed as far as it goes; long pages are taken
whole; without any page that marks its article all text outside scripts, styles and comments is kept; repeated rows are
each extracted; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import html
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmark.llm.dom import Node, parse

SAMPLE = 160  # pages that the fit may use
SAMPLE_CHARS = 100_000  # longer pages are not used to fit
VARIANTS = 6
BARE = 0.25  # share of the rebuilt pages whose elements and names say nothing
ROUNDS = 80
DEPTH = 5
RATE = 0.25
BINS = 32

#: Words of class, id and role by what they announce.
NAMES = {
    "main": "article content main post entry story body text page prose blog news markdown".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toolbar links sitemap skip".split(),
    "edge": "header footer masthead banner top bottom copyright legal contentinfo logo branding".split(),
    "side": "sidebar side aside related widget rail recommended trending popular tags complementary more teaser".split(),
    "advert": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion partner outbrain taboola".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter paywall warning message".split(),
    "talk": "comment comments reply replies discussion disqus reviews responses respond thread forum".split(),
    "form": "form search login signup register contact input field share social".split(),
}
TAGS = "article main section div p h1 h2 h3 h4 ul ol li dl table tr td blockquote pre figure nav header footer aside form #text".split()
MAIN_TAGS = ("article", "main")
OTHER_TAGS = ("nav", "aside", "footer", "form")
WIDTH = 14 + 2 * len(NAMES) + len(TAGS) + 2


def blocks(root: Node) -> list[Node]:
    """All blocks, each before those below it, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.children))
    return out


def described(nodes: list[Node]) -> np.ndarray:
    """The features of the blocks of one page, in the order of ``blocks``."""
    number = {id(n): i for i, n in enumerate(nodes)}
    n = len(nodes)
    parent = np.array([-1 if x.parent is None else number[id(x.parent)] for x in nodes])
    texts = ["".join(x.pieces) for x in nodes]
    own = np.array([[len(t), x.linked, t.count(".") + t.count(",") + t.count("?") + t.count("!"), 1, x.controls, t.count("|") + t.count("·")] for t, x in zip(texts, nodes)], float)
    total, before = own.copy(), np.concatenate(([0], np.cumsum(own[:, 0])[:-1]))
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
    groups = np.array([[not x.tokens.isdisjoint(w) for w in _SETS] for x in nodes], float)
    above = np.zeros_like(groups)
    inside = np.zeros((n, 2))
    depth, order, alike, kin = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for i, x in enumerate(nodes):
        if i:
            p = parent[i]
            depth[i] = depth[p] + 1
            above[i] = np.maximum(above[p], groups[p])
            inside[i] = inside[p]
        inside[i, 0] = max(inside[i, 0], x.tag in MAIN_TAGS)
        inside[i, 1] = max(inside[i, 1], x.tag in OTHER_TAGS or x.tag == "header")
        kinds: dict[str, int] = {}
        for child in x.children:
            kinds[child.tag] = kinds.get(child.tag, 0) + 1
        for at, child in enumerate(x.children):
            c = number[id(child)]
            order[c], kin[c], alike[c] = at / len(x.children), len(x.children), kinds[child.tag] / len(x.children)
    size, links, marks, count, controls, bars = total.T
    whole = max(size[0], 1.0)
    sibling = size[np.maximum(parent, 0)] / np.maximum(kin, 1)
    plain = np.stack([
        np.log1p(size), size / whole, links / np.maximum(size, 1), marks / np.maximum(size, 1) * 100, np.log1p(size / count), np.log1p(count),
        controls, bars, depth, order, np.log1p(kin), alike, np.log1p(size) - np.log1p(sibling), before / whole,
    ], axis=1)
    tags = np.array([[x.tag == t for t in TAGS] for x in nodes], float)
    return np.concatenate([plain, groups, above, tags, inside], axis=1).astype(np.float32)


_SETS = [frozenset(w) for w in NAMES.values()]


@dataclass
class Forest:
    """Boosted trees of full depth over binned features: per round, features and cuts by level order, and leaves."""

    edges: np.ndarray
    base: float
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def boosted(x: np.ndarray, y: np.ndarray) -> Forest:
    """Second-order boosting of the log loss on histograms."""
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.astype(np.float32)
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1)
    share = np.clip(y.mean(), 0.01, 0.99)
    base = math.log(share / (1 - share))
    logit, width = np.full(len(y), base), x.shape[1]
    inner = 2**DEPTH - 1
    features, cuts, leaves = [], [], []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-logit))
        slope, bend = p - y, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            sums = np.empty((2, width, many, BINS))
            place = (at - first) * BINS
            for f in range(width):
                key = place + binned[:, f]
                sums[0, f] = np.bincount(key, slope, many * BINS).reshape(many, BINS)
                sums[1, f] = np.bincount(key, bend, many * BINS).reshape(many, BINS)
            left = np.cumsum(sums, axis=3)[..., :-1]
            all_ = sums.sum(axis=3, keepdims=True)
            right = all_ - left
            gain = (left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1) - all_[0] ** 2 / (all_[1] + 1)).transpose(1, 0, 2)
            best = gain.reshape(many, -1).argmax(axis=1)
            good = gain.reshape(many, -1).max(axis=1) > 1e-6
            feature[first : first + many] = np.where(good, best // (BINS - 1), 0)
            cut[first : first + many] = np.where(good, edges[best // (BINS - 1), best % (BINS - 1)], np.inf)
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
        leaf = np.bincount(at - inner, -slope, 2**DEPTH) / (np.bincount(at - inner, bend, 2**DEPTH) + 1) * RATE
        logit += leaf[at - inner]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Forest(edges, base, np.array(features), np.array(cuts), np.array(leaves))


def decoded(nodes: list[Node], logit: np.ndarray) -> str:
    """The text of the blocks that are kept when the sum of the log odds of kept blocks is largest."""
    number = {id(n): i for i, n in enumerate(nodes)}
    worth = logit.astype(float).copy()
    for i in range(len(nodes) - 1, 0, -1):
        if worth[i] > 0:
            worth[number[id(nodes[i].parent)]] += worth[i]
    kept = np.zeros(len(nodes), bool)
    out = []
    for i, node in enumerate(nodes):
        kept[i] = not i or (kept[number[id(node.parent)]] and worth[i] > 0)
        if kept[i] and node.pieces:
            out.append(node.text)
    return " ".join(t for t in out if t)


def marked_main(nodes: list[Node]) -> np.ndarray | None:
    """Whether each block holds main text, for pages with an article or main element; None for others."""
    number = {id(n): i for i, n in enumerate(nodes)}
    main, out = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        above = bool(i) and main[number[id(node.parent)]]
        main[i] = (above or node.tag in MAIN_TAGS) and node.tag not in OTHER_TAGS
        out[i] = main[i] and (node.tag != "#text" or bool(node.text))
    if not out.any():
        return None
    for i in range(len(nodes) - 1, 0, -1):
        if out[i]:
            out[number[id(nodes[i].parent)]] = True
    return out


def variant(paragraphs: list[str], others: list[str], draw: random.Random) -> tuple[str, str]:
    """A page in another form and its main text: the paragraphs, among blocks made of the other sentences."""
    bare = draw.random() < BARE
    unknown = {kind: "".join(draw.choice("bdfgklmnprstvz") + draw.choice("aeiou") for _ in range(draw.randint(2, 4))) for kind in NAMES}

    def name(kind: str) -> str:
        key = draw.choice(("class", "id", "class"))
        if bare:
            return f' {key}="{unknown[kind]}"' if draw.random() < 0.5 else ""
        return f' {key}="{draw.choice(NAMES[kind])}{draw.choice(("", "-box", " wide", "_1"))}"' if draw.random() < 0.85 else ""

    def say(most: int = 3) -> str:
        return html.escape(" ".join(draw.choice(others) for _ in range(draw.randint(1, most))))

    def block(tag: str, kind: str, inner: str) -> str:
        tag = "div" if bare and tag not in ("li", "form") else tag
        return f"<{tag}{name(kind)}>{inner}</{tag}>"

    def items(linked: bool = True) -> str:
        each = [" ".join(say(1).split()[:3]) for _ in range(draw.randint(3, 9))]
        return "<ul>" + "".join(f'<li><a href="/{i}">{t}</a></li>' if linked else f"<li>{t}</li>" for i, t in enumerate(each)) + "</ul>"

    def extra() -> str:
        return draw.choice((
            lambda: block("div", "advert", draw.choice((say(), f"<p>{say()}</p>"))),
            lambda: block(draw.choice(("aside", "div")), "side", f"<h3>{say(1)}</h3>" + draw.choice((items(), f"<p>{say()}</p>"))),
            lambda: block("div", "notice", f"<p>{say()}</p><button>{say(1)[:12]}</button>"),
            lambda: block("form", "form", f"<label>{say(1)}</label><input name=q><button>{say(1)[:9]}</button>"),
        ))()

    def talk() -> str:
        each = "".join(block(draw.choice(("div", "li")), "talk", f"<b>{say(1)[:14]}</b><p>{say(4)}</p>") for _ in range(draw.randint(1, 5)))
        if bare:
            return block("div", "talk", f"<h3>{say(1)[:20]}</h3>{each}")
        return f'<{(t := draw.choice(("section", "div")))} {draw.choice(("class", "id"))}="{draw.choice(("comments", "comment-list", "discussion", "replies"))}"><h3>{say(1)[:20]}</h3>{each}</{t}>'

    body = []
    for i, text in enumerate(paragraphs):
        tag = draw.choice(("h1", "h2")) if not i else draw.choices(("p", "blockquote", "li", "h2", "div", "pre"), (80, 4, 4, 4, 5, 3))[0]
        text = html.escape(text)
        body.append(f"<ul><li>{text}</li></ul>" if tag == "li" else f"<{tag}>{text}</{tag}>")
        if i and draw.random() < 0.06:
            body.append(extra())
    holder = draw.choice(("article", "main", "div", "div", "section"))
    holder = "div" if bare else holder
    mark = name("main") if bare or holder in ("article", "main") else f' {draw.choice(("class", "id"))}="{draw.choice(NAMES["main"])}{draw.choice(("", "-content", "-body", " full"))}"'
    page = [block(draw.choice(("nav", "div")), "menu", items())] if draw.random() < 0.9 else []
    page += [block(draw.choice(("header", "div")), "edge", f"<h2>{say(1)[:30]}</h2>" + draw.choice(("", items())))] if draw.random() < 0.6 else []
    page += [extra() for _ in range(draw.randint(0, 2))]
    page.append(f"<{holder}{mark}>{''.join(body)}{talk() if draw.random() < 0.25 else ''}</{holder}>")
    page += [extra() for _ in range(draw.randint(0, 2))] + ([talk()] if draw.random() < 0.5 else [])
    page += [block(draw.choice(("footer", "div")), "edge", draw.choice((say(), items(), f"&copy; {say(1)}")))] if draw.random() < 0.9 else []
    inner = "".join(page)
    if draw.random() < 0.5:
        inner = f'<div id="{draw.choice(("wrapper", "page", "container", "root"))}">{inner}</div>'
    return f"<!DOCTYPE html><html><head><title>{say(1)}</title></head><body>{inner}</body></html>", " ".join(paragraphs)


def _labels(nodes: list[Node], main: str) -> np.ndarray:
    """Blocks whose text is found in order in the main text, and what holds them."""
    number, out, at = {id(n): i for i, n in enumerate(nodes)}, np.zeros(len(nodes), bool), 0
    for i, node in enumerate(nodes):
        text = node.text
        if text and main.startswith(text, at):
            out[i], at = True, min(len(main), at + len(text) + 1)
    for i in range(len(nodes) - 1, 0, -1):
        if out[i]:
            out[number[id(nodes[i].parent)]] = True
    return out


def fitted(pages: list[tuple[str, str]]) -> Forest | None:
    """The forest from (name, html) of sample pages, in the order given."""
    xs, ys = [], []
    for which, (_, page) in enumerate(pages):
        nodes = blocks(parse(page))
        main = marked_main(nodes)
        if main is None:
            continue
        xs.append(described(nodes))
        ys.append(main)
        texts = [n.text for n, m in zip(nodes, main) if m and n.text]
        others = [n.text for n, m in zip(nodes, main) if not m and n.text] + texts[-3:]
        draw = random.Random(which)
        for _ in range(VARIANTS):
            other, text = variant([t for t in texts if len(t) < 4000][:40] or texts[:1], others, draw)
            again = blocks(parse(other))
            xs.append(described(again))
            ys.append(_labels(again, text))
    return boosted(np.concatenate(xs), np.concatenate(ys).astype(float)) if xs else None


def _extract(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest(**shared.value) if shared.value else None
        for frame in frames:
            texts: list[str] = []
            held: list[list[Node]] = []
            wide: list[np.ndarray] = []

            def flush() -> None:
                if held:
                    logit = forest.logits(np.concatenate(wide)) if forest else np.ones(sum(map(len, held)))
                    for nodes, part in zip(held, np.split(logit, np.cumsum([len(h) for h in held])[:-1])):
                        texts.append(decoded(nodes, part))
                    held.clear()
                    wide.clear()

            for page in frame["html"]:
                nodes = blocks(parse(page))
                held.append(nodes)
                if forest:
                    wide.append(described(nodes))
                if sum(map(len, held)) > 20_000:
                    flush()
            flush()
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts})

    return run


def sample_of(pages: DataFrame, most: int = SAMPLE) -> list[tuple[str, str]]:
    """At most ``most`` pages for the fit, by digest of their address."""
    usable = pages.filter(F.length("html").between(1, SAMPLE_CHARS) & F.lower("html").rlike("<(article|main)[ >]"))
    name = F.md5(F.concat_ws("|", F.col("url"), F.col("page_id").cast("string")))
    rows = usable.select(name.alias("name"), "html")
    chosen = F.broadcast(rows.select("name").distinct().orderBy("name").limit(most))  # names only, pages stay where they are
    rows = rows.join(chosen, "name", "left_semi").groupBy("name").agg(F.min("html").alias("html")).collect()
    rows.sort(key=lambda r: r["name"])
    return [(r["name"], r["html"]) for r in rows]


def extracted(pages: DataFrame, most: int = SAMPLE) -> DataFrame:
    """page_id, url, the main text and its length in code points per row of ``pages``."""
    forest = fitted(sample_of(pages, most))
    shared = pages.sparkSession.sparkContext.broadcast(vars(forest) if forest else None)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    out = rows.mapInPandas(_extract(shared), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
