"""Main text by a tree-structured graphical model over the DOM.

Each block element is a binary variable: content or not.  Its own evidence (tag, names, amount of
text, links, sentence ends) is a log-linear potential; parent and child are tied by a 2x2 potential.
Sum-product messages go up and then down the tree, for all pages of a batch at once level by level,
and give each element's exact marginal.  The potentials are trained from labelled pages.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtools import byte_slices, in_small_batches, trimmed
from .dom import BLOCKS, NAMES, Page

WORD_BINS = np.array([1, 4, 11, 31, 81])
SHARE_BINS = np.array([0.01, 0.3, 0.7])
N_TAGS, N_NAMES = len(BLOCKS), len(NAMES) + 1
#: Where each kind of feature begins: tag, parent's tag, names, own words, links of the subtree, sentence ends, first level.
OFFSETS = np.cumsum([0, N_TAGS, N_TAGS + 1, N_NAMES, len(WORD_BINS) + 1, len(SHARE_BINS) + 2, 3])
N_FEATURES = int(OFFSETS[-1]) + 1


class Forest:
    """The elements of many pages, with their levels and features."""

    def __init__(self, pages: list[Page]):
        size = np.array([len(p.tag) for p in pages], np.int64)
        self.first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        shift = np.repeat(self.first[:-1], size)

        def flat(name: str) -> np.ndarray:
            return np.fromiter(itertools.chain.from_iterable(getattr(p, name) for p in pages), np.int64, self.first[-1])

        parent = flat("parent")
        self.parent = np.where(parent < 0, -1, parent + shift)
        self.tag, self.names = flat("tag"), flat("names")
        self.words, self.links, self.stops = flat("words"), flat("links"), flat("stops")
        level = flat("level")
        order = np.argsort(level, kind="stable")
        cut = np.flatnonzero(np.diff(level[order])) + 1
        self.levels = np.split(order, cut) if len(order) else []

    def features(self) -> np.ndarray:
        """[element, slot] columns of the design that are 1; N_FEATURES stands for none."""
        words, links = self.words.astype(float), self.links.astype(float)
        for at in reversed(self.levels[1:]):
            np.add.at(words, self.parent[at], words[at])
            np.add.at(links, self.parent[at], links[at])
        share = np.where(words > 0, np.searchsorted(SHARE_BINS, links / np.maximum(words, 1), "right"), len(SHARE_BINS) + 1)
        above = np.where(self.parent >= 0, self.tag[self.parent], N_TAGS)
        stops = np.where(self.words == 0, 0, np.where(self.stops == 0, 1, 2))
        out = [OFFSETS[0] + self.tag, OFFSETS[1] + above, OFFSETS[3] + np.searchsorted(WORD_BINS, self.words, "right"), OFFSETS[4] + share, OFFSETS[5] + stops]
        out.append(np.full(len(self.tag), N_FEATURES - 1))
        for k in range(N_NAMES):
            out.append(np.where(self.names >> k & 1, OFFSETS[2] + k, N_FEATURES))
        return np.stack(out, 1)


@dataclass
class TreeModel:
    weight: np.ndarray  # [feature], then a zero
    edge: np.ndarray  # [parent label, child label]

    def marginals(self, forest: Forest) -> np.ndarray:
        """The probability of each element being content."""
        up = self.weight[forest.features()].sum(1) if len(forest.tag) else np.zeros(0)
        (a, b), (c, d) = np.log(self.edge)
        message = np.zeros(len(up))
        for at in reversed(forest.levels[1:]):  # leaves to root, in log odds
            message[at] = np.logaddexp(c, d + up[at]) - np.logaddexp(a, b + up[at])
            np.add.at(up, forest.parent[at], message[at])
        full = up
        for at in forest.levels[1:]:  # root to leaves: what the parent knows without this child
            rest = full[forest.parent[at]] - message[at]
            full[at] += np.logaddexp(b, d + rest) - np.logaddexp(a, c + rest)
        return 1 / (1 + np.exp(-np.clip(full, -40, 40)))


def train(pages: list[str], ridge: float = 0.003) -> TreeModel:
    """Potentials from pages whose elements carry ``data-y`` labels; an element without one has its parent's."""
    parsed = [Page(x, labelled=True) for x in pages]
    forest = Forest(parsed)
    label = np.zeros(len(forest.tag), np.int64)
    for k, p in enumerate(parsed):
        for i, y in enumerate(p.label):
            at = forest.first[k] + i
            label[at] = y if y is not None else (label[forest.parent[at]] if p.parent[i] >= 0 else 0)
    slots = forest.features()
    x = np.zeros((len(label), N_FEATURES + 1))
    np.put_along_axis(x, slots, 1.0, 1)
    x = x[:, :N_FEATURES]
    w = np.zeros(N_FEATURES)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (label - p) / len(x) - ridge / 10 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge / 10 * np.eye(len(w)), grad)
        w += step * min(1.0, 3 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    child = np.flatnonzero(forest.parent >= 0)
    pair = np.bincount(label[forest.parent[child]] * 2 + label[child], minlength=4).reshape(2, 2) + 1.0
    edge = pair / pair.sum(1, keepdims=True) / (pair.sum(0) / pair.sum())
    return TreeModel(np.append(w, 0.0), edge)


def labelled_pages(count: int = 700, seed: int = 3) -> list[str]:
    """Labelled pages of many layouts, drawn from parts whose role is known."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    maybe = lambda share, make: make() if rng.random() < share else ""

    def words(n):
        return " ".join(pick("alpha", "river", "stone", "of", "the", "and", "light", "garden", "turn", "over") for _ in range(max(int(n), 1)))

    def sentences(k):
        return " ".join(words(rng.integers(5, 18)).capitalize() + "." for _ in range(int(k)))

    def links(k):
        return "".join(f'<li><a href="/{i}">{words(rng.integers(1, 4))}</a></li>' for i in range(int(k)))

    def named(tag, names, label, body):
        name = pick(*names)
        attribute = f' {pick("class", "id")}="{name}"' if name else ""
        return f'<{tag}{attribute} data-y="{label}">{body}</{tag}>'

    def navigation():
        return named(pick("nav", "nav", "div", "ul"), ("menu", "nav", "main-nav", "navbar", "breadcrumbs"), 0, f"<ul>{links(rng.integers(3, 9))}</ul>")

    def bare_navigation():
        return f'<nav data-y="0"><ul>{links(rng.integers(3, 9))}</ul></nav>'

    def header():
        return named("header", ("", "site-header", "masthead"), 0, pick(f"<h1>{words(2)}</h1>", f"<div>{words(3)}</div>", f"<p>{words(6)}</p>") + maybe(0.5, bare_navigation))

    def advert():
        body = pick(sentences(1), words(8), f"<p>{sentences(2)}</p>", f'<a href="/buy">{words(5)}</a>')
        return named(pick("div", "div", "section", "aside"), ("ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner"), 0, body)

    def notice():
        return named(pick("div", "section", "p"), ("cookie-notice", "notice", "alert", "consent", "popup", "disclaimer"), 0, pick(sentences(1), sentences(3)))

    def sidebar():
        body = f"<h3>{words(2)}</h3>" + pick(f"<ul>{links(5)}</ul>", f"<p>{sentences(2)}</p>", f"<div>{sentences(1)}</div>")
        return pick(named("aside", ("", "sidebar", "related"), 0, body), named("div", ("sidebar", "widget", "related", "right-rail"), 0, body))

    def comments():
        one = lambda: pick(f'<div class="comment"><p>{sentences(rng.integers(1, 4))}</p></div>', f"<li><p>{sentences(2)}</p></li>", f"<p>{sentences(2)}</p>")
        body = pick("", "<h2>Comments</h2>") + "".join(one() for _ in range(int(rng.integers(1, 6))))
        return named(pick("section", "div", "ol"), ("comments", "comment-list", "replies", "disqus", "reader-comments"), 0, body)

    def form():
        return f'<form data-y="0"{pick("", " class=search", " id=newsletter")}>{pick("<label>" + words(2) + "</label><input>", "<p>" + sentences(1) + "</p><input>")}</form>'

    def footer():
        return pick(named("footer", ("", "site-footer"), 0, pick(f"&copy; {words(3)} &middot; {sentences(1)}", f"<p>{sentences(2)}</p>", f"<ul>{links(4)}</ul>")), named("div", ("footer", "copyright"), 0, f"<p>{sentences(1)}</p>"))

    def block():
        return pick(
            *[lambda: f"<p>{sentences(rng.integers(1, 9))}</p>"] * 6, lambda: f"<p>{words(rng.integers(1, 5))}.</p>", lambda: f"<h2>{words(rng.integers(2, 7))}</h2>",
            lambda: f"<ul>{''.join(f'<li>{sentences(1)}</li>' for _ in range(3))}</ul>", lambda: f"<blockquote><p>{sentences(2)}</p></blockquote>", lambda: f"<pre>{words(12)}</pre>",
            lambda: f"<table><tr><th>{words(1)}</th><td>{words(2)}</td></tr></table>", lambda: f"<figure><figcaption>{words(8)}</figcaption></figure>", lambda: f"<p><b>{sentences(3)}<br><p>{sentences(2)}</p>",
            lambda: f'<p>{sentences(2)} <a href="/x">{words(3)}</a> {sentences(1)}</p>',
        )()

    def article():
        body = maybe(0.85, lambda: pick(f"<h1>{words(rng.integers(2, 12))}</h1>", f"<header data-y=\"1\"><h1>{words(5)}</h1></header>"))
        body += maybe(0.15, lambda: f'<div class="{pick("share", "byline", "post-meta")}" data-y="0">{words(4)}</div>')
        for _ in range(int(rng.integers(1, 10))):
            body += block() + maybe(0.04, advert)
        body += maybe(0.3, comments) + maybe(0.06, lambda: f'<div class="related" data-y="0"><ul>{links(4)}</ul></div>') + maybe(0.05, form) + maybe(0.05, lambda: f'<footer data-y="0"><p>{words(6)}</p></footer>')
        inner = pick(body, body, body, f"<div>{body}</div>")
        return pick(
            *[lambda: f'<article data-y="1">{inner}</article>'] * 4, lambda: f'<main data-y="1">{inner}</main>', lambda: f'<main data-y="1"><article>{inner}</article></main>',
            lambda: named("div", ("content", "post", "article-body", "entry-content", "story"), 1, inner), lambda: f'<div data-y="1">{inner}</div>', lambda: f'<section data-y="1">{inner}</section>',
            lambda: "".join(f'<p data-y="1">{sentences(rng.integers(2, 9))}</p>' for _ in range(int(rng.integers(2, 7)))),
        )()

    def page():
        before = maybe(0.5, header) + maybe(0.8, lambda: pick(navigation, bare_navigation)()) + maybe(0.5, advert) + maybe(0.25, notice) + maybe(0.15, form)
        after = maybe(0.3, comments) + maybe(0.4, sidebar) + maybe(0.15, form) + maybe(0.2, advert) + maybe(0.9, footer)
        early = maybe(0.2, sidebar)
        return f'<html><head><title>{words(4)}</title></head><body data-y="0">{before}{early}{article()}{after}</body></html>'

    return [page() for _ in range(count)]


def extract(pages: DataFrame, model: TreeModel | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_chars of each whole page.

    White space inside a block (``<br>`` included) becomes one space; blocks are joined in page order by
    one newline.  A null or contentless page gives an empty text; an empty table gives no rows.  Pages may be
    of any length and depth.  Repeated rows and null ids keep their rows; columns other than id and html are
    passed on, but for ones named page_id, text or n_chars.  An element as likely content as not is left out.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train(labelled_pages()))
    kept = [c for c in pages.columns if c not in (id_col, html_col, "page_id", "text", "n_chars")]
    own = in_small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"), *kept)

    def run(batches):
        model = shared.value
        for whole in batches:
            for b in byte_slices(whole, "html"):
                parsed = [Page(x or "") for x in b.column("html").to_pylist()]
                forest = Forest(parsed)
                content = model.marginals(forest) > 0.5
                texts = ["\n".join(t for node, t in p.blocks if content[k + node]) for p, k in zip(parsed, forest.first.tolist(), strict=False)]
                rest = [b.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), *rest, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", *kept, "text", "n_chars"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "html")
    return own.mapInArrow(trimmed(run), f"{fields}, text string, n_chars long")
