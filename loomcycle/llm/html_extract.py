"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Every element and text node has a hidden label, content or not. A node's potential is linear in features
of its tag, the words of its class, id and role, its text's length and punctuation, the share of link text
below it, and its share of the page's text; a 2 x 2 table for each kind of node joins it to its parent. One upward and one downward
pass of sum-product messages give exact marginals; a block is kept if the marginals of its text, weighed
by length, reach one half. The potentials are trained by the gradient of the likelihood of whole labelled
pages (expected counts from the same messages), on pages of `html_training`.

Defined cases: null or empty html, and pages without text, give an empty text. Broken markup is read as
browsers do, roughly: missing end tags are implied, stray ones ignored, a tag that never ends is dropped
with what follows, as raw text (scripts, styles, titles, text areas, frames) without an end is; other elements that
never end show what they hold. Very long or deep pages take time in proportion to their length. Repeated rows give equal results, an empty table an empty one. Further columns of the
input are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomcycle.llm.html_tree import Tree, parse

SLOTS = 1 << 15
_NAME = re.compile(r"[a-z]+|\d+")
_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SENTENCE = re.compile(r"[.!?…](?:\s|$)")


@lru_cache(maxsize=50_000)
def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % SLOTS


@lru_cache(maxsize=50_000)
def _names(value: str) -> tuple[str, ...]:
    return tuple(sorted(set(_NAME.findall(_CASE.sub(" ", value).lower()))))


def features(tree: Tree) -> list[list[int]]:
    """Feature slots of each node."""
    n = len(tree.parent)
    chars, linked, ends = [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[tree.parent[i]] or tree.tag[i] == "a"
        if tree.tag[i] == "#text":
            chars[i] = len(tree.text[i].strip())
            linked[i] = chars[i] if in_link[i] else 0
            ends[i] = len(_SENTENCE.findall(tree.text[i]))
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        ends[p] += ends[i]
    out, prose = [], max(1, chars[0] - linked[0])
    for i in range(n):
        tag, parent = tree.tag[i], tree.parent[i]
        above = tree.tag[parent] if parent >= 0 else ""
        length = min(8, chars[i].bit_length() // 2 + (chars[i] > 0))
        density = -1 if not chars[i] else round(4 * linked[i] / chars[i])
        kind = "t" if tag == "#text" else "e"
        names = [f"tag {tag}", f"pair {above} {tag}", f"{kind} length {length}", f"{kind} links {density}", f"{kind} ends {min(3, ends[i])}", f"{kind} share {4 * (chars[i] - linked[i]) // prose}"]
        if kind == "e" and tree.attrs[i]:
            for key in ("class", "id", "role", "aria-label"):
                names += [f"name {x}" for x in _names(tree.attrs[i].get(key, ""))]
            if "hidden" in tree.attrs[i] or "display:none" in tree.attrs[i].get("style", "").replace(" ", ""):
                names.append("hidden")
        out.append([_slot(x) for x in names])
    return out


@dataclass
class PageModel:
    weights: list[float]
    #: pair[kind][parent's label][own label]; kind 1 is text
    pair: list[list[list[float]]]

    def marginals(self, tree: Tree) -> list[float]:
        """Probability of content for each node: messages from the leaves up, then from the root down."""
        w, n = self.weights, len(tree.parent)
        up = [sum([w[s] for s in slots]) for slots in features(tree)]
        sent = [0.0] * n
        for i in range(n - 1, 0, -1):  # a parent comes before its children
            (a, b), (c, d) = self.pair[tree.tag[i] == "#text"]
            sent[i] = _log_ratio(up[i] + d, c, up[i] + b, a)
            up[tree.parent[i]] += sent[i]
        belief = up
        for i in range(1, n):
            (a, b), (c, d) = self.pair[tree.tag[i] == "#text"]
            without = belief[tree.parent[i]] - sent[i]
            belief[i] += _log_ratio(without + d, b, without + c, a)
        return [1 / (1 + math.exp(-x)) if x > -700 else 0.0 for x in belief]


def _log_ratio(a: float, b: float, c: float, d: float) -> float:
    """log((e^a + e^b) / (e^c + e^d))"""
    return max(a, b) + math.log1p(math.exp(-abs(a - b))) - max(c, d) - math.log1p(math.exp(-abs(c - d)))


def fit(pages: list[str], rounds: int = 120, rate: float = 0.1, decay: float = 4e-4) -> PageModel:
    """Labelled pages mark their elements by data-main="1" or "0"; a node without a mark has its parent's label.

    A page that begins with `html_training.MAIN_ALL` is main text as a whole.
    """
    from loomcycle.llm.html_training import MAIN_ALL

    parent, label, kind, depth, row, col = [], [], [], [], [], []
    for page in pages:
        tree, base = parse(page), len(parent)
        for i, slots in enumerate(features(tree)):
            p = tree.parent[i]
            parent.append(p + base if p >= 0 else -1)
            mark = tree.attrs[i].get("data-main") or ("1" if p < 0 and page.startswith(MAIN_ALL) else None)
            label.append(int(mark) if mark else (label[p + base] if p >= 0 else 0))
            kind.append(int(tree.tag[i] == "#text"))
            depth.append(depth[p + base] + 1 if p >= 0 else 0)
            row += [base + i] * len(slots)
            col += slots
    parent, label, kind, depth, row, col = (np.array(x) for x in (parent, label, kind, depth, row, col))
    n, levels = len(parent), [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
    below = np.flatnonzero(parent >= 0)
    w, pair = np.zeros(SLOTS), np.zeros((2, 2, 2))
    params = [(w, np.zeros_like(w), np.zeros_like(w)), (pair, np.zeros_like(pair), np.zeros_like(pair))]
    seen_pair = np.zeros((2, 2, 2))
    np.add.at(seen_pair, (kind[below], label[parent[below]], label[below]), 1)
    for step in range(1, rounds + 1):
        up = np.bincount(row, weights=w[col], minlength=n)
        sent, t = np.zeros(n), pair[kind]
        for at in reversed(levels):
            sent[at] = np.logaddexp(up[at] + t[at, 1, 1], t[at, 1, 0]) - np.logaddexp(up[at] + t[at, 0, 1], t[at, 0, 0])
            np.add.at(up, parent[at], sent[at])
        belief = up.copy()
        for at in levels:
            without = belief[parent[at]] - sent[at]
            belief[at] += np.logaddexp(without + t[at, 1, 1], t[at, 0, 1]) - np.logaddexp(without + t[at, 1, 0], t[at, 0, 0])
        p = 1 / (1 + np.exp(-np.clip(belief, -60, 60)))
        without = belief[parent[below]] - sent[below]
        joint = t[below] + without[:, None, None] * np.array([0, 1])[None, :, None] + up[below][:, None, None] * np.array([0, 1])[None, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        joint /= joint.sum((1, 2), keepdims=True)
        expected = np.stack([joint[kind[below] == k].sum(0) for k in (0, 1)])
        grads = (np.bincount(col, weights=(label - p)[row], minlength=SLOTS) / len(pages) - decay * w, (seen_pair - expected) / len(pages) - decay * pair)
        for (value, m, v), g in zip(params, grads):  # Adam
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return PageModel(w.tolist(), pair.tolist())


def main_text(page: str | None, model: PageModel) -> str:
    if not page:
        return ""
    tree = parse(page)
    marginal = model.marginals(tree)
    blocks: dict[int, list[int]] = {}
    for i, tag in enumerate(tree.tag):
        if tag == "#text":
            blocks.setdefault(tree.block[i], []).append(i)
    kept = []
    for nodes in blocks.values():
        text = " ".join("".join(tree.text[i] for i in nodes).split())
        if text:
            weight = [len(tree.text[i].strip()) for i in nodes]
            if sum(m * x for m, x in zip((marginal[i] for i in nodes), weight)) >= 0.5 * sum(weight):
                kept.append(text)
    return " ".join(kept)


def extract_html(pages: DataFrame, model: PageModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text: one row per page."""
    if model is None:
        from loomcycle.llm.html_training import labelled_pages

        model = fit(labelled_pages())
    sent = pages.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h, sent.value) for h in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])

    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return named.mapInArrow(extract, "page_id long, url string, text string")
