"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

A page is parsed into leaf blocks; a block is seen through the tags and names above it and through
its text.  Two labels, article and other, form a chain in page order; weights are trained on
labelled pages (a bounded set of drawn layouts, ``TRAIN_PAGES``) by gradient steps on the exact
likelihood, and the best labelling of a page is found by Viterbi.  Scripts, styles and other
unseen elements never become blocks.

Pages are independent: the work is one pass in the scan's stage, in Arrow batches of bounded
bytes.  Defined results: a null or empty page has the empty text; a page of plain text without
tags is one block; repeated rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.html_blocks import leaf_blocks
from foldwise.llm.html_training import page
from foldwise.llm.text import small_batches

TRAIN_PAGES = 900
STEPS = 250
RIDGE = 1e-3
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
# Words that mark what is not an article, in the page languages.
_CUES = re.compile(r"©|copyright|cookie|all rights|subscribe|newsletter|advertis|sponsor|sign in|log ?in|privacy|datenschutz|droits|derechos|share|related|comment", re.I)


@lru_cache(maxsize=100_000)
def path_features(path: tuple) -> tuple[str, ...]:
    """Features of the tags above a block: every ancestor's tag, its names and the names' beginnings, and the innermost tag."""
    out = {"bias"}
    for tag, names in path:
        if tag not in ("html", "body"):
            out.add("tag:" + tag)
        for w in _SPLIT.split(names):
            if w:
                out.add("name:" + w.lower())
                out.add("start:" + w.lower()[:4])
    out.add("leaf:" + (path[-1][0] if path else ""))
    if any(t in ("article", "main") for t, _ in path):
        out.add("in_article")
    if not any(t not in ("html", "body", "p", "div") or n for t, n in path):
        out.add("plain_path")
    return tuple(sorted(out))


def text_features(text: str, linked: int, count: int) -> tuple[str, ...]:
    """Features of a block's text, as names of bins."""
    n = text.count(" ") + 1
    share = linked / max(1, len(text))
    return (
        "words:" + ("1" if n == 1 else "3" if n < 4 else "10" if n < 11 else "30" if n < 31 else "more"),
        "links:" + ("none" if share == 0 else "some" if share < 0.5 else "most"),
        "ends:" + ("stop" if text[-1] in ".!?:;\"'»”" else "open"), "cue" if _CUES.search(text) else "no_cue",
        "only" if count == 1 else "one_of_many",
    )


def block_features(blocks: list) -> list[tuple[str, ...]]:
    """Features of every block; where a page has an article or main element, blocks outside it are told apart."""
    paths = [path_features(p) for p, _, _ in blocks]
    marked = any("in_article" in p for p in paths)
    place = lambda p: ("beside_article",) if marked and "in_article" not in p else ()
    return [p + place(p) + text_features(t, a, len(blocks)) for p, (_, t, a) in zip(paths, blocks)]


class Chain:
    """Weights of a two-label chain; names that the training pages never had weigh nothing."""

    def __init__(self, weights: dict[str, float], step: list[list[float]]):
        self.weights, self.step = weights, step

    def label(self, features: list[tuple[str, ...]]) -> list[int]:
        """Best labels by Viterbi; a block's score is that of label 1 over label 0."""
        if not features:
            return []
        get, s = self.weights.get, self.step
        best, back = [0.0, 0.0], []
        for k, names in enumerate(features):
            e = sum([get(f, 0.0) for f in names])
            if k == 0:
                best = [0.0, e]
                continue
            from0, from1 = (best[0] + s[0][0], best[1] + s[1][0]), (best[0] + s[0][1], best[1] + s[1][1])
            back.append((int(from0[1] > from0[0]), int(from1[1] > from1[0])))
            best = [max(from0), max(from1) + e]
        out = [int(best[1] > best[0])]
        for b in reversed(back):
            out.append(b[out[-1]])
        return out[::-1]


def labelled_blocks(pages: int, first: int = 0) -> list[tuple[list, list[int]]]:
    """Blocks and labels of drawn pages; a block's label is that of the piece in which its text stands."""
    out = []
    for seed in range(first, first + pages):
        pieces, marks = page(seed)
        blocks = leaf_blocks("".join(pieces))
        truth: list[int] = []
        for piece, mark in zip(pieces[1:-1], marks[1:-1], strict=True):
            if mark >= 0:
                truth += [mark] * len(leaf_blocks(piece))
        if len(truth) == len(blocks):
            out.append((blocks, truth))
    return out


def fit(pages: int = TRAIN_PAGES, steps: int = STEPS, ridge: float = RIDGE) -> Chain:
    """Train on drawn pages by adaptive gradient steps; all chains run side by side, padded to one length."""
    data = [(block_features(b), y) for b, y in labelled_blocks(pages) if b]
    names = sorted({f for x, _ in data for fs in x for f in fs})
    at = {f: k for k, f in enumerate(names)}
    n, m = len(data), max(len(y) for _, y in data)
    label, real = np.zeros((n, m), int), np.zeros((n, m), bool)
    rows, cols = [], []
    for i, (x, y) in enumerate(data):
        label[i, : len(y)], real[i, : len(y)] = y, True
        for k, fs in enumerate(x):
            rows += [i * m + k] * len(fs)
            cols += [at[f] for f in fs]
    rows, cols = np.array(rows), np.array(cols)
    w, s = np.zeros(len(names)), np.zeros((2, 2))
    seen_w, seen_s = np.full(len(names), 1e-8), np.full((2, 2), 1e-8)
    pair = real[:, 1:]
    told = np.array([[(pair & (label[:, :-1] == a) & (label[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    for _ in range(steps):
        e = np.zeros((n, m, 2))
        e[:, :, 1] = np.bincount(rows, weights=w[cols], minlength=n * m).reshape(n, m)
        ahead, behind = np.zeros((n, m, 2)), np.zeros((n, m, 2))
        ahead[:, 0] = e[:, 0]
        for k in range(1, m):
            go = np.logaddexp(ahead[:, k - 1, :1] + s[0], ahead[:, k - 1, 1:] + s[1]) + e[:, k]
            ahead[:, k] = np.where(real[:, k, None], go, ahead[:, k - 1])
        for k in range(m - 2, -1, -1):
            x = behind[:, k + 1] + e[:, k + 1]
            go = np.logaddexp(s[:, 0][None] + x[:, :1], s[:, 1][None] + x[:, 1:])
            behind[:, k] = np.where(real[:, k + 1, None], go, 0.0)
        total = np.logaddexp(ahead[:, m - 1, 0], ahead[:, m - 1, 1])
        p = np.exp(np.clip(ahead[:, :, 1] + behind[:, :, 1] - total[:, None], -50, 0)) * real
        both = ahead[:, :-1, :, None] + s[None, None] + (e[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        both = np.exp(np.clip(both, -50, 0)) * pair[:, :, None, None]
        gw = np.bincount(cols, weights=((label - p) * real).ravel()[rows], minlength=len(names)) / n - ridge * w
        gs = (told - both.sum(axis=(0, 1))) / n - ridge * s
        seen_w += gw**2
        seen_s += gs**2
        w = w + 0.5 * gw / np.sqrt(seen_w)
        s = s + 0.5 * gs / np.sqrt(seen_s)
    return Chain(dict(zip(names, w.tolist(), strict=True)), s.tolist())


def main_text(html: str | None, chain: Chain) -> str:
    blocks = leaf_blocks(html)
    return "\n".join(t for (_, t, _), y in zip(blocks, chain.label(block_features(blocks)), strict=True) if y)


def extract(pages: DataFrame, chain: Chain, html: str = "html", into: str = "text") -> DataFrame:
    """All input columns but ``html``, and the page's main text."""
    small_batches(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html, into)]
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(into, T.StringType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = pa.array([main_text(x.as_py(), chain) for x in b.column(b.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], names=schema.names)

    return rows.mapInArrow(run, schema)
