"""Splitting oversized items at natural boundaries by structure-tree packing.

A text is read as a tree: sections by heading level, blocks, list items by indentation, lines,
sentences, clauses, words and, last, characters. The tree is held as ranked boundaries: a boundary of
rank r separates subtrees of level r, and the node at level r between two such boundaries is the text
between them. Packing descends only into nodes above the limit and merges sibling subtrees, left to
right and bottom-up, as long as they fit. Each piece but the first repeats up to ``overlap`` characters
of the text before it, cut back to a word start where one is near, and stays within the limit with them.

Sizes are code points. Taking the cores (``start`` to ``end``) of an item's pieces in order gives back
its text exactly. Defined cases: null gives no row; an empty text or one within the limit is a single
piece; a text without any inner boundary is cut between characters, never inside a combining sequence
unless that alone exceeds the limit.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1200
OVERLAP = 120

_MD_HEADING = re.compile(r"^[ \t]{0,3}(#{1,6})[ \t]+\S", re.M)
_TAG_HEADING = re.compile(r"<h([1-6])\b", re.I)
_NUM_HEADING = re.compile(r"^[ \t]{0,3}(\d{1,3}(?:\.\d{1,3}){0,4})[.)]?[ \t]+[A-Z][^\n]{0,80}$(?=\n)", re.M)
_CAPS_HEADING = re.compile(r"^(?=[^\n]*[A-Z])[A-Z0-9][A-Z0-9 ,/&()'-]{2,78}:?[ \t]*$", re.M)
_LABEL_HEADING = re.compile(r"^[A-Z][A-Za-z /&()'-]{2,60}:[ \t]*$", re.M)
_BLOCK = re.compile(r"(?:\r\n?|\n)[ \t]*(?:\r\n?|\n)\s*|(?=<(?:p|div|ul|ol|table|section)\b)", re.I)
_ITEM = re.compile(r"^([ \t]*)(?:[-*+•‣–—]|\(?\d{1,3}[.)]|\(?[a-z][.)]|<li\b[^>]*>)[ \t]", re.M)
_LINE = re.compile(r"\r\n|\r|\n")
_SENTENCE = re.compile(r"[.!?…。！？]+[\"'”’)\]]*\s+(?=[^\s])")
_CLAUSE = re.compile(r"[;:,–—][ \t]+|\)[ \t]+")
_WORD = re.compile(r"\s+")

#: Ranks, strongest first: 0-6 headings, 7 blocks, 8-15 list items by indentation, then these.
_R_BLOCK, _R_ITEM, _R_LINE, _R_SENTENCE, _R_CLAUSE, _R_WORD = 7, 8, 16, 17, 18, 19
RANKS = 20


def _boundaries(t: str) -> list[list[int]]:
    """For each rank the sorted cut positions that separate its subtrees, stronger ranks included."""
    own: list[set[int]] = [set() for _ in range(RANKS)]
    for m in _MD_HEADING.finditer(t):
        own[len(m[1]) - 1].add(m.start())
    for m in _TAG_HEADING.finditer(t):
        own[int(m[1]) - 1].add(m.start())
    for m in _NUM_HEADING.finditer(t):
        own[min(6, 2 + m[1].count("."))].add(m.start())
    for m in _CAPS_HEADING.finditer(t):
        own[5].add(m.start())
    for m in _LABEL_HEADING.finditer(t):
        own[6].add(m.start())
    for m in _BLOCK.finditer(t):
        own[_R_BLOCK].add(m.end())
    for m in _ITEM.finditer(t):
        indent = len(m[1].expandtabs(4)) // 2
        own[min(_R_LINE - 1, _R_ITEM + indent)].add(m.start())
    for rank, rx in ((_R_LINE, _LINE), (_R_SENTENCE, _SENTENCE), (_R_CLAUSE, _CLAUSE), (_R_WORD, _WORD)):
        own[rank].update(m.end() for m in rx.finditer(t))
    out, seen = [], set()
    for s in own:
        seen |= s
        out.append(sorted(x for x in seen if 0 < x < len(t)))
    return out


def _char_cuts(t: str, a: int, b: int, cap: int) -> list[tuple[int, int]]:
    spans = []
    while b - a > cap:
        cut = a + cap
        while cut > a + 1 and unicodedata.combining(t[cut]):
            cut -= 1
        if cut == a + 1 and cap > 1:
            cut = a + cap
        spans.append((a, cut))
        a = cut
    spans.append((a, b))
    return spans


def _merge(spans: list[tuple[int, int]], cap: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and b - out[-1][0] <= cap:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def pack_tree(t: str, cap: int) -> list[tuple[int, int]]:
    """Spans of at most cap characters that tile the text, cut at the strongest boundaries possible."""
    if len(t) <= cap:
        return [(0, len(t))]
    ranks = _boundaries(t)

    def descend(a: int, b: int, rank: int) -> list[tuple[int, int]]:
        if b - a <= cap:
            return [(a, b)]
        while rank < RANKS:
            cuts = ranks[rank]
            inner = cuts[bisect_right(cuts, a) : bisect_left(cuts, b)]
            if inner:
                break
            rank += 1
        else:
            return _char_cuts(t, a, b, cap)
        spans: list[tuple[int, int]] = []
        edges = [a, *inner, b]
        run: list[tuple[int, int]] = []
        for x, y in zip(edges, edges[1:], strict=False):
            if y - x <= cap:
                run.append((x, y))
            else:
                spans += _merge(run, cap) + descend(x, y, rank + 1)
                run = []
        return spans + _merge(run, cap)

    # siblings at the seams of descended nodes may still fit together
    return _merge(descend(0, len(t), 0), cap)


def _overlap_start(t: str, start: int, overlap: int) -> int:
    """Where a piece begins to repeat earlier text: about overlap characters back, at a word start if near."""
    lo = max(0, start - overlap)
    if lo == 0 or overlap == 0:
        return lo
    m = _WORD.search(t, lo, min(start, lo + overlap // 4))
    return m.end() if m and m.end() < start else lo


def split_text(t: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(from, start, end) of each piece: t[start:end] is its own text, t[from:start] repeats the one before."""
    if len(t) <= limit:
        return [(0, 0, len(t))]
    spans = pack_tree(t, limit - overlap)
    return [(_overlap_start(t, a, overlap) if i else a, a, b) for i, (a, b) in enumerate(spans)]


def split_items(
    items: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, oversized_only: bool = False
) -> DataFrame:
    """(key, piece, pieces, start, end, overlap, text): the pieces of each item; other columns are left out.

    oversized_only leaves items within the limit out before any text leaves the JVM.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    key_type = items.schema[key].dataType.simpleString()
    src = items.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    if oversized_only:
        src = src.filter(F.length("t") > limit)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["k", "piece", "pieces", "start", "end", "overlap", "text"]
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["k"], pdf["t"], strict=True):
                parts = split_text(t, limit, overlap)
                rows += [(k, i, len(parts), a, b, a - f, t[f:b]) for i, (f, a, b) in enumerate(parts)]
            yield pd.DataFrame(rows, columns=cols)

    out = src.mapInPandas(cut, f"k {key_type}, piece int, pieces int, start int, end int, overlap int, text string")
    return out.withColumnRenamed("k", key)
