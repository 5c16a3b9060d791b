"""Evaluation texts leaking into training texts, by winnowing.

Texts become words (letters and digits only, compatibility forms and letter case folded, invisible
characters dropped), words become hashed k-grams, and of each window of w successive k-grams the
smallest hash is kept, the rightmost among equals. Two texts that share k + w - 1 successive words
then share a kept hash, wherever the span lies. Shared hashes are extended to both sides over
replaced words, each of which may be any one word of the document as written between blanks.

A leak is a span of at least ``min_words`` successive words of the item of which at most one in
``replaced`` is another word. Such a span holds an intact run of at least 7 words (worst case: 30
words with 3 replaced, evenly spread), so k = 6 and w = 2 can miss none. Words of the item are counted as written
between blanks, so "7.15" and "six-minute" are one word each, however the document spaces them.

Joining: while the items' kept hashes stay within ``index_bound`` they are broadcast, and each
document is searched where it lies, without a shuffle. The bound is checked before. Beyond it, the
items are told apart by their hashes: an item with a hash that more than ``common`` items hold (a
phrase of many items) is searched for in blocks within the bound, each broadcast in turn, so common
hashes never meet in pairs; the hashes of all other items meet those of the documents in a salted
shuffle join, with at most ``common`` pairs for each hash of a document, and only documents with a hit
are read again. Both ways are exact, so their union is.

Defined cases: null and empty texts match nothing; an item below ``min_words`` can not leak; repeated
documents each yield their rows; a repeated item id keeps all its texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.session import cut_lineage

K, W = 6, 2
MIN_WORDS = 25
REPLACED = 10
#: Kept hashes of items that may be broadcast at a time (with the words about 200 bytes each in a Python worker).
INDEX_BOUND = 300_000
#: A hash held by more items than this is common.
COMMON = 50
#: Tasks over which the documents of one hash are spread in the shuffle join.
SALTS = 16

_TOKEN = re.compile(r"[^\W_]+")
_HYPHEN = re.compile(r"[^\S\r\n]*[-\u2010\u2013]\s*")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFKC", text)
    for ch in set(t):
        if ch > "\x7f" and unicodedata.category(ch) == "Cf":
            t = t.replace(ch, "")
    return t.casefold()


def doc_tokens(text: str) -> list[str]:
    return _TOKEN.findall(_fold(text))


def item_words(text: str) -> list[tuple[str, ...]]:
    """The words between blanks, each as the tokens it is made of; words without any token are left out."""
    return [w for w in (tuple(_TOKEN.findall(x)) for x in _fold(text).split()) if w]


class HashCache(dict):
    """Hashes of tokens, worked out when first asked for."""

    def __missing__(self, tok: str) -> int:
        import xxhash

        h = self[tok] = xxhash.xxh64_intdigest(tok)
        return h


def kept_hashes(tokens: list[str], cache: HashCache, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the k-grams that winnowing keeps, in order of position."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))
    gram = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            gram = gram * _BASE + h[j : j + n]
        gram ^= gram >> np.uint64(29)
        gram *= np.uint64(0xBF58476D1CE4E5B9)
    if n <= w:
        at = np.array([n - 1 - int(np.argmin(gram[::-1]))])
    else:
        if w == 2:  # the second of a pair, unless the first is smaller
            at = np.arange(1, n) - (gram[:-1] < gram[1:])
        else:
            win = np.lib.stride_tricks.sliding_window_view(gram, w)
            at = np.arange(len(win)) + w - 1 - np.argmin(win[:, ::-1], axis=1)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return gram[at], at


def joints(text: str) -> tuple[list[int], list[int], list[bool]]:
    """For each token of a document where the word that it belongs to ends and starts, and whether blanks stand before
    it inside that word. Tokens are one word without a blank between them, or around a hyphen (broken lines)."""
    folded = _fold(text)
    spans = [m.span() for m in _TOKEN.finditer(folded)]
    n = len(spans)
    end, start, apart = list(range(1, n + 1)), list(range(n)), [False] * n
    for k in range(1, n):
        gap = folded[spans[k - 1][1] : spans[k][0]]
        blank = any(ch.isspace() for ch in gap)
        if not blank or _HYPHEN.fullmatch(gap):
            start[k], apart[k] = start[k - 1], blank
    for k in range(n - 2, -1, -1):
        if start[k + 1] == start[k]:
            end[k] = end[k + 1]
    return end, start, apart


def _extend(words, tokens, bounds, i: int, p: int, step: int, allowed: int) -> list[int]:
    """Follows the item's words from i and the document's tokens from p in direction step (1 or -1).

    At m of the result stands the largest number of words that are passed with m differing ones and end in an
    equal one. A word that differs may stand for one token, for as many as it has itself or for any first
    part or the whole of the document's word; all ways are followed at once, the fewest differing words
    counting at each place. Words are equal when their characters are, however they are divided.
    """

    ends, starts, apart = bounds

    def match(i: int, p: int) -> int:
        whole, got, n = "".join(words[i]), "", 0
        while len(got) < len(whole) and 0 <= p < len(tokens):
            got = got + tokens[p] if step > 0 else tokens[p] + got
            p, n = p + step, n + 1
        return n if got == whole else 0

    def added(i: int, p: int, n: int) -> bool:
        """The n tokens are two words around a hyphen, one of them the item's own: no other word, but one too many."""
        a = p if step > 0 else p - n + 1
        whole, part = "".join(words[i]), "".join(tokens[a : a + n])
        return any(apart[a + 1 : a + n]) and (part.startswith(whole) or part.endswith(whole))

    reach = [0] * (allowed + 1)
    at, passed = {p: 0}, 0
    while at and 0 <= i < len(words):
        passed += 1
        after: dict[int, int] = {}
        for p, missed in at.items():
            if not 0 <= p < len(tokens):
                continue
            m = match(i, p)
            if m:
                reach[missed] = passed
                q = p + step * m
                after[q] = min(after.get(q, missed), missed)
            if missed == allowed:
                continue
            group = ends[p] - p if step > 0 else p + 1 - starts[p]
            for n in {*range(1, min(group, 4) + 1), group, len(words[i])}:
                if n == m or added(i, p, n):
                    continue
                q = p + step * n
                after[q] = min(after.get(q, missed + 1), missed + 1)
        at = after
        i += step
    return reach


def leaked_span(words, tokens, bounds, i: int, p: int, min_words: int = MIN_WORDS, replaced: int = REPLACED) -> tuple[bool, int, int]:
    """(leaks, first word, end word of the longest leak) around word i of the item at token p."""
    allowed = len(words) // replaced  # no leak has more differing words
    right = _extend(words, tokens, bounds, i, p, 1, allowed)
    left = _extend(words, tokens, bounds, i - 1, p - 1, -1, allowed)
    best = (0, 0)
    for m, a in enumerate(left):
        for n, b in enumerate(right[: allowed + 1 - m]):
            if a + b >= max(min_words, replaced * (m + n), sum(best) + 1):
                best = (a, b)
    return sum(best) > 0, i - best[0], i + best[1]


class ItemIndex:
    """Kept hashes of the items and where they stand."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words: list = []
        self.tokens: list = []
        self.ids: list = []
        cache = HashCache()
        hashes, owner, word_at = [], [], []
        for item_id, text in items:
            words = item_words(text or "")
            tokens = [t for w in words for t in w]
            word_of = [j for j, w in enumerate(words) for _ in w]
            first = [j for w in words for j in range(len(w))]  # place of the token in its word
            h, at = kept_hashes(tokens, cache)
            n = len(self.words)
            self.words.append(words)
            self.tokens.append(tokens)
            self.ids.append(item_id)
            for x, a in zip(h.tolist(), at.tolist(), strict=True):
                hashes.append(x)
                owner.append(n)
                # the first whole word at or after the k-gram's start, its distance in tokens and its place among them
                skip = 0
                while a + skip < len(tokens) and first[a + skip]:
                    skip += 1
                word_at.append((word_of[a + skip] if a + skip < len(tokens) else len(words) - 1, skip, a + skip))
        order = np.argsort(np.array(hashes, np.uint64), kind="stable")
        self.hashes = np.array(hashes, np.uint64)[order]
        self.owner = np.array(owner, np.int64)[order]
        self.place = [word_at[j] for j in order.tolist()]

    def search(self, text: str, cache: HashCache) -> list[tuple]:
        """(item id, first word, end word) of each item that leaks into the text."""
        tokens = doc_tokens(text)
        h, at = kept_hashes(tokens, cache)
        if not len(self.hashes) or not len(h):
            return []
        lo = np.searchsorted(self.hashes, h, "left")
        held = np.flatnonzero(self.hashes[np.minimum(lo, len(self.hashes) - 1)] == h)
        if not len(held):
            return []
        lo, at, hi = lo[held].tolist(), at[held].tolist(), np.searchsorted(self.hashes, h[held], "right").tolist()
        found: dict[int, tuple] = {}
        # A leak around one word of an intact stretch can be widened to its other words, so one try is enough for
        # the stretch, but only for it: where it ends, by item and distance of the places.
        tried: dict[tuple[int, int], int] = {}
        bounds = None
        for first_at, end_at, place in zip(lo, hi, at, strict=True):
            for e in range(first_at, end_at):
                n = int(self.owner[e])
                word, skip, a = self.place[e]
                p = place + skip
                if n in found or a < tried.get((n, a - p), 0):
                    continue
                bounds = bounds or joints(text)
                ok, first, end = leaked_span(self.words[n], tokens, bounds, word, p)
                if ok:
                    found[n] = (self.ids[n], first, end)
                    continue
                run = 0
                for x, y in zip(islice(self.tokens[n], a, None), islice(tokens, p, None), strict=False):
                    if x != y:
                        break
                    run += 1
                tried[n, a - p] = a + run
        return list(found.values())


def find_leaks(
    docs: DataFrame,
    doc_key: str,
    doc_text: str,
    items: DataFrame,
    item_key: str,
    item_text: str,
    index_bound: int = INDEX_BOUND,
    common: int = COMMON,
) -> DataFrame:
    """(doc key, item key, first_word, end_word), one row per document and item that leaks into it; the words are
    those of the longest leak around its first hit that is in one."""
    d = docs.select(F.col(doc_key).alias("d"), F.col(doc_text).alias("t")).filter(F.length("t") > 0)
    it = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("x")).filter(F.length("x") > 0)
    if it.agg(F.coalesce(F.sum(_weight()), F.lit(0))).first()[0] <= index_bound:
        out = _by_broadcast(d, it)
    else:
        held = cut_lineage(_hashes(it, "i", "x"))
        many = held.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > common)
        phrased = cut_lineage(held.join(many, "h", "left_semi").select("i").distinct())
        out = _by_shuffle(d, it, held.join(phrased, "i", "left_anti"))
        for block in _blocks(it.join(phrased, "i", "left_semi"), index_bound):
            out = out.unionByName(_by_broadcast(d, block))
    return out.groupBy("d", "i").agg(F.min(F.struct("first_word", "end_word")).alias("s")).select(
        F.col("d").alias(doc_key), F.col("i").alias(item_key), "s.first_word", "s.end_word"
    )


def _weight():
    """A bound on the kept hashes of a text: a word has two characters at least with its blank, and is kept once at most."""
    return F.floor(F.length("x") / 2)


def _blocks(it: DataFrame, index_bound: int) -> list[DataFrame]:
    """The items in parts that keep to the bound, or hold a single item (no part can be smaller)."""
    n = 1
    while True:
        block = F.pmod(F.xxhash64("i", "x"), F.lit(n)).cast("int")
        sizes = it.groupBy(block.alias("b")).agg(F.sum(_weight()).alias("s"), F.count_distinct("i", "x").alias("n")).collect()
        over = [r for r in sizes if r["s"] > index_bound and r["n"] > 1]
        if not over:
            return [it.filter(block == r["b"]).distinct() for r in sizes]
        n *= 2


def _schema(d: DataFrame, it: DataFrame) -> str:
    dt, itype = d.schema["d"].dataType.simpleString(), it.schema["i"].dataType.simpleString()
    return f"d {dt}, i {itype}, first_word int, end_word int"


def _by_broadcast(d: DataFrame, it: DataFrame) -> DataFrame:
    index = d.sparkSession.sparkContext.broadcast(ItemIndex([tuple(r) for r in it.collect()]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = HashCache()
        for pdf in batches:
            if len(cache) > 200_000:
                cache.clear()
            rows = [(k, *hit) for k, t in zip(pdf["d"], pdf["t"], strict=True) for hit in index.value.search(t, cache)]
            yield pd.DataFrame(rows, columns=["d", "i", "first_word", "end_word"])

    return d.mapInPandas(run, _schema(d, it))


def _hashes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, h): the distinct kept hashes of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = HashCache()
        for pdf in batches:
            if len(cache) > 200_000:
                cache.clear()
            keys, hs = [], []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                h, _ = kept_hashes(doc_tokens(t), cache)
                h = np.unique(h)
                keys += [k] * len(h)
                hs.append(h.view(np.int64))
            yield pd.DataFrame({key: keys, "h": np.concatenate(hs) if hs else np.empty(0, np.int64)})

    return df.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, h bigint").distinct()


def _by_shuffle(d: DataFrame, it: DataFrame, held: DataFrame) -> DataFrame:
    salted = held.select("i", "h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    ours = _hashes(d, "d", "t").withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(SALTS)).cast("int"))
    pairs = ours.join(salted, ["h", "salt"]).select("d", "i").distinct()
    both = pairs.join(d, "d").join(it, "i")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = HashCache()
        for pdf in batches:
            cache.clear()
            rows = []
            for k, i, t, x in zip(pdf["d"], pdf["i"], pdf["t"], pdf["x"], strict=True):
                rows += [(k, *hit) for hit in ItemIndex([(i, x)]).search(t, cache)]
            yield pd.DataFrame(rows, columns=["d", "i", "first_word", "end_word"])

    return both.mapInPandas(run, _schema(d, it))
