"""Filling containers of fixed capacity with texts by the sum-of-squares rule.

Texts are measured in tokens of a public tokenizer. Each text is placed where the sum, over all
residual gaps g, of the squared number of open containers with gap g becomes smallest. A text above
the capacity is cut into parts of exactly the capacity plus a remainder; nothing else is ever cut.

At scale: measuring is a narrow pass over the texts; only (id, tokens) is shuffled, into shards of
about ``per_shard`` texts by hash of the id, and each shard is packed on its own. A shard leaves at
most a few containers partly filled, so the loss against one global run vanishes with its size.

Defined cases: null and empty texts have no tokens and occupy no space, they go into a container of
their shard that is open anyway, else into one of their own; repeated texts are packed each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
PER_SHARD = 20_000


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of an installed public tokenizer file; it must lie at the same place on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counter(path: str):
    """texts -> their numbers of tokens. Files of ranks are read by tiktoken, which counts several times
    faster and is the default; other files by tokenizers. Strings of special tokens are ordinary text."""
    if path.endswith(".tiktoken"):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        enc = tiktoken.Encoding("counter", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True

    def count(texts: list[str]) -> list[int]:
        blocks = (texts[i : i + 256] for i in range(0, len(texts), 256))
        return [len(e) for b in blocks for e in tok.encode_batch_fast(b, add_special_tokens=False)]

    return count


def count_tokens(texts: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, tokens): number of tokens of each text; the tokenizer file is read once per Python worker."""
    path = path or tokenizer_path()
    key_type = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(path)
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "tokens": count(pdf["t"].fillna("").tolist())})

    src = texts.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return src.mapInPandas(run, f"k {key_type}, tokens bigint").withColumnRenamed("k", key)


def sum_of_squares(sizes: np.ndarray, capacity: int, most: int | None = None) -> np.ndarray | None:
    """Container number of each item, placed in the given order; sizes lie between 0 and capacity.

    None as soon as more than ``most`` containers are open or filled.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)  # open containers by gap, gap 0 left out of the sum
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), dtype=np.int64)
    made = 0
    for i, s in enumerate(sizes.tolist()):
        if s == 0:
            if not made:
                open_at[capacity].append(made)
                count[capacity] += 1
                made += 1
            out[i] = 0
            continue
        # change of the sum for each gap g >= s: the container leaves g and arrives at g - s
        n = count[s:]
        change = 2 * (count[: capacity + 1 - s] - n) + 2
        change[0] = 1 - 2 * n[0]  # gap 0 does not count
        change[n == 0] = np.iinfo(np.int64).max
        best = int(np.argmin(change))
        fresh = 1 + 2 * int(count[capacity - s]) if s < capacity else 0
        if n[best] > 0 and change[best] <= fresh:
            g = best + s
            b = open_at[g].pop()
            count[g] -= 1
        else:
            if made == most:
                return None
            g, b = capacity, made
            made += 1
        if g > s:
            count[g - s] += 1
        open_at[g - s].append(b)
        out[i] = b
    return out


def placing_order(sizes: np.ndarray, last_share: float = 0.1) -> np.ndarray:
    """The given order, but for the smallest tenth, which comes last, largest first, to close what is open."""
    last = np.argsort(sizes, kind="stable")[: int(len(sizes) * last_share)][::-1]
    first = np.setdiff1d(np.arange(len(sizes)), last, assume_unique=True)
    return np.concatenate([first, last])


def best_packing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item by the rule, in the better of two orders: few items pack better largest first.

    The second order is tried only where the first has not reached the least possible number, and is given
    up once it needs as many containers.
    """
    best = None
    most = None
    for order in (placing_order(sizes), np.argsort(-sizes, kind="stable")):
        got = sum_of_squares(sizes[order], capacity, most)
        if got is None:
            continue
        best = np.empty(len(sizes), dtype=np.int64)
        best[order] = got
        made = int(best.max(initial=-1)) + 1
        if made <= max(1, -(-int(sizes.sum()) // capacity)):
            break
        most = made - 1
    return best


def pack(
    sized: DataFrame, key: str, n_texts: int, capacity: int = CAPACITY, per_shard: int = PER_SHARD
) -> DataFrame:
    """(key, tokens) -> (key, part, token_start, tokens, container).

    container names the shard and the container in it. n_texts sets the number of shards; count it on
    the source table, where that reads no text.
    """
    key_type = sized.schema[key].dataType.simpleString()
    src = sized.select(F.col(key).alias("k"), F.coalesce(F.col("tokens"), F.lit(0)).cast("bigint").alias("tokens"))
    shards = max(1, -(-n_texts // per_shard))
    dealt = src.withColumn("shard", F.pmod(F.xxhash64("k"), F.lit(shards)).cast("int")).withColumn(
        "h", F.xxhash64(F.lit("order"), "k")
    )

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        # in order of a hash, so a rerun gives the same: the rule needs items of all sizes in no order
        pdf = pdf.sort_values(["h", "k"], kind="stable").reset_index(drop=True)
        n = pdf["tokens"].to_numpy()
        parts = np.maximum(1, -(-n // capacity))
        rows = np.repeat(np.arange(len(pdf)), parts)
        part = np.arange(len(rows)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = part * capacity
        size = np.minimum(capacity, n[rows] - start)
        box = best_packing(size, capacity)
        shard = pdf["shard"].iloc[0] if len(pdf) else 0
        return pd.DataFrame(
            {
                "k": pdf["k"].to_numpy()[rows],
                "part": part.astype("int32"),
                "token_start": start,
                "tokens": size,
                "container": [f"{shard}-{b}" for b in box],
            }
        )

    # as many partitions as shards: merged by size in bytes, many would be packed one after the other
    out = dealt.repartition(shards, "shard").groupBy("shard").applyInPandas(
        fill, f"k {key_type}, part int, token_start bigint, tokens bigint, container string"
    )
    return out.withColumnRenamed("k", key)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, empty share of the space."""
    boxes = packed.groupBy("container").agg(F.sum("tokens").alias("used"))
    return boxes.agg(
        F.count(F.lit(1)).alias("containers"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.max("used").alias("fullest"),
        F.round(1 - F.sum("used") / (F.count(F.lit(1)) * capacity), 6).alias("unused_share"),
    )
