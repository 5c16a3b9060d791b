"""Entity and passage graph: mentions, edges, vector search, score propagation, personalised PageRank.

Tables: passages (passage_id, text, ...), entities (entity), mentions (passage_id, entity, n), edges
(src, dst, weight). Nulls: null texts mention nothing, null vectors match nothing, edges with a null
end or a weight that is null or not positive are left out. Ties in any ranking go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions.text import content_id, sentences
from lodestream.session import cut_lineage

#: Edges of a node in one part; a node with more is a hub.
HUB = 1_000_000
#: Vectors of queries that are broadcast at a time (64 MB at 1,024 dimensions).
QUERY_BLOCK = 8192


def words(text: str):
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def _phrase(text) -> Column:
    """Words of a text, joined by single blanks."""
    return F.array_join(F.filter(words(text), lambda w: w != ""), " ")


def mention_spans(passages: DataFrame, entities: DataFrame) -> DataFrame:
    """(passage_id, entity, start, end): where entities of one or more words occur, counted in words of the passage.

    An equi-join of the passage's word groups, as long as some entity, with the entities; entities that read alike
    all match. What is collected at plan time is the few lengths that entities have.
    """
    named = entities.select("entity", _phrase("entity").alias("phrase")).filter("phrase <> ''").distinct()
    named = named.withColumn("size", F.size(F.split("phrase", " ")))
    sizes = sorted(r[0] for r in named.select("size").distinct().collect())
    w = passages.select("passage_id", F.filter(words("text"), lambda x: x != "").alias("w"))
    n = F.size("w")

    def groups(size: int) -> Column:
        at = F.sequence(F.lit(0), n - size)
        each = F.transform(at, lambda i: F.struct(i.alias("start"), F.array_join(F.slice("w", i + 1, size), " ").alias("phrase"), F.lit(size).alias("size")))
        return F.when(n >= size, each)

    every = F.flatten(F.array_compact(F.array(*map(groups, sizes)))) if sizes else F.lit(None).cast("array<struct<start:int,phrase:string,size:int>>")
    found = w.select("passage_id", F.inline(every)).join(named, ["phrase", "size"])
    return found.select("passage_id", "entity", "start", (F.col("start") + F.col("size")).alias("end"))


def mentions(passages: DataFrame, entities: DataFrame) -> DataFrame:
    """(passage_id, entity, n): occurrences of entities of one or more words."""
    return mention_spans(passages, entities).groupBy("passage_id", "entity").agg(F.count(F.lit(1)).alias("n"))


def pattern_mentions(passages: DataFrame, pattern: str) -> DataFrame:
    """(passage_id, entity, n): what a pattern finds in the lower-case text, for where there is no list of entities."""
    hit = passages.select("passage_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("entity"))
    return hit.groupBy("passage_id", "entity").agg(F.count(F.lit(1)).alias("n"))


def recognised(passages: DataFrame, entities: DataFrame | None = None, pattern: str | None = None) -> DataFrame:
    """``mentions`` where there are entities, else ``pattern_mentions``; neither is a ValueError."""
    if entities is not None and not entities.isEmpty():
        return mentions(passages, entities)
    if pattern:
        return pattern_mentions(passages, pattern)
    raise ValueError("entities or a pattern are needed")


def merged_mentions(known: DataFrame, new: DataFrame) -> DataFrame:
    """Known mentions and those of passages that have none yet; what is known is never replaced."""
    return known.unionByName(new.join(known.select("passage_id").distinct(), "passage_id", "left_anti"))


def missing_vectors(rows: DataFrame, stored: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, vec) of the rows whose key is not stored, of length one; null and zero vectors are left out."""
    fresh = rows.filter(F.col(vec).isNotNull()).join(stored.select(key), key, "left_anti")
    v = F.transform(vec, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return fresh.select(key, v.alias("v"), norm.alias("norm")).filter("norm > 0").select(key, F.transform("v", lambda x: x / F.col("norm")).alias(vec))


def occurrence_weights(m: DataFrame) -> DataFrame:
    """(passage_id, entity, weight): each entity's share of all mentions in the passage."""
    total = F.sum("n").over(Window.partitionBy("passage_id"))
    return m.select("passage_id", "entity", (F.col("n") / total).alias("weight"))


def adjacent(passages: DataFrame) -> DataFrame:
    """(src, dst, weight): a passage and the next by number, when both exist; an equi-join, no global sort."""
    a = passages.select(F.col("passage_id").alias("src"), (F.col("passage_id") + 1).alias("dst")).distinct()
    return a.join(passages.select(F.col("passage_id").alias("dst")).distinct(), "dst").select("src", "dst", F.lit(1.0).alias("weight"))


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, without self-loops; weights of parallel edges add up."""
    e = edges.filter((F.col("src") != F.col("dst")) & (F.col("weight") > 0))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return e.select("src", "dst", "weight").unionByName(back).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def top_k_vectors(rows: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """rows (id, vec), queries (query_id, vec) -> (query_id, id, similarity, rank): the k nearest by cosine, exactly.

    The queries are worked off in blocks of bounded size: each is broadcast, every task keeps its own k
    best per query, and only those meet in the final ranking.
    """
    r = rows.select("id", "vec").filter("vec is not null")
    q = queries.select("query_id", "vec").filter("vec is not null")
    n_blocks = max(1, -(-q.count() // block))
    q = q.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
    sc = rows.sparkSession.sparkContext
    out = None
    for b in range(n_blocks):
        got = q.filter(F.col("b") == b).orderBy("query_id").collect()
        if not got:
            continue
        ids = [x["query_id"] for x in got]
        shared = sc.broadcast((ids, _unit(np.array([x["vec"] for x in got], dtype=np.float64))))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, qv = shared.value
            best_s = best_i = None
            for pdf in batches:
                if not len(pdf):
                    continue
                s = np.round(qv @ _unit(np.stack(pdf["vec"].to_numpy()).astype(np.float64)).T, 9)
                i = np.broadcast_to(pdf["id"].to_numpy()[None, :], s.shape)
                if best_s is not None:
                    s, i = np.concatenate([best_s, s], 1), np.concatenate([best_i, i], 1)
                order = np.lexsort((i, -s), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            if best_s is not None:
                m = best_s.shape[1]
                yield pd.DataFrame({"query_id": np.repeat(ids, m), "id": best_i.ravel(), "similarity": best_s.ravel()})

        part = r.mapInPandas(run, "query_id bigint, id bigint, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, id bigint, similarity double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def containment_rank(queries: DataFrame, passages: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, passage_id, score, rank): share of a query's words that a passage has, best k with any.

    queries (query_id, words), passages (passage_id, words), both with lists. Queries are broadcast in blocks, each
    passage is read where it lies, and only k passages per query and partition are shuffled: a word that
    half of both sides have costs no pairs.
    """
    q = queries.select("query_id", F.array_distinct("words").alias("words")).filter(F.size("words") > 0)
    p = passages.select("passage_id", F.array_distinct("words").alias("words"))
    qt, pt = (x.schema[c].dataType.simpleString() for x, c in ((q, "query_id"), (p, "passage_id")))
    n_blocks = max(1, -(-q.count() // block))
    q = q.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
    out = None
    for b in range(n_blocks):
        got = q.filter(F.col("b") == b).orderBy("query_id").collect()
        where: dict[str, list[int]] = {}
        for i, r in enumerate(got):
            for w in r["words"]:
                where.setdefault(w, []).append(i)
        shared = q.sparkSession.sparkContext.broadcast(
            ([r["query_id"] for r in got], np.array([len(r["words"]) for r in got], float), {w: np.array(v) for w, v in where.items()})
        )

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, sizes, where = shared.value
            best = np.empty((len(ids), 0)), np.empty((len(ids), 0), object)
            for pdf in batches:
                for at in range(0, len(pdf), 256):
                    part = pdf.iloc[at : at + 256]
                    shares = np.zeros((len(ids), len(part)))
                    for c, ws in enumerate(part["words"]):
                        hits = [where[w] for w in ws if w in where]
                        if hits:
                            shares[:, c] = np.bincount(np.concatenate(hits), minlength=len(ids))
                    s = np.concatenate([best[0], np.round(shares / sizes[:, None], 6)], 1)
                    i = np.concatenate([best[1], np.broadcast_to(part["passage_id"].to_numpy(object)[None, :], shares.shape)], 1)
                    order = np.lexsort((i, -s), axis=1)[:, :k]
                    best = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            m = best[0].shape[1]
            frame = pd.DataFrame({"query_id": np.repeat(np.array(ids, object), m), "passage_id": best[1].ravel(), "score": best[0].ravel()})
            yield frame[frame["score"] > 0]

        one = p.mapInPandas(run, f"query_id {qt}, passage_id {pt}, score double")
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "passage_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def spread(seeds: DataFrame, weights: DataFrame, hops: int, threshold: float, top_passages: int = 3) -> DataFrame:
    """Score propagation entity -> its best passages -> their other entities: (entity, score, tier).

    seeds (entity, score); weights (passage_id, entity, weight). In each hop an entity activates its
    ``top_passages`` heaviest passages; what reaches an entity adds up; less than ``threshold`` is cut.
    An entity keeps the tier in which it was first reached. The best passages of all entities are
    worked out once.
    """
    w = Window.partitionBy("entity").orderBy(F.desc("weight"), "passage_id")
    best = weights.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top_passages).select("passage_id", F.col("entity").alias("from"), F.col("weight").alias("w1"))
    pairs = best.join(weights, "passage_id").filter(F.col("from") != F.col("entity"))
    step = cut_lineage(pairs.groupBy("from", "entity").agg(F.sum(F.col("w1") * F.col("weight")).alias("w")))
    active = seeds.select("entity", "score").withColumn("tier", F.lit(0))
    reached = active
    for hop in range(1, hops + 1):
        nxt = (
            active.select(F.col("entity").alias("from"), "score")
            .join(step, "from")
            .groupBy("entity")
            .agg(F.sum(F.col("score") * F.col("w")).alias("score"))
            .filter(F.col("score") >= threshold)
            .withColumn("tier", F.lit(hop))
        )
        active = nxt if hop % 3 else cut_lineage(nxt)
        reached = reached.unionByName(active)
    return reached.groupBy("entity").agg(F.sum("score").alias("score"), F.min("tier").alias("tier"))


def sentence_mentions(passages: DataFrame, entities: DataFrame) -> DataFrame:
    """(sentence_id, entity), each pair once: which sentences name which entities.

    Sentences with the same text are one, by their content id.
    """
    s = passages.select(F.explode(sentences(F.col("text"))).alias("text")).distinct().select(content_id("sentence-", F.col("text")).alias("passage_id"), "text")
    return mentions(s, entities).select(F.col("passage_id").alias("sentence_id"), "entity")


def spread_sentences(seeds: DataFrame, incidence: DataFrame, similarity: DataFrame, hops: int, threshold: float, top_sentences: int = 3) -> DataFrame:
    """Score propagation entity -> its best unused sentences -> their entities: (entity, score, tier).

    seeds (entity, score); incidence (sentence_id, entity); similarity (sentence_id, similarity) to the query.
    In each hop every entity of at least ``threshold`` selects its ``top_sentences`` most similar sentences
    that no earlier hop selected. A selected sentence carries the sum of all active scores of its entities,
    times its similarity, if that is positive, to each of them, and is used up. score is the sum of all that
    reached an entity, its seed included; tier the last hop in which it was active, null if it never was.
    """
    inc = cut_lineage(incidence.select("sentence_id", "entity").distinct().join(similarity.filter("similarity is not null"), "sentence_id"))
    active = seeds.select("entity", "score")
    total = active.withColumn("tier", F.lit(0))
    used = None
    for hop in range(1, hops + 1):
        live = inc.join(active.filter((F.col("score") >= threshold) & (F.col("score") > 0)), "entity")
        if used is not None:
            live = live.join(used, "sentence_id", "left_anti")
        w = Window.partitionBy("entity").orderBy(F.desc("similarity"), "sentence_id")
        ranked = live.withColumn("r", F.row_number().over(w))
        picked = cut_lineage(
            ranked.groupBy("sentence_id", "similarity").agg(F.sum("score").alias("s"), F.min("r").alias("r")).filter(F.col("r") <= top_sentences)
            .select("sentence_id", (F.col("s") * F.col("similarity")).alias("s"))
        )
        ids = picked.select("sentence_id")
        used = ids if used is None else used.unionByName(ids)
        active = cut_lineage(picked.filter("s > 0").join(inc, "sentence_id").groupBy("entity").agg(F.sum("s").alias("score")))
        total = total.unionByName(active.withColumn("tier", F.when(F.col("score") >= threshold, F.lit(hop))))
    return total.groupBy("entity").agg(F.sum("score").alias("score"), F.max("tier").alias("tier"))


def passage_scores(m: DataFrame, activated: DataFrame, dense: DataFrame, ratio: float = 2.0) -> DataFrame:
    """(passage_id, score): ratio * scaled dense score + ln(1 + sum of score * ln(1 + n) / tier)."""
    bonus = m.join(activated, "entity").groupBy("passage_id").agg(
        F.sum(F.col("score") * F.log1p(F.col("n").cast("double")) / F.greatest(F.col("tier"), F.lit(1))).alias("bonus")
    )
    lo, hi = dense.agg(F.min("similarity"), F.max("similarity")).first()
    scaled = F.lit(1.0) if lo == hi else (F.col("similarity") - F.lit(lo)) / F.lit(None if lo is None else hi - lo)
    d = dense.select("passage_id", scaled.alias("scaled"))
    j = d.join(bonus, "passage_id", "full")
    return j.select("passage_id", (ratio * F.coalesce(F.col("scaled"), F.lit(0.0)) + F.log1p(F.coalesce(F.col("bonus"), F.lit(0.0)))).alias("score"))


def personalised_pagerank(edges: DataFrame, reset: DataFrame, damping: float = 0.5, iterations: int = 25, cut_every: int = 5) -> DataFrame:
    """(node, rank) for undirected weighted edges and reset weights (node, weight), one row per node.

    Power iteration; each step halves what is left at damping 0.5. Nodes without edges hand their rank
    back to the reset nodes. Null or negative reset weights count as 0; no positive weight: ValueError.
    Lineage is cut every few steps by checkpoint, which survives lost executors.
    """
    e = undirected(edges)
    out_sum = e.groupBy("src").agg(F.sum("weight").alias("s"), F.ceil(F.count(F.lit(1)) / F.lit(HUB)).cast("int").alias("copies"))
    step = cut_lineage(
        e.join(out_sum, "src").select("src", "dst", (F.col("weight") / F.col("s")).alias("p"), "copies", F.pmod(F.xxhash64("dst"), F.col("copies")).cast("int").alias("copy"))
    )
    # nodes with very many edges: at most twice the edges divided by HUB, so they are few, and their edges lie in several parts
    hubs = cut_lineage(step.filter("copies > 1").select(F.col("src").alias("node"), "copies").distinct())
    has_hubs = not hubs.isEmpty()
    good = reset.filter("node is not null and weight > 0 and not isnan(cast(weight as double))").groupBy("node").agg(F.sum("weight").alias("weight"))
    total = good.agg(F.sum("weight")).first()[0]
    if not total:
        raise ValueError("no node has a positive reset weight")
    start = good.select("node", (F.col("weight") / F.lit(float(total))).alias("r"))
    has_out = step.select(F.col("src").alias("node")).distinct()
    start = cut_lineage(start.join(has_out.withColumn("o", F.lit(True)), "node", "left").select("node", "r", F.col("o").isNull().alias("dangling")))
    # only reset nodes can be without edges and hold rank, so what comes back is a sum over them
    rank = start.select("node", F.col("r").alias("rank"))
    any_dangling = start.filter("dangling").limit(1).count() > 0
    for i in range(1, iterations + 1):
        back = 0.0
        if any_dangling:
            back = rank.join(start.filter("dangling").select("node"), "node").agg(F.sum("rank")).first()[0] or 0.0
        told = rank
        if has_hubs:
            n = F.coalesce("copies", F.lit(1))
            told = rank.join(F.broadcast(hubs), "node", "left").select("node", "rank", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
            meets = (told["node"] == step["src"]) & (told["part"] == step["copy"])
        else:
            meets = told["node"] == step["src"]
        flow = (
            told.join(step, meets)
            .groupBy(F.col("dst").alias("node"))
            .agg((F.sum(F.col("rank") * F.col("p")) * damping).alias("rank"))
        )
        home = start.select("node", (F.col("r") * ((1 - damping) + damping * back)).alias("rank"))
        rank = flow.unionByName(home).groupBy("node").agg(F.sum("rank").alias("rank"))
        if i % cut_every == 0:
            rank = cut_lineage(rank)
    return rank


def synonym_table(names: DataFrame, name: str, synonyms: str, order: str) -> DataFrame:
    """(canonical, synonym): each name stands for itself and for the parts of its joined synonyms; the last by order wins."""
    parts = F.array_union(F.array(F.lower(F.trim(name))), F.transform(F.split(F.coalesce(F.col(synonyms), F.lit("")), r"\|"), lambda x: F.lower(F.trim(x))))
    rows = names.filter(F.trim(name) != "").select(F.col(order).alias("o"), F.lower(F.trim(name)).alias("canonical"), F.explode(parts).alias("synonym")).filter("synonym <> ''")
    return rows.groupBy("synonym").agg(F.max_by("canonical", F.struct("o", "canonical")).alias("canonical")).select("canonical", "synonym")


def normalised(names: DataFrame, col: str, synonyms: DataFrame) -> DataFrame:
    """The rows with ``canonical``: the name that a name stands for, or the name as it is where none is known."""
    known = synonyms.select(F.col("canonical").alias("__canonical"), F.col("synonym").alias("__synonym"))
    j = names.join(known, F.lower(F.trim(col)) == F.col("__synonym"), "left")
    return j.withColumn("canonical", F.coalesce("__canonical", col)).drop("__canonical", "__synonym")


def expand(entities: DataFrame, synonyms: DataFrame, at_most: int = 5) -> DataFrame:
    """(query_id, entity) plus up to ``at_most`` synonyms of each entity's canonical name."""
    e = entities.select("query_id", F.lower("entity").alias("synonym"))
    canon = e.join(synonyms, "synonym")
    w = Window.partitionBy("query_id", "canonical").orderBy("entity")
    more = (
        canon.select("query_id", "canonical").distinct()
        .join(synonyms.select("canonical", F.col("synonym").alias("entity")), "canonical")
        .withColumn("r", F.row_number().over(w)).filter(F.col("r") <= at_most)
    )
    return e.select("query_id", F.col("synonym").alias("entity")).unionByName(more.select("query_id", "entity")).distinct()


def retrieve(passages: DataFrame, m: DataFrame, query_entities: DataFrame, k: int, sources: list[str] | None = None, before: str | None = None, day=None) -> DataFrame:
    """(query_id, passage_id, score, rank): entity overlap, filtered by source and date before anything is ranked."""
    p = passages
    if sources:
        p = p.filter(F.col("source").isin(*sources))
    if before:
        p = p.filter(day.isNotNull() & (day < F.lit(before).cast("date")))
    # a passage names at most as many entities as it has words, a query as many as its text
    held = m.join(p.select("passage_id"), "passage_id", "left_semi").groupBy("passage_id").agg(F.collect_set("entity").alias("words"))
    asked = query_entities.groupBy("query_id").agg(F.collect_set("entity").alias("words"))
    return containment_rank(asked, held, k)


def graph_edges(passages: DataFrame, m: DataFrame) -> DataFrame:
    """(src, dst, weight): passages and their entities by share of mentions, passages and the next by 1; passages are 'p' and their id."""
    node = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    own = occurrence_weights(m).select(node("passage_id").alias("src"), F.concat(F.lit("e"), "entity").alias("dst"), "weight")
    near = adjacent(passages).select(node("src").alias("src"), node("dst").alias("dst"), "weight")
    return own.unionByName(near)


def search(
    seeds: DataFrame,
    incidence: DataFrame,
    similarity: DataFrame,
    m: DataFrame,
    dense: DataFrame,
    edges: DataFrame,
    k: int = 10,
    hops: int = 3,
    threshold: float = 0.4,
    top_sentences: int = 3,
    ratio: float = 2.0,
    node_weight: float = 0.05,
    damping: float = 0.5,
    iterations: int = 25,
) -> DataFrame:
    """(passage_id, score, rank) of the best k passages for one question, by spread, scores and PageRank.

    seeds (entity, score): the entities of the question, see ``top_k_vectors``; similarity (sentence_id, similarity)
    and dense (passage_id, similarity) to the question; incidence, m and edges as built by ``sentence_mentions``,
    ``mentions`` and ``graph_edges``. Scores spread from the seeds over sentences; passages are scored by
    similarity and active entities; both, passages times ``node_weight``, are what PageRank returns to. Passages
    alone are ranked; ties go to the smaller id. Without seeds the nearest passages come out.
    """
    if seeds.isEmpty():
        ranked = dense.filter("similarity is not null").select("passage_id", F.col("similarity").alias("score")).orderBy(F.desc("score"), "passage_id").limit(k)
    else:
        reached = cut_lineage(spread_sentences(seeds, incidence, similarity, hops, threshold, top_sentences))
        active = reached.filter("tier is not null")
        passages = passage_scores(m, active, dense, ratio)
        reset = reached.filter("score > 0").select(F.concat(F.lit("e"), "entity").alias("node"), F.col("score").alias("weight")).unionByName(
            passages.select(F.concat(F.lit("p"), F.col("passage_id").cast("string")).alias("node"), (F.col("score") * node_weight).alias("weight"))
        )
        rank = personalised_pagerank(edges, reset, damping, iterations)
        found = rank.filter(F.col("node").startswith("p")).select(F.substring("node", 2, 100).cast("bigint").alias("passage_id"), F.round("rank", 12).alias("score"))
        ranked = found.orderBy(F.desc("score"), "passage_id").limit(k)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "passage_id")))  # k rows


def build_index(passages: DataFrame, entities: DataFrame, folder: str) -> None:
    """Writes the tables of an index below a folder: passages, mentions, sentences, edges.

    Passages need passage_id and text, else ValueError; a missing date is null.
    """
    lacks = {"passage_id", "text"} - set(passages.columns)
    if lacks:
        raise ValueError(f"passages lack {', '.join(sorted(lacks))}")
    p = passages if "date" in passages.columns else passages.withColumn("date", F.lit(None).cast("string"))
    p.write.mode("overwrite").parquet(f"{folder}/passages")
    p = passages.sparkSession.read.parquet(f"{folder}/passages")
    mentions(p, entities).write.mode("overwrite").parquet(f"{folder}/mentions")
    sentence_mentions(p, entities).write.mode("overwrite").parquet(f"{folder}/sentences")
    m = passages.sparkSession.read.parquet(f"{folder}/mentions")
    graph_edges(p, m).write.mode("overwrite").parquet(f"{folder}/edges")


def load_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{folder}/{t}") for t in ("passages", "mentions", "sentences", "edges")}
