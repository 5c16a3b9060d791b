"""Queries of the entity and passage graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.dates import iso_day
from lodestream.operators import graph as G
from lodestream.operators import records as X
from lodestream.session import cut_lineage
from lodestream.streaming.jobs import scratch
from lodestream.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "molecules").filter("pref_name <> ''").select(F.lower("pref_name").alias("entity"))


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return G.mentions(table(spark, d, "passages").select("passage_id", "text"), _entities(spark, d))


_MENTIONS = """
with m as (select passage_id, w as entity, count(*)::bigint as n from (
  select passage_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as w from passages)
  where w in (select lower(pref_name) from molecules) group by 1, 2)
"""


@query(_MENTIONS + "select passage_id, entity, n from m")
def mention_table(spark: SparkSession, d: str) -> DataFrame:
    """GR-03, GR-05, JN-08: entities that passages name."""
    return _mentions(spark, d)


@query(_MENTIONS + "select passage_id, entity, round(n / sum(n) over (partition by passage_id), 6) as weight from m")
def mention_weights(spark: SparkSession, d: str) -> DataFrame:
    """GR-06."""
    return G.occurrence_weights(_mentions(spark, d)).withColumn("weight", F.round("weight", 6))


@query("select a.passage_id as src, b.passage_id as dst, 1.0::double as weight from passages a join passages b on b.passage_id = a.passage_id + 1")
def adjacent_passages(spark: SparkSession, d: str) -> DataFrame:
    """GR-07, WIN-02."""
    return G.adjacent(table(spark, d, "passages"))


@query(_MENTIONS + """
, e as (select entity as src, 'p' || passage_id as dst, n::double as weight from m), b as (select src, dst, weight from e union all select dst, src, weight from e)
select src, count(*)::bigint as degree, round(sum(weight), 6) as strength from (select src, dst, sum(weight) as weight from b group by 1, 2) group by 1""")
def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    """GR-08, SNK-04: undirected edges and the degree of each node."""
    e = _mentions(spark, d).select(F.col("entity").alias("src"), F.concat(F.lit("p"), F.col("passage_id").cast("string")).alias("dst"), F.col("n").cast("double").alias("weight"))
    return G.undirected(e).groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.round(F.sum("weight"), 6).alias("strength"))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings")
    rows = v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    queries = v.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return rows, queries


_DENSE = """
with s as (select q.vec_id as query_id, r.vec_id as id, round(list_cosine_similarity(q.embedding::double[], r.embedding::double[]), 9) as similarity, r.label, q.label as qlabel
  from embeddings q, embeddings r where q.vec_id % 100 = 0),
t as (select *, row_number() over (partition by query_id order by similarity desc, id)::int as rank from s)
"""


@query(_DENSE + "select query_id, id, round(similarity, 5) as similarity, rank from t where rank <= 10")
def dense_top_k(spark: SparkSession, d: str) -> DataFrame:
    """GR-09, MTH-03, SRT-01: exact cosine search of every hundredth vector against all."""
    rows, queries = _vectors(spark, d)
    return G.top_k_vectors(rows, queries, 10).withColumn("similarity", F.round("similarity", 5))


@query(_DENSE + "select query_id, id as entity, round(similarity, 5) as similarity from (select *, row_number() over (partition by query_id order by similarity desc, id) as r from s where id <> query_id) where r = 1")
def seed_links(spark: SparkSession, d: str) -> DataFrame:
    """GR-10, SRT-03: the nearest other vector of each query."""
    rows, queries = _vectors(spark, d)
    near = G.top_k_vectors(rows, queries, 2).filter("id <> query_id")
    best = near.groupBy("query_id").agg(F.min_by("id", "rank").alias("entity"), F.min_by("similarity", "rank").alias("similarity"))
    return best.withColumn("similarity", F.round("similarity", 5))


@query(_DENSE + """
, j as (select t.query_id, t.rank, (t.label = t.qlabel)::int as rel from t where t.rank between 2 and 11),
n as (select vec_id as query_id, (select count(*) from embeddings e where e.label = q.label) - 1 as relevant from embeddings q where vec_id % 100 = 0)
select round(avg(rr), 6) as mrr, round(avg(recall), 6) as recall_10, round(avg(ndcg), 6) as ndcg_10 from (
  select n.query_id, coalesce(1.0 / min(rank - 1) filter (where rel = 1), 0) as rr, coalesce(sum(rel) / nullif(max(relevant), 0), 0) as recall,
    coalesce(sum(rel / log2(rank)) / nullif((select sum(1 / log2(i + 1)) from range(1, 11) r(i) where i <= max(n.relevant)), 0), 0) as ndcg
  from n join j using (query_id) group by 1)""")
def ranking_quality(spark: SparkSession, d: str) -> DataFrame:
    """EV-08, WIN-09: MRR, recall and NDCG of vector search, where the same label is relevant."""
    from lodestream.operators import evaluation as E

    rows, queries = _vectors(spark, d)
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    found = G.top_k_vectors(rows, queries, 11).filter("id <> query_id or rank > 1").filter("rank > 1")
    j = found.join(labels, "id").join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    judged = j.select("query_id", (F.col("rank") - 1).alias("rank"), (F.col("label") == F.col("ql")).cast("int").alias("relevance"))
    per = labels.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("relevant"))
    relevant = queries.select("query_id").join(labels.withColumnRenamed("id", "query_id"), "query_id").join(per, "label").select("query_id", "relevant")
    return E.ranking_metrics(judged, relevant, 10)


_WORDS = """
with q as (select item_id as query_id, w as word from (select item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as w from eval_items where item_id % 100 = 0) group by all),
p as (select passage_id, w as word from (select passage_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as w from passages) group by all),
sz as (select query_id, count(*) as size from q group by 1),
s as (select query_id, passage_id, round(count(*) / max(size), 6) as score from q join p using (word) join sz using (query_id) group by 1, 2)
select * from (select query_id, passage_id, score, row_number() over (partition by query_id order by score desc, passage_id)::int as rank from s) where rank <= 10"""


@query(_WORDS)
def containment_ranking(spark: SparkSession, d: str) -> DataFrame:
    """GR-22, JN-13, ARR-03: passages by the share of a query's words that they have."""
    w = F.filter(G.words("text"), lambda x: x != "").alias("words")
    q = table(spark, d, "eval_items").filter(F.col("item_id") % 100 == 0).select(F.col("item_id").alias("query_id"), w)
    return G.containment_rank(q, table(spark, d, "passages").select("passage_id", w), 10)


@query(_MENTIONS + """
, w as (select passage_id, entity, n / sum(n) over (partition by passage_id) as weight from m),
b as (select passage_id, entity as f, weight as w1 from (select *, row_number() over (partition by entity order by weight desc, passage_id) as r from w) where r <= 50),
st as (select f, w.entity, sum(w1 * weight) as w from b join w using (passage_id) where f <> w.entity group by 1, 2),
t0 as (select min(entity) as entity, 1.0 as score, 0 as tier from m),
t1 as (select st.entity, sum(score * w) as score, 1 as tier from t0 join st on f = t0.entity group by 1 having sum(score * w) >= 0.01),
t2 as (select st.entity, sum(score * w) as score, 2 as tier from t1 join st on f = t1.entity group by 1 having sum(score * w) >= 0.01)
select entity, round(sum(score), 5) as score, min(tier)::int as tier from (select * from t0 union all select * from t1 union all select * from t2) group by 1""")
def two_hop_spread(spark: SparkSession, d: str) -> DataFrame:
    """Scores carried from entity to whole passages to entities, twice, by mention shares; sentence_spread has GR-11."""
    m = _mentions(spark, d)
    seed = m.agg(F.min("entity").alias("entity")).withColumn("score", F.lit(1.0))
    return G.spread(seed, G.occurrence_weights(m), 2, 0.01, top_passages=50).withColumn("score", F.round("score", 5))


def _sentence_mentions(spark: SparkSession, d: str) -> DataFrame:
    return G.sentence_mentions(table(spark, d, "passages").select("text"), _entities(spark, d))


_INCIDENCE = _MENTIONS + """
, raw as (select list_filter(list_transform(string_split_regex(regexp_replace(trim(text, ' '), '([.!?])[ \\t\\n\\v\\f\\r]+', '\\1' || chr(1), 'g'), chr(1) || '+|\\n+'),
  lambda x: trim(x, ' ')), lambda x: length(x) >= 10) as s from passages where text is not null),
inc as materialized (select distinct 'sentence-' || md5(text) as sentence_id, w as entity from (
  select text, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as w from (select distinct unnest(s) as text from raw)) where w in (select lower(pref_name) from molecules)),
sim as materialized (select sentence_id, 1.0 / (1 + count(*)) as similarity from inc group by 1)
"""


def _spread_sql(seeds: str, hops: int, threshold: float, top: int) -> str:
    """Further tables a0..., p1... of scores carried over unused sentences; ``reached`` sums them up."""
    out, used = f", a0 as materialized ({seeds})", "select null"
    for h in range(1, hops + 1):
        out += f"""
, l{h} as (select i.sentence_id, s.similarity, a.score, row_number() over (partition by i.entity order by s.similarity desc, i.sentence_id) as r
  from inc i join sim s using (sentence_id) join a{h - 1} a using (entity) where a.score >= {threshold} and a.score > 0 and i.sentence_id not in (select sentence_id from ({used}) u(sentence_id) where sentence_id is not null)),
p{h} as materialized (select sentence_id, sum(score) * any_value(similarity) as s from l{h} group by 1 having min(r) <= {top}),
a{h} as materialized (select entity, sum(s) as score from p{h} join inc using (sentence_id) where s > 0 group by 1)"""
        used += f" union all select sentence_id from p{h}"
    every = " union all ".join(f"select entity, score, case when {h} = 0 or score >= {threshold} then {h} end as tier from a{h}" for h in range(hops + 1))
    return out + f"\n, reached as materialized (select entity, sum(score) as score, max(tier) as tier from ({every}) group by 1)"


@query(_INCIDENCE + "select sentence_id, entity from inc")
def sentence_mentions(spark: SparkSession, d: str) -> DataFrame:
    """GR-26: which sentences name which entities."""
    return _sentence_mentions(spark, d)


def _similarities(m: DataFrame) -> DataFrame:
    """A stand-in for a model's similarity to a question: 1 / (1 + entities of the sentence)."""
    return m.groupBy("sentence_id").agg((1 / (1 + F.count("*"))).alias("similarity"))


@query(_INCIDENCE + _spread_sql("select min(entity) as entity, 1.0::double as score from inc", 2, 0.01, 50) + " select entity, round(score, 5) as score, tier::int as tier from reached")
def sentence_spread(spark: SparkSession, d: str) -> DataFrame:
    """GR-11, GR-12, WIN-03, WIN-13: scores carried from entity to unused sentences to entities, twice."""
    m = cut_lineage(_sentence_mentions(spark, d))
    seed = m.agg(F.min("entity").alias("entity")).withColumn("score", F.lit(1.0))
    return G.spread_sentences(seed, m, _similarities(m), 2, 0.01, top_sentences=50).withColumn("score", F.round("score", 5))


_SEEDS = "select min(entity) as entity, 1.0::double as score from m union all select max(entity), 0.8 from m"
_SEARCH = (
    _INCIDENCE
    + _spread_sql(_SEEDS, 2, 0.01, 20)
    + """
, dn as (select passage_id, score as similarity from passages where score is not null),
bo as (select passage_id, sum(ln(1 + n) * score / greatest(tier, 1)) as bonus from m join reached using (entity) where tier is not null group by 1),
ps as (select passage_id, 2.0 * coalesce((similarity - lo) / (hi - lo), 0) + ln(1 + coalesce(bonus, 0)) as score from (select * from dn full join bo using (passage_id)), (select min(similarity) as lo, max(similarity) as hi from dn)),
w0 as (select 'e' || entity as node, score as w from reached where score > 0 union all select 'p' || passage_id, score * 0.05 from ps where score > 0),
r0 as materialized (select node, sum(w) / (select sum(w) from w0) as r from w0 group by 1),
ed as (select 'p' || passage_id as a, 'e' || entity as b, n / sum(n) over (partition by passage_id) as w from m
  union all select 'p' || a.passage_id, 'p' || b.passage_id, 1.0 from passages a join passages b on b.passage_id = a.passage_id + 1),
un as (select src, dst, sum(w) as w from (select a as src, b as dst, w from ed union all select b, a, w from ed) group by 1, 2),
st as materialized (select src, dst, w / sum(w) over (partition by src) as p from un),
dg as materialized (select node from r0 where node not in (select src from st))"""
    + "".join(
        f""", r{i} as materialized (select node, sum(r) as r from (select dst as node, r * p * 0.5 as r from r{i - 1} join st on node = src
  union all select node, r * (0.5 + 0.5 * (select coalesce(sum(r), 0) from r{i - 1} where node in (select node from dg))) from r0) group by 1)"""
        for i in range(1, 9)
    )
    + """, f as (select substr(node, 2)::bigint as passage_id, round(r, 12) as score from r8 where node[1] = 'p')
select passage_id, round(score, 9) as score, row_number() over (order by score desc, passage_id)::int as rank from f order by f.score desc, passage_id limit 25"""
)


@query(_SEARCH)
def graph_search(spark: SparkSession, d: str) -> DataFrame:
    """GR-10, GR-13, GR-14, GR-15: from a question's entities to ranked passages, by spread, passage scores and PageRank."""
    p = table(spark, d, "passages")
    m = cut_lineage(_mentions(spark, d))
    inc = cut_lineage(_sentence_mentions(spark, d))
    seeds = m.agg(F.min("entity").alias("entity")).withColumn("score", F.lit(1.0)).unionByName(m.agg(F.max("entity").alias("entity")).withColumn("score", F.lit(0.8)))
    dense = p.filter("score is not null").select("passage_id", F.col("score").alias("similarity"))
    found = G.search(seeds, inc, _similarities(inc), m, dense, G.graph_edges(p, m), 25, 2, 0.01, 20, iterations=8)
    return found.withColumn("score", F.round("score", 9))


@query("select passage_id, score, row_number() over (order by score desc, passage_id)::int as rank from passages where score is not null order by passages.score desc, passage_id limit 25")
def search_without_entities(spark: SparkSession, d: str) -> DataFrame:
    """GR-10, GR-15: without entities in the question the nearest passages come out."""
    none = spark.createDataFrame([], "entity string, score double")
    dense = table(spark, d, "passages").select("passage_id", F.col("score").alias("similarity"))
    return G.search(none, none, none, none, dense, none, 25)


_PHRASES = """
with w as (select passage_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from passages where text is not null),
c as (select distinct trim(unnest(string_split(conditions, '|'))) as entity from ctg_trials),
dict as (select entity, regexp_extract_all(lower(entity), '[\\p{L}\\p{N}]+') as k from c where len(regexp_extract_all(lower(entity), '[\\p{L}\\p{N}]+')) > 0),
g as (select passage_id, n, w, unnest(range(greatest(len(w) - n + 1, 0))) as i from w, (select distinct len(k) as n from dict)),
spans as (select g.passage_id, dict.entity, g.i as s, g.i + g.n as e from g join dict on len(dict.k) = g.n and dict.k = w[i + 1:i + n])
"""


def _conditions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ctg_trials").select(F.explode(F.split("conditions", r"\|")).alias("c")).select(F.trim("c").alias("entity"))


@query(_PHRASES + "select passage_id, entity, count(*)::bigint as n from spans group by 1, 2")
def phrase_mentions(spark: SparkSession, d: str) -> DataFrame:
    """GR-03, GR-05, JN-08: entities of several words that passages name."""
    return G.mentions(table(spark, d, "passages").select("passage_id", "text"), _conditions(spark, d))


@query(_PHRASES + """select passage_id, entity, s as start, e as "end" from spans""")
def phrase_spans(spark: SparkSession, d: str) -> DataFrame:
    """GR-04: where they stand, counted in words of the whole passage."""
    s = G.mention_spans(table(spark, d, "passages").select("passage_id", "text"), _conditions(spark, d))
    return s.select("passage_id", "entity", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@query("""select passage_id, w as entity, count(*)::bigint as n from (select passage_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}(?:mab|nib|statin|sartan)')) as w from passages) group by 1, 2""")
def pattern_mentions(spark: SparkSession, d: str) -> DataFrame:
    """GR-27: a pattern stands in where there is no list of entities."""
    none = spark.createDataFrame([], "entity string")
    return G.recognised(table(spark, d, "passages").select("passage_id", "text"), none, "[a-z]{4,}(?:mab|nib|statin|sartan)")


@query(_MENTIONS + "select passage_id, entity, n from m")
def merged_mentions(spark: SparkSession, d: str) -> DataFrame:
    """GR-02, GR-25: mentions of new passages added to stored ones; what is stored stays."""
    path = scratch(spark, "mentions")
    m = _mentions(spark, d)
    m.filter("passage_id % 3 = 0").write.parquet(path)
    known = spark.read.parquet(path)
    return G.merged_mentions(known, m.withColumn("n", F.when(F.col("passage_id") % 3 == 0, -1).otherwise(F.col("n"))))


@query("""select vec_id, round(embedding[1] / sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as first,
  round(embedding[-1] / sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as last from embeddings where vec_id % 2 = 1""")
def normalised_vectors(spark: SparkSession, d: str) -> DataFrame:
    """GR-01: only ids that are not stored yet, with vectors of length one."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    fresh = G.missing_vectors(v, v.filter("vec_id % 2 = 0"), "vec_id", "embedding")
    return fresh.select("vec_id", F.round(F.element_at("embedding", 1), 6).alias("first"), F.round(F.element_at("embedding", -1), 6).alias("last"))


@query(_MENTIONS + """select 'edges' as name, ((select count(*) from m) + (select count(*) from passages a join passages b on b.passage_id = a.passage_id + 1))::bigint as n
union all select 'mentions', count(*)::bigint from m union all select 'passages', count(*)::bigint from passages""")
def stored_index(spark: SparkSession, d: str) -> DataFrame:
    """GR-28: an index built, written and read again."""
    folder = scratch(spark, "index")
    G.build_index(table(spark, d, "passages").select("passage_id", "text"), _entities(spark, d), folder)
    parts = G.load_index(spark, folder)
    out = [parts[t].select(F.lit(t).alias("name")) for t in ("edges", "mentions", "passages")]
    return out[0].unionByName(out[1]).unionByName(out[2]).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def _ppr_sql(steps: int) -> str:
    its = "".join(
        f""", r{i} as materialized (select node, sum(r) as r from (
  select dst as node, r * p * 0.5 as r from r{i - 1} join st on node = src union all select node, 0.5 as r from r0) group by 1)"""
        for i in range(1, steps + 1)
    )
    return f"""{_MENTIONS}
, e as (select entity as a, 'p' || passage_id as b, n::double as w from m),
u as (select src, dst, sum(w) as w from (select a as src, b as dst, w from e union all select b, a, w from e) group by 1, 2),
st as materialized (select src, dst, w / sum(w) over (partition by src) as p from u),
r0 as materialized (select min(entity) as node, 1.0::double as r from m){its}
select node, round(r, 5) as rank from r{steps}"""


@query(_ppr_sql(12))
def personalised_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """GR-14: rank flows from one entity over the passage and entity graph, twelve steps."""
    m = _mentions(spark, d)
    e = m.select(F.col("entity").alias("src"), F.concat(F.lit("p"), F.col("passage_id").cast("string")).alias("dst"), F.col("n").cast("double").alias("weight"))
    seed = m.agg(F.min("entity").alias("node")).withColumn("weight", F.lit(1.0))
    return G.personalised_pagerank(e, seed, 0.5, 12).withColumn("rank", F.round("rank", 5))


@query(_MENTIONS + """
, p as (select passage_id from passages where source in ('ctg', 'pubmed', 'chembl') and regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}') and try_cast(left(date, 10) as date) < date '2016-01-01'),
q as (select doc_id as query_id, w as entity from (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as w from documents where doc_id % 100 = 0) where w in (select lower(pref_name) from molecules) group by all),
sz as (select query_id, count(*) as size from q group by 1),
s as (select query_id, passage_id, round(count(*) / max(size), 6) as score from q join m using (entity) join p using (passage_id) join sz using (query_id) group by 1, 2)
select * from (select query_id, passage_id, score, row_number() over (partition by query_id order by score desc, passage_id)::int as rank from s) where rank <= 10""")
def evidence_search(spark: SparkSession, d: str) -> DataFrame:
    """GR-15, GR-16, GR-20, JN-15: search bound by source and date, filtered before it is ranked."""
    docs = table(spark, d, "documents").filter(F.col("doc_id") % 100 == 0)
    qs = docs.select(F.col("doc_id").alias("query_id"), F.explode(G.words("text")).alias("entity"))
    qe = qs.join(_entities(spark, d).distinct(), "entity", "left_semi").distinct()
    return G.retrieve(table(spark, d, "passages"), _mentions(spark, d), qe, 10, ["ctg", "pubmed", "chembl"], "2016-01-01", iso_day("date"))


_SOURCES = ["ctg", "pubmed", "faers", "aact", "chembl", "primekg", "drugsfda"]


@query(_MENTIONS + """
, p as (select passage_id, source from passages where regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}') and try_cast(left(date, 10) as date) < date '2019-01-01'),
q as (select doc_id as query_id, w as entity from (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as w from documents where doc_id % 100 = 0) where w in (select lower(pref_name) from molecules) group by all),
sz as (select query_id, count(*) as size from q group by 1),
s as (select source, query_id, passage_id, round(count(*) / max(size), 6) as score from q join m using (entity) join p using (passage_id) join sz using (query_id) group by 1, 2, 3)
select * from (select source, query_id, passage_id, score, row_number() over (partition by source, query_id order by score desc, passage_id)::int as rank from s) where rank <= 10""")
def source_tools(spark: SparkSession, d: str) -> DataFrame:
    """GR-20, GR-23: one search per source, bound to it and to a date; each result is stored under its arguments."""
    docs = table(spark, d, "documents").filter(F.col("doc_id") % 100 == 0)
    qs = docs.select(F.col("doc_id").alias("query_id"), F.explode(G.words("text")).alias("entity"))
    asked = cut_lineage(qs.join(_entities(spark, d).distinct(), "entity", "left_semi").distinct())
    m, p = cut_lineage(_mentions(spark, d)), table(spark, d, "passages")
    folder, out = scratch(spark, "memo"), None
    for source in _SOURCES:
        key = X.memo_key("search", {"data": d, "source": source, "before": "2019-01-01", "k": 10})
        got = X.memoised(spark, key, lambda s=source: G.retrieve(p, m, asked, 10, [s], "2019-01-01", iso_day("date")), folder)
        one = got.withColumn("source", F.lit(source))
        out = one if out is None else out.unionByName(one)
    return out


_SYNONYMS = """
with syn as (select synonym, arg_max(canonical, chembl_id) as canonical from (
  select chembl_id, lower(trim(pref_name)) as canonical, unnest(list_distinct([lower(trim(pref_name))] || list_transform(string_split(coalesce(target_names, ''), '|'), lambda x: lower(trim(x))))) as synonym
  from molecules where trim(pref_name) <> '') where synonym <> '' group by 1)
"""


def _synonyms(spark: SparkSession, d: str) -> DataFrame:
    return G.synonym_table(table(spark, d, "molecules"), "pref_name", "target_names", "chembl_id")


@query(_SYNONYMS + "select canonical, synonym from syn")
def synonym_table(spark: SparkSession, d: str) -> DataFrame:
    """GR-18: every synonym with its canonical name; collisions go to the last molecule."""
    return _synonyms(spark, d)


@query(_SYNONYMS + """select report_id, coalesce(canonical, drug_name) as canonical from faers left join syn on lower(trim(drug_name)) = synonym""")
def normalised_names(spark: SparkSession, d: str) -> DataFrame:
    """GR-19: the name that a typed name stands for; an unknown one stays as it is."""
    return G.normalised(table(spark, d, "faers").select("report_id", "drug_name"), "drug_name", _synonyms(spark, d)).select("report_id", "canonical")


@query(_SYNONYMS + """, e as (select report_id as query_id, lower(drug_name) as entity from faers where drug_name <> ''),
c as (select distinct query_id, canonical from e join syn on entity = synonym),
x as (select query_id, synonym as entity, row_number() over (partition by query_id, canonical order by synonym) as r from c join syn using (canonical))
select distinct query_id, entity from (select query_id, entity from e union all select query_id, entity from x where r <= 5)""")
def expanded_entities(spark: SparkSession, d: str) -> DataFrame:
    """GR-17, JN-14: query entities and up to five synonyms of each."""
    syn = _synonyms(spark, d)
    e = table(spark, d, "faers").filter("drug_name <> ''").select(F.col("report_id").alias("query_id"), F.col("drug_name").alias("entity"))
    return G.expand(e, syn)


@query(_MENTIONS + """
, a as (select entity, 1.0 as score, 1 as tier from (select distinct entity from m)),
dn as (select passage_id, score as similarity from passages where score is not null),
bo as (select passage_id, sum(ln(1 + n) * score / greatest(tier, 1)) as bonus from m join a using (entity) group by 1)
select passage_id, round(2.0 * coalesce((similarity - lo) / (hi - lo), 0) + ln(1 + coalesce(bonus, 0)), 5) as score
from (select * from dn full join bo using (passage_id)), (select min(similarity) as lo, max(similarity) as hi from dn)""")
def scored_passages(spark: SparkSession, d: str) -> DataFrame:
    """GR-13, JN-09, MTH-01: dense and entity scores combined."""
    m = _mentions(spark, d)
    act = m.select("entity").distinct().select("entity", F.lit(1.0).alias("score"), F.lit(1).alias("tier"))
    dense = table(spark, d, "passages").filter("score is not null").select("passage_id", F.col("score").alias("similarity"))
    return G.passage_scores(m, act, dense).withColumn("score", F.round("score", 5))


@query(
    _MENTIONS
    + """select (select sum(n) from m)::bigint as total, (select count(distinct entity) from m)::bigint as entities,
  (select round(count(*) / count(distinct passage_id), 4) from m) as per_passage"""
)
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    """AGG-30, GR-28: size of the entity index."""
    return _mentions(spark, d).agg(
        F.sum("n").alias("total"),
        F.count_distinct("entity").alias("entities"),
        F.round(F.count(F.lit(1)) / F.count_distinct("passage_id"), 4).alias("per_passage"),
    )


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
