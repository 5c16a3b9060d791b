"""Queries of features, models, selection, evaluation, monitoring and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import evaluation as E
from lodestream.operators import features as FE
from lodestream.operators import models as M
from lodestream.operators import monitoring as MO
from lodestream.operators import search as S
from lodestream.streaming import jobs
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


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("select c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::int as \"seg_{s}\"" for s in _SEGMENTS) + " from customer")
def one_hot_segments(spark: SparkSession, d: str) -> DataFrame:
    """FE-02, FE-03."""
    return table(spark, d, "customer").select("c_custkey", *FE.one_hot(F.col("c_mktsegment"), _SEGMENTS, "seg"))


@query("select trial_row_id, " + ", ".join(f"len(list_filter(string_split(coalesce(conditions, ''), '|'), lambda x: x = '{c}'))::int as \"has_{c}\"" for c in ("obesity", "gout", "sepsis")) + " from ctg_trials")
def multi_hot_conditions(spark: SparkSession, d: str) -> DataFrame:
    """FE-02: counts over a fixed vocabulary."""
    c = F.split(F.coalesce("conditions", F.lit("")), r"\|")
    return table(spark, d, "ctg_trials").select("trial_row_id", *FE.multi_hot(c, ["obesity", "gout", "sepsis"], "has"))


@query("""select l_orderkey::varchar as trial_id, max(case when l_returnflag = 'A' then l_quantity::varchar end) as "flag--A", max(case when l_returnflag = 'R' then l_quantity::varchar end) as "flag--R" from lineitem group by 1""")
def pivoted_features(spark: SparkSession, d: str) -> DataFrame:
    """FE-01: long features to wide columns of known names."""
    li = table(spark, d, "lineitem")
    rows = li.select(F.col("l_orderkey").cast("string").alias("trial_id"), F.lit("flag").alias("feature"), F.col("l_returnflag").alias("sub"), F.col("l_quantity").cast("string").alias("value"))
    return FE.wide(rows, ["flag--A", "flag--R"])


@query("""select row_id, coalesce(enrollment::double, (select quantile_cont(enrollment, 0.5) from aact_studies)) as enrollment from aact_studies""")
def imputed_enrollment(spark: SparkSession, d: str) -> DataFrame:
    """FE-03: nulls filled with the median."""
    return FE.imputed(table(spark, d, "aact_studies").select("row_id", "enrollment"), ["enrollment"])


@query("""with w as (select chembl_id as trial_id, g as "group", md5(g) as plan_hash from molecules, (values ('design'), ('safety'), ('history')) t(g))
select trial_id, "group", plan_hash from w where not ("group" = 'safety' and trial_id in (select chembl_id from molecules where withdrawn_flag))""")
def missing_feature_work(spark: SparkSession, d: str) -> DataFrame:
    """JN-07, FE-04, FE-05: what a plan needs and the store does not hold."""
    m = table(spark, d, "molecules")
    plan = spark.createDataFrame([(g,) for g in ("design", "safety", "history")], "`group` string").withColumn("plan_hash", F.md5("group"))
    store = m.filter("withdrawn_flag").select(F.col("chembl_id").alias("trial_id"), F.lit("safety").alias("group"), F.md5(F.lit("safety")).alias("plan_hash"))
    return FE.missing_work(m.select(F.col("chembl_id").alias("trial_id")), plan, store)


@query("""select relation as grp, y_type as feature, ((row_number() over (partition by relation order by y_type) - 1) // 5)::int as part from (select y_type, min(relation) as relation from primekg group by 1)""")
def capped_feature_groups(spark: SparkSession, d: str) -> DataFrame:
    """FE-06."""
    kg = table(spark, d, "primekg").select(F.col("relation").alias("grp"), F.col("y_type").alias("feature"))
    return FE.capped_groups(kg, "grp", "feature")


@query("""with c as (select c_mktsegment || '_' || case when c_custkey % 50 = 0 then c_custkey else c_nationkey % 2 end as s from customer),
z as (select case when n = 1 then '__small__' else s end as stratum, sum(n) as n from (select s, count(*) as n from c group by 1) group by 1),
q as (select stratum, unnest(['train', 'val', 'test']) as split, unnest([ceil(n * 3 / 5.0), ceil(n * 4 / 5.0) - ceil(n * 3 / 5.0), n - ceil(n * 4 / 5.0)])::bigint as n from z)
select * from q where n > 0""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """SPL-01: rows per stratum and split; single rows are a stratum of their own."""
    kind = F.when(F.col("c_custkey") % 50 == 0, F.col("c_custkey")).otherwise(F.col("c_nationkey") % 2)
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", kind.alias("kind"))
    return FE.stratified_split(c, "c_custkey", ["c_mktsegment", "kind"]).groupBy("stratum", "split").agg(F.count(F.lit(1)).alias("n"))


@query()
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """SPL-02, SRT-07: a seeded sample that does not depend on partitioning."""
    return FE.hash_sample(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", 50)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey"),
        F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax"),
        (F.col("l_extendedprice") > 40000).cast("int").alias("label"),
    )


@query()
def model_predictions(spark: SparkSession, d: str) -> DataFrame:
    """ML-01 to ML-03, ML-09 to ML-13: trains by name and scores all rows in one pass."""
    rows = _labelled(spark, d)
    cols = ["l_quantity", "l_discount", "l_tax"]
    train = rows.filter(F.pmod(F.xxhash64("l_orderkey"), F.lit(10)) < 6)
    models, _ = M.train_all(train, cols, ["logistic"])
    return M.predict(models["logistic"], rows, cols, ["id", "label"])


@query()
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    """ML-05, ML-06, AGG-19: importance of each feature in boosted trees."""
    cols = ["l_quantity", "l_discount", "l_tax"]
    models, _ = M.train_all(_labelled(spark, d), cols, ["gbt"])
    return M.importance(models["gbt"], cols, spark)


_BASE = {"l_quantity": 25.0, "l_discount": 0.05, "l_tax": 0.04}
_F = "({q} * {d} + 10 * {d} * {t} - {t} * {t} * {q})"


def _f(on: str) -> str:
    return _F.format(q="l_quantity" if "q" in on else "25.0", d="l_discount" if "d" in on else "0.05", t="l_tax" if "t" in on else "0.04")


def _shap(i: str) -> str:
    a, b = [x for x in "qdt" if x != i]
    return f"({_f(i)} - {_f('')}) / 3 + ({_f(i + a)} - {_f(a)}) / 6 + ({_f(i + b)} - {_f(b)}) / 6 + ({_f(i + a + b)} - {_f(a + b)}) / 3"


_CONTRIB = f"""with c as (select l_orderkey * 10 + l_linenumber as id, {_f('')} as base, {_shap('q')} as l_quantity, {_shap('d')} as l_discount, {_shap('t')} as l_tax,
  ({_f('qd')} - {_f('q')} - {_f('d')} + {_f('')}) / 2 + ({_f('qdt')} - {_f('qt')} - {_f('dt')} + {_f('t')}) / 2 as qd from lineitem)
"""


def _contributed(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d)
    score = lambda df: df.withColumn("p", F.expr(_F.format(q="l_quantity", d="l_discount", t="l_tax")))
    return M.contributions(rows, "id", list(_BASE), score, _BASE, pairs=True)


@query(_CONTRIB + "select id, round(base, 6) as base, round(l_quantity, 6) as l_quantity, round(l_discount, 6) as l_discount, round(l_tax, 6) as l_tax, round(qd, 6) as pair from c")
def row_contributions(spark: SparkSession, d: str) -> DataFrame:
    """ML-05: exact contributions and an interaction per row, of a given score of three features."""
    out = _contributed(spark, d)
    return out.select("id", *(F.round(c, 6).alias(c) for c in ("base", *_BASE)), F.round("`l_quantity*l_discount`", 6).alias("pair"))


@query(_CONTRIB + """select id, array_to_string(list_transform(list_slice(list_sort([{'o': -round(abs(l_quantity * 0.7310585786), 9), 'n': 'l_quantity', 'v': l_quantity * 0.7310585786},
  {'o': -round(abs(l_discount * 0.7310585786), 9), 'n': 'l_discount', 'v': l_discount * 0.7310585786}, {'o': -round(abs(l_tax * 0.7310585786), 9), 'n': 'l_tax', 'v': l_tax * 0.7310585786}]), 1, 2),
  lambda x: x.n || printf(' %+.4f', round(x.v, 4) + 0.0)), '; ') as effects from c""")
def row_effects(spark: SparkSession, d: str) -> DataFrame:
    """ML-06, ML-09: the two largest contributions of each row as text."""
    scaled = _contributed(spark, d).select("id", *((F.col(c) * 0.7310585786).alias(c) for c in _BASE))
    return M.effects_text(scaled, "id", list(_BASE), 2)


@query("""with l as (select event_type as name, 'v' || (user_id % 20) as version, ['production', 'staging', 'none'][event_id % 3 + 1] as stage, event_id as seq from events),
t as (select name, version, arg_max(stage, seq) as stage from l group by 1, 2), h as (select name, stage, arg_max(version, seq) as holder from l where stage <> 'none' group by 1, 2)
select t.name, t.version, case when h.holder = t.version then t.stage else 'none' end as stage from t left join h on t.name = h.name and t.stage = h.stage""")
def model_stages(spark: SparkSession, d: str) -> DataFrame:
    """ML-08, SNK-10: the stage of each version, with one holder per stage, from a log of promotions."""
    e = table(spark, d, "events")
    stage = F.element_at(F.array(*map(F.lit, M.STAGES)), (F.col("event_id") % 3 + 1).cast("int"))
    log = e.select(F.col("event_type").alias("name"), F.concat(F.lit("v"), (F.col("user_id") % 20).cast("string")).alias("version"), stage.alias("stage"), F.col("event_id").alias("at"))
    return M.current_stages(log)


_TREE = """
with n as (select 'C' || c_custkey as node_id, ['R' || n_regionkey, 'N' || n_nationkey, 'C' || c_custkey] as path from customer join nation on c_nationkey = n_nationkey),
e as (select 'C' || o_custkey as node_id, o_orderkey as seq, o_totalprice / 600000 as accuracy, 1 - (o_orderkey % 50) / 50 as parsimony from orders),
x as (select unnest(path) as node_id, seq, accuracy, parsimony, greatest(accuracy - 0.1, 0) * greatest(parsimony - 0.2, 0) as hv from e join n using (node_id))
"""


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    name = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    nodes = c.select(name("C", "c_custkey").alias("node_id"), F.array(name("R", "n_regionkey"), name("N", "n_nationkey"), name("C", "c_custkey")).alias("path"))
    o = table(spark, d, "orders")
    return nodes, o.select(name("C", "o_custkey").alias("node_id"), F.col("o_orderkey").alias("seq"), (F.col("o_totalprice") / 600000).alias("accuracy"), (1 - (F.col("o_orderkey") % 50) / 50).alias("parsimony"))


@query(_TREE + """select 'mean' as mode, node_id, count(*)::bigint as visits, round(avg(accuracy), 9) as accuracy, round(avg(parsimony), 9) as parsimony from x group by 2
union all select 'max', node_id, count(*)::bigint, max(accuracy), max(parsimony) from x group by 2
union all select 'max_hv', node_id, n::bigint, accuracy, parsimony from (
  select *, count(*) over (partition by node_id) as n, row_number() over (partition by node_id order by hv desc, accuracy desc, seq) as r from x) where r = 1""")
def node_values(spark: SparkSession, d: str) -> DataFrame:
    """PO-06: values at every node of a tree by each rule of back-propagation."""
    nodes, evaluations = _tree(spark, d)
    out = None
    for mode in S.MODES:
        v = S.node_values(nodes, evaluations, ["accuracy", "parsimony"], mode, (0.1, 0.2))
        value = [F.round(c, 9).alias(c) if mode == "mean" else F.col(c) for c in ("accuracy", "parsimony")]
        one = v.select(F.lit(mode).alias("mode"), "node_id", "visits", *value)
        out = one if out is None else out.unionByName(one)
    return out


@query("""with e as (select o_custkey as node_id, o_orderkey as seq, case when o_orderkey % 7 = 0 then null else 'f' || (o_orderkey % 3) end as f,
  case when o_orderkey % 11 = 0 then null when o_orderkey % 13 = 0 then 'nan'::double when o_orderkey % 17 = 0 then 'infinity'::double else o_totalprice / 600000 end as accuracy, 1 - (o_orderkey % 50) / 50 as parsimony from orders),
s as (select node_id, accuracy, parsimony, row_number() over (partition by node_id order by greatest(accuracy - 0.1, 0) * parsimony desc, accuracy desc, seq) as r
  from e where accuracy is not null and not isnan(accuracy) and not isinf(accuracy) and (f is null or f = 'f' || (node_id % 3)))
select node_id, accuracy, parsimony from s where r = 1""")
def own_objectives(spark: SparkSession, d: str) -> DataFrame:
    """PO-07, PO-16: each node's best evaluation of the features that it has now, finite ones only."""
    feature = lambda c: F.array(F.concat(F.lit("f"), (F.col(c) % 3).cast("string")))
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), feature("c_custkey").alias("features"))
    k = F.col("o_orderkey")
    score = F.when(k % 11 == 0, None).when(k % 13 == 0, float("nan")).when(k % 17 == 0, float("inf")).otherwise(F.col("o_totalprice") / 600000)
    e = table(spark, d, "orders").select(
        F.col("o_custkey").alias("node_id"), k.alias("seq"), F.when(k % 7 != 0, feature("o_orderkey")).alias("features"), score.alias("accuracy"), (1 - k % 50 / 50).alias("parsimony")
    )
    return S.own_objectives(nodes, e, ["accuracy", "parsimony"], (0.1, 0.0))


@query("""with c as (select p_partkey as node_id, p_size % 7 as n_features, p_retailprice / 2200 as x, p_size / 50 as y from part),
f as (select * from c where not exists (select 1 from c q where q.x >= c.x and q.y >= c.y and (q.x > c.x or q.y > c.y))),
p as (select x, y, greatest(x - greatest(coalesce(lead(x) over w, 0.3), 0.3), 0) * greatest(y - greatest(coalesce(lag(y) over w, 0), 0), 0) as g from (select distinct x, y from f) window w as (order by x desc))
select node_id, round(f.x, 6) as x, round(f.y, 6) as y, round(g, 6) as contribution from f join p on f.x = p.x and f.y = p.y where g >= (select max(g) from p) - 1e-9 order by n_features, node_id limit 1""")
def best_feature_node(spark: SparkSession, d: str) -> DataFrame:
    """PO-07: of the front the node that alone dominates the largest area."""
    c = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), (F.col("p_size") % 7).alias("n_features"), F.col("p_partkey").alias("created"), (F.col("p_retailprice") / 2200).alias("x"), (F.col("p_size") / 50).alias("y"))
    return S.best_node(c, "x", "y", (0.3, 0.0)).select("node_id", *(F.round(c, 6).alias(c) for c in ("x", "y", "contribution")))


@query("""with p as (select p_partkey, p_retailprice::double as price, p_size::double as size, (p_partkey % 97)::double as rest from part)
select * from p where not exists (select 1 from p q where q.price >= p.price and q.size >= p.size and q.rest >= p.rest and (q.price > p.price or q.size > p.size or q.rest > p.rest))""")
def pareto_front_3d(spark: SparkSession, d: str) -> DataFrame:
    """PO-01, PO-03: the front of three objectives."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"), (F.col("p_partkey") % 97).alias("rest"))
    return S.front_nd(p, "p_partkey", ["price", "size", "rest"])


@query()
def volume_contributions(spark: SparkSession, d: str) -> DataFrame:
    """PO-03: what each point of a front of three objectives alone dominates, from one seeded sample."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"), (F.col("p_partkey") % 97).alias("rest"))
    front = S.front_nd(p, "p_partkey", ["price", "size", "rest"]).orderBy("p_partkey").collect()  # at most FRONT_BOUND
    gain = S.contributions([[r["price"], r["size"], r["rest"]] for r in front], [900.0, 0.0, 0.0])
    return spark.createDataFrame([(r["p_partkey"], g) for r, g in zip(front, gain, strict=True)], "p_partkey bigint, contribution double")


@query("""select l_orderkey, l_linenumber, left(sha256(l_linenumber || '|' || l_linenumber % 3 || ',' || l_linenumber % 2 || '|' || md5(l_orderkey::varchar) || '|' ||
  array_to_string(list_sort([l_shipmode, l_returnflag, l_linestatus]), ',')), 16) as node_key from lineitem""".replace("l_shipmode", "l_orderkey::varchar"))
def node_keys(spark: SparkSession, d: str) -> DataFrame:
    """PO-10: keys of nodes from their place, parent and features."""
    n = F.col("l_linenumber")
    features = F.array(F.col("l_orderkey").cast("string"), F.col("l_returnflag"), F.col("l_linestatus"))
    key = S.node_keys(n, F.array(n % 3, n % 2), F.md5(F.col("l_orderkey").cast("string")), features)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", key.alias("node_key"))


_SUGGESTED = "list_filter(string_split(coalesce(conditions, ''), '|'), lambda x: x <> '')"


@query(f"""select trial_row_id, child::int as child, 'suggestion_' || child || ': ' || left(s[child + 1], 80) as label, child >= len(s) - 1 as last from (
  select trial_row_id, s, unnest(range(least(len(s), 3))) as child from (select trial_row_id, {_SUGGESTED} as s from ctg_trials))""")
def suggested_children(spark: SparkSession, d: str) -> DataFrame:
    """PO-13, PO-14: one child per suggestion, and whether the suggestions are used up after it."""
    s = F.filter(F.split(F.coalesce("conditions", F.lit("")), r"\|"), lambda x: x != "").alias("s")
    nodes = table(spark, d, "ctg_trials").select("trial_row_id", s)
    c = S.children_of(nodes, "trial_row_id", "s", 3).join(nodes, "trial_row_id")
    return c.select("trial_row_id", "child", "label", S.is_exhausted(F.col("child") + 1, F.col("s")).alias("last"))


_SCORED = """with s as (select (l_extendedprice > 40000)::int as label, round(l_quantity - l_tax * 100, 2) as score from lineitem)
"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_extendedprice") > 40000).cast("int").alias("label"), F.round(F.col("l_quantity") - F.col("l_tax") * 100, 2).alias("score"))


@query(_SCORED + """, p as (select score, sum(label) as pos, sum(1 - label) as neg from s group by 1),
c as (select *, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp from p)
select round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) as roc_auc, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) as average_precision from c""")
def curve_metrics(spark: SparkSession, d: str) -> DataFrame:
    """ML-04, WIN-06, WIN-07."""
    return E.curve_metrics(_scored(spark, d))


@query(_SCORED + """, t as (select unnest([10.0, 20.0, 30.0, 40.0]) as threshold),
a as (select threshold, count(*) filter (where score >= threshold and label = 1) as tp, count(*) filter (where score >= threshold and label = 0) as fp, count(*) filter (where score < threshold and label = 1) as fn from s, t group by 1)
select threshold, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from a""")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """EV-04: measures at several thresholds from one pass over the rows."""
    return E.threshold_metrics(_scored(spark, d), [10.0, 20.0, 30.0, 40.0])


_PAIRS = "with p as (select l_returnflag as gold, case when l_linenumber % 5 = 0 then null when l_linenumber % 3 = 0 then 'N' else l_returnflag end as pred from lineitem)\n"
_STATS = _PAIRS + """, s as (select label, count(*) filter (where side = 'g' and hit) as tp, count(*) filter (where side = 'p' and not hit) as fp, count(*) filter (where side = 'g' and not hit) as fn from (
  select gold as label, 'g' as side, coalesce(gold = pred, false) as hit from p union all select pred, 'p', coalesce(gold = pred, false) from p) where label is not null group by 1)
"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    pred = F.when(n % 5 == 0, None).when(n % 3 == 0, "N").otherwise(F.col("l_returnflag"))
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("gold"), pred.alias("pred"))


@query(_STATS + """select label, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from s""")
def label_stats(spark: SparkSession, d: str) -> DataFrame:
    """EV-02, AGG-12."""
    return E.label_stats(_pairs(spark, d))


@query(_STATS + """, f as (select *, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from s)
select round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) as micro_f1, round(avg(f1), 6) as macro_f1, round(sum(f1 * (tp + fn)) / sum(tp + fn), 6) as weighted_f1 from f""")
def averaged_f1(spark: SparkSession, d: str) -> DataFrame:
    """AGG-13."""
    return E.averages(E.label_stats(_pairs(spark, d)))


@query(_PAIRS + """select gold, count(*) filter (where pred = 'A')::bigint as "A", count(*) filter (where pred = 'N')::bigint as "N", count(*) filter (where pred = 'R')::bigint as "R", count(*) filter (where pred is null)::bigint as "none" from p group by 1""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """EV-03, AGG-14."""
    return E.confusion(_pairs(spark, d), ["A", "N", "R"])


_SPANS = """
with g as (select user_id as doc_id, event_id as id, epoch_us(ts) // 60000000 as s, epoch_us(ts) // 60000000 + 600 as e, event_type as label from events where event_id % 2 = 0),
p as (select user_id as doc_id, event_id as id, epoch_us(ts) // 60000000 as s, epoch_us(ts) // 60000000 + 600 as e, event_type as label from events where event_id % 2 = 1)
"""


def _spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    start = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60)
    e = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("id"), start.alias("start"), (start + 600).alias("end"), F.col("event_type").alias("label"), F.col("value").alias("score"))
    return e.filter("id % 2 = 0").drop("score"), e.filter("id % 2 = 1")


@query(_SPANS + "select g.doc_id, g.id as gold_id, p.id as pred_id from g join p on g.doc_id = p.doc_id and greatest(g.s, p.s) < least(g.e, p.e)")
def overlapping_spans(spark: SparkSession, d: str) -> DataFrame:
    """JN-10."""
    g, p = _spans(spark, d)
    return E.overlapping(g, p).select("doc_id", F.col("g.id").alias("gold_id"), F.col("p.id").alias("pred_id"))


@query(_SPANS + """, b as (select g.doc_id, g.id, max(case when g.s = p.s and g.e = p.e and g.label = p.label then 3 when g.s = p.s and g.e = p.e then 2 else 1 end) as level
  from g join p on g.doc_id = p.doc_id and greatest(g.s, p.s) < least(g.e, p.e) group by 1, 2)
select g.doc_id, g.id, case level when 3 then 'exact' when 2 then 'wrong_label' when 1 then 'partial' else 'not_found' end as verdict from g left join b using (doc_id, id)""")
def gold_ladder(spark: SparkSession, d: str) -> DataFrame:
    """EV-07 by spans alone, in four verdicts; text_ladder has all six."""
    return E.gold_ladder(*_spans(spark, d))


@query()
def greedy_matches(spark: SparkSession, d: str) -> DataFrame:
    """EV-01, WIN-10: one-to-one matching in gold order."""
    return E.greedy_matches(*_spans(spark, d))


_TEXTS = """
with e as (select user_id as doc_id, event_id as id, epoch_us(ts) // 60000000 as s, epoch_us(ts) // 60000000 + 600 as e, event_type as label, event_id % 2 = 0 as gold,
  case when event_id % 2 = 0 then 'Item ' else 'ITEM ' end || (floor(value)::bigint % 997) as text from events),
g as (select * from e where gold), p as (select * from e where not gold),
b as (select g.doc_id, g.id, g.s, g.label, p.label = g.label as same, lower(p.text) = lower(g.text) as txt, p.s is not null and greatest(g.s, p.s) < least(g.e, p.e) as span,
  contains(lower(p.text), lower(g.text)) or contains(lower(g.text), lower(p.text)) as part from g left join p using (doc_id))
"""


def _texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The spans of _spans with a text each, in different letter case on the two sides."""
    value = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.floor("value") % 997).cast("string").alias("text"))
    g, p = _spans(spark, d)
    return tuple(x.join(value, "id").withColumn("text", F.concat(F.lit(w), "text")) for x, w in ((g, "Item "), (p, "ITEM ")))


@query(_TEXTS + """select doc_id, id, case when bool_or(same and txt) then 'matched_exact' when bool_or(same and span) then 'matched_relaxed' when bool_or(txt) then 'wrong_label'
  when bool_or(span) then 'partial_span' when bool_or(part) then 'text_found_no_label' else 'not_found' end as verdict from b group by 1, 2""")
def text_ladder(spark: SparkSession, d: str) -> DataFrame:
    """EV-07."""
    return E.six_way_ladder(*_texts(spark, d))


@query(_TEXTS + """, h as (select doc_id, id, label, coalesce(bool_or(txt), false) as txt, coalesce(bool_or(span), false) as span from b group by 1, 2, 3)
select label, count(*)::bigint as total, count(*) filter (where txt)::bigint as text_matched, count(*) filter (where span)::bigint as span_matched,
  round(100 * count(*) filter (where txt) / greatest(count(*), 1), 1) as text_recall_pct, round(100 * count(*) filter (where span) / greatest(count(*), 1), 1) as span_recall_pct
from h group by grouping sets ((label), ())""")
def span_recall(spark: SparkSession, d: str) -> DataFrame:
    """EV-06."""
    return E.span_recall(*_texts(spark, d))


@query(_TEXTS + """, c as (select doc_id, count(*) filter (where gold) as n from e group by 1), r as (select doc_id, row_number() over (order by n, doc_id) - 1 as at, count(*) over () as docs from c),
h as (select doc_id, id, bool_or(same and txt) as hit, bool_or(same and span) as relaxed from b group by 1, 2)
select q::int as quartile, r.doc_id, count(h.id)::bigint as golds, count(*) filter (where hit)::bigint as text_matched, count(*) filter (where relaxed)::bigint as relaxed_matched
from r join (values (1), (2), (3)) v(q) on r.at = q * docs // 4 left join h using (doc_id) group by 1, 2""")
def quartile_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """EV-13; quartile_misses lists the misses."""
    return E.quartile_diagnosis(table(spark, d, "events").select(F.col("user_id").alias("doc_id")), *_texts(spark, d)).drop("missed")


@query()
def quartile_misses(spark: SparkSession, d: str) -> DataFrame:
    """EV-13: the first ten misses of each picked document with their partial hits."""
    q = E.quartile_diagnosis(table(spark, d, "events").select(F.col("user_id").alias("doc_id")), *_texts(spark, d))
    return q.select("quartile", "doc_id", F.explode("missed").alias("m")).select("quartile", "doc_id", "m.*")


@query()
def match_modes(spark: SparkSession, d: str) -> DataFrame:
    """EV-01, EV-11: measures per label in own and in mapped labels, by each strategy."""
    gold, pred = _texts(spark, d)
    to = F.create_map(*[F.lit(x) for kv in {"click": "use", "view": "use", "purchase": "order", "signup": "order"}.items() for x in kv])
    mapped = [x.withColumn("label", to[F.col("label")]) for x in (gold, pred)]
    runs = {"native": (gold, pred, None), "mapped": (mapped[0], mapped[1].filter("label is not null"), {"order": ["order", "use"]})}
    out = None
    for mode, (g, p, accepted) in runs.items():
        for strategy in ("strict", "relaxed", "text_only"):
            one = E.label_stats(E.matched_labels(g, p, strategy, accepted)).select(F.lit(mode).alias("mode"), F.lit(strategy).alias("strategy"), "*")
            out = one if out is None else out.unionByName(one)
    return out


@query(_SPANS.replace("with g as", "with recursive g as") + """, k as (
  select doc_id, arg_min(id, [s, -e, id]) as id, (min([s, -e, id]))[2] * -1 as e from g group by 1
  union all
  select g.doc_id, arg_min(g.id, [g.s, -g.e, g.id]), (min([g.s, -g.e, g.id]))[2] * -1 from k join g on g.doc_id = k.doc_id and g.s >= k.e group by 1)
select doc_id, id from k""")
def spans_without_overlap(spark: SparkSession, d: str) -> DataFrame:
    """SRT-09."""
    return E.without_overlaps(_spans(spark, d)[0])


@query("""select p.p_partkey, p.p_retailprice, p.p_size::double as p_size from part p where not exists (
  select 1 from part q where q.p_retailprice >= p.p_retailprice and q.p_size >= p.p_size and (q.p_retailprice > p.p_retailprice or q.p_size > p.p_size))""")
def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    """PO-01, JN-11."""
    p = table(spark, d, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    return S.front_2d(p, "p_partkey", "p_retailprice", "p_size")


@query("""with f as (select p_retailprice as x, max(p_size)::double as y from part p where not exists (
  select 1 from part q where q.p_retailprice >= p.p_retailprice and q.p_size >= p.p_size and (q.p_retailprice > p.p_retailprice or q.p_size > p.p_size)) group by 1)
select round(sum(x * greatest(y - coalesce(b, 0), 0)), 4) as hypervolume from (select x, y, max(y) over (order by x desc rows between unbounded preceding and 1 preceding) as b from f)""")
def hypervolume(spark: SparkSession, d: str) -> DataFrame:
    """PO-02, PO-15, WIN-05."""
    p = table(spark, d, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    return S.hypervolume_2d(S.front_2d(p, "p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_size").withColumn("hypervolume", F.round("hypervolume", 4))


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("entity"), F.col("event_type").alias("model"), (F.col("value") / 1000).alias("probability"), F.col("value").alias("latency"))


@query("""select count(*)::bigint as n, round(avg(value / 1000), 6) as mean_probability, round(avg(value), 6) as mean_latency, round(quantile_cont(value, 0.99), 6) as p99_latency, count(distinct user_id)::bigint as entities from events""")
def monitoring_metrics(spark: SparkSession, d: str) -> DataFrame:
    """AGG-17."""
    return MO.metrics(_log(spark, d))


@query("select cast(ts as date) as day, count(*)::bigint as n from events group by 1")
def daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-17, STM-04, STM-05."""
    return MO.daily_counts(_log(spark, d))


@query("select event_type as model, count(*)::bigint as n from events group by 1")
def counts_per_model(spark: SparkSession, d: str) -> DataFrame:
    return MO.counts_by(_log(spark, d), "model")


_KS = """with a as (select value as x from events where event_type = 'click' and value is not null), b as (select value as x from events where event_type = 'purchase' and value is not null),
u as (select x, sum(a) as a, sum(b) as b from (select x, 1 as a, 0 as b from a union all select x, 0, 1 from b) group by 1)
select (select count(*) from a)::bigint as n_a, (select count(*) from b)::bigint as n_b, round(max(abs(ca / (select count(*) from a) - cb / (select count(*) from b))), 6) as d from (select sum(a) over (order by x) as ca, sum(b) over (order by x) as cb from u)"""


@query(_KS)
def ks_distance(spark: SparkSession, d: str) -> DataFrame:
    """WIN-08, STM-06."""
    e = table(spark, d, "events").select("event_type", F.col("value").alias("x"))
    return E.ks_statistic(e.filter("event_type = 'click'").select("x"), e.filter("event_type = 'purchase'").select("x"))


def _ks_sql(x: str, name: str) -> str:
    return f"""{name}n as materialized (select count(*) filter (where old and {x} is not null) as a, count(*) filter (where not old and {x} is not null) as b from l),
{name}d as (select max(abs(ca / a - cb / b)) as d from (select sum(o) over (order by v) as ca, sum(n) over (order by v) as cb from (
  select {x} as v, count(*) filter (where old) as o, count(*) filter (where not old) as n from l where {x} is not null group by 1)), {name}n),
{name} as (select least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda k: (case when k % 2 = 1 then 1 else -1 end) * exp(-2 * k * k * lam * lam))))) as p
  from (select (sqrt(a * b / (a + b)) + 0.12 + 0.11 / sqrt(a * b / (a + b))) * round(d, 6) as lam from {name}n, {name}d))"""


@query(f"""with m as (select quantile_cont(epoch_us(ts), 0.5) as mid from events), l as materialized (select epoch_us(ts) <= mid as old, value / 1000 as pr, value as la from events, m),
{_ks_sql("pr", "p")}, {_ks_sql("la", "q")},
f as (select list_filter([case when p.p < 0.05 then 'probability' end, case when q.p < 0.05 then 'latency' end], lambda c: c is not null) as drifted from p, q),
w as (select count(*) filter (where not old and la is null) / nullif(count(*) filter (where not old), 0) as missing, avg(la) filter (where not old) / avg(la) filter (where old) as slower from l)
select case when len(drifted) > 0 or missing > 0.1 or slower > 1.5 then 'drift' else 'stable' end as status, (select count(*) from events)::bigint as rows, drifted from f, w""")
def drift_verdict(spark: SparkSession, d: str) -> DataFrame:
    """STM-06, WIN-12: the newer half of the log against the older."""
    v = MO.drift(_log(spark, d), ["latency"])
    return spark.createDataFrame([(v["status"], v["rows"], v["drifted"])], "status string, rows bigint, drifted array<string>")


@query("""select date_trunc('day', ts) as start, event_type, count(*)::bigint as n, round(sum(value), 4) as total from events group by 1, 2""")
def streamed_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """STM-01, STM-04: a watermarked day window over a file stream; its result is that of the batch."""
    s = jobs.file_stream(spark, d, f"{d}/events.parquet", "events.parquet")
    out = jobs.scratch(spark, "daily")
    jobs.drain_batches(
        jobs.windowed_counts(s.withColumn("ts", F.col("ts").cast("timestamp"))), jobs.upsert_sink(out, ["start", "event_type"], ["n"]), jobs.scratch(spark, "daily-ckpt")
    )
    return jobs.latest(spark, out)


@query("""select user_id, event_type, event_id, ts, value from (
  select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) where rn = 1""")
def streamed_upserts(spark: SparkSession, d: str) -> DataFrame:
    """STM-02, STM-03: a stream whose batches replace rows by key."""
    s = jobs.file_stream(spark, d, f"{d}/events.parquet", "events.parquet").select("user_id", "event_type", "event_id", "ts", "value")
    out = jobs.scratch(spark, "last")
    jobs.drain_batches(s, jobs.upsert_sink(out, ["user_id", "event_type"], ["ts", "event_id"]), jobs.scratch(spark, "last-ckpt"), "append")
    return jobs.latest(spark, out)


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
