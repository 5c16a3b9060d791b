"""Models on Spark ML: pipelines by name, training, scoring, importance, versions.

Rows with a null label are left out of training; null features are imputed by the median. A model that
fails to fit is skipped and reported. The store is a folder per version and a registry table.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from itertools import combinations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Trees, depth and step of boosted trees: small for trials, full for training with rows to stop by.
SIZES = {"small": (20, 4, 0.1), "full": (300, 6, 0.1)}


def _gbt(size: str = "small", validation: str | None = None) -> GBTClassifier:
    """Boosted trees; with a boolean validation column, growing stops once its rows gain no more."""
    trees, depth, step = SIZES[size]
    m = GBTClassifier(labelCol="label", featuresCol="vec", maxIter=trees, maxDepth=depth, stepSize=step, seed=42)
    return m.setValidationIndicatorCol(validation) if validation else m


#: Classifiers by name; callers may register their own factories.
CLASSIFIERS = {
    "gbt": _gbt,
    "logistic": lambda: LogisticRegression(labelCol="label", featuresCol="vec", regParam=0.01),
    "forest": lambda: RandomForestClassifier(labelCol="label", featuresCol="vec", numTrees=20, maxDepth=5, seed=42),
}
#: Features of which all subsets are scored for contributions per row.
MAX_FEATURES = 12
STAGES = ("production", "staging", "none")


def pipeline(name: str, cols: list[str], **options) -> Pipeline:
    filled = [f"{c}__f" for c in cols]
    return Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=cols, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="vec", handleInvalid="keep"),
            CLASSIFIERS[name](**options),
        ]
    )


def as_doubles(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def train_all(train: DataFrame, cols: list[str], names: list[str], options: dict[str, dict] | None = None) -> tuple[dict[str, PipelineModel], dict[str, str]]:
    """(models, failures) of the named classifiers on columns ``cols`` and label 0/1."""
    data = as_doubles(train.filter("label is not null"), [*cols, "label"])
    models, failures = {}, {}
    for n in names:
        try:
            models[n] = pipeline(n, cols, **(options or {}).get(n, {})).fit(data)
        except Exception as e:  # noqa: BLE001 - one bad model must not stop the others
            failures[n] = str(e)[:200]
    return models, failures


def predict(model: PipelineModel, rows: DataFrame, cols: list[str], keep: list[str], threshold: float = 0.5) -> DataFrame:
    """(keep..., probability, predicted) with four decimals, for all rows in one pass."""
    out = model.transform(as_doubles(rows, cols))
    p = F.round(F.get(vector_to_array("probability"), F.lit(1)), 4)
    return out.select(*keep, p.alias("probability")).withColumn("predicted", (F.col("probability") >= threshold).cast("int"))


def importance(model: PipelineModel, cols: list[str], spark: SparkSession) -> DataFrame:
    """(feature, importance), by importance falling."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    rows = [(c, float(round(v, 6))) for c, v in zip(cols, values, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def contributions(rows: DataFrame, key: str, cols: list[str], score: Callable[[DataFrame], DataFrame], baseline: dict[str, float], pairs: bool = False) -> DataFrame:
    """(key, base, a column per feature): exact Shapley values of each row's score against a baseline.

    score adds ``p`` to rows of (key, features). Every subset of the features is scored with the others at
    their baseline, so there are 2^n rows per row, and n is at most MAX_FEATURES; those of a row lie in one task and
    are summed up there. The features and base add up to the row's score. With pairs, columns a*b hold the
    interaction index of each pair. Rows with equal keys stay apart; a null feature counts as its baseline.
    """
    n = len(cols)
    if not 0 < n <= MAX_FEATURES:
        raise ValueError(f"between 1 and {MAX_FEATURES} features")
    f = math.factorial
    single = F.array(*[F.lit(f(s) * f(n - s - 1) / f(n)) for s in range(n)])
    double = F.array(*[F.lit(f(s) * f(n - s - 2) / f(n - 1)) for s in range(n - 1)]) if n > 1 else None
    mask = F.col("__mask")
    inside = {c: F.getbit(mask, F.lit(i)) == 1 for i, c in enumerate(cols)}
    numbered = rows.select(key, *(F.col(c).cast("double").alias(c) for c in cols)).withColumn("__row", F.monotonically_increasing_id())
    spread = numbered.select("*", F.explode(F.sequence(F.lit(0), F.lit(2**n - 1))).alias("__mask"))
    masked = spread.select(key, "__row", "__mask", *(F.when(inside[c], F.coalesce(F.col(c), F.lit(float(baseline[c])))).otherwise(F.lit(float(baseline[c]))).alias(c) for c in cols))
    size = F.bit_count(mask)

    def own(c: str) -> Column:
        return F.when(inside[c], F.get(single, size - 1)).otherwise(-F.get(single, size))

    def both(a: str, b: str) -> Column:
        others = size - inside[a].cast("int") - inside[b].cast("int")
        return F.when(inside[a] == inside[b], F.get(double, others)).otherwise(-F.get(double, others))

    sums = [F.sum(F.col("p") * own(c)).alias(c) for c in cols]
    if pairs:
        sums += [F.sum(F.col("p") * both(a, b)).alias(f"{a}*{b}") for a, b in combinations(cols, 2)]
    return score(masked).groupBy("__row", key).agg(F.sum(F.when(mask == 0, F.col("p"))).alias("base"), *sums).drop("__row")


def effects_text(contributed: DataFrame, key: str, cols: list[str], k: int = 3) -> DataFrame:
    """(key, effects): the k largest contributions of a row by size, with their sign, ties by name."""
    each = F.array(*(F.struct((-F.round(F.abs(c), 9)).alias("o"), F.lit(c).alias("name"), F.col(c).alias("v")) for c in cols))
    said = F.transform(F.slice(F.array_sort(each), 1, k), lambda x: F.format_string("%s %+.4f", x["name"], F.round(x["v"], 4) + 0.0))
    return contributed.select(key, F.array_join(said, "; ").alias("effects"))


def explained(model: PipelineModel, rows: DataFrame, key: str, cols: list[str], k: int = 3) -> DataFrame:
    """(key, probability, predicted, effects) of each row: prediction with its largest contributions against the column means."""
    means = rows.agg(*(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in cols)).first().asDict()

    def score(df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("p", F.get(vector_to_array("probability"), F.lit(1)))

    why = effects_text(contributions(rows, key, cols, score, means), key, cols, k)
    return predict(model, rows, cols, [key]).join(why, key)


def objectives(auc: float, n_features: int, most: int = 50) -> tuple[float, float]:
    """(accuracy, parsimony), both between 0 and 1."""
    clip = lambda v: max(0.0, min(1.0, v))
    return clip(auc), 1.0 if n_features <= 0 else clip(1 - n_features / most)


_REGISTRY = "name string, version string, stage string, metrics string, at bigint"


def _log(store: str, rows: list[tuple]) -> None:
    SparkSession.active().createDataFrame(rows, _REGISTRY).coalesce(1).write.mode("append").parquet(f"{store}/registry")


def save_version(model: PipelineModel, store: str, name: str, version: str, metrics: dict[str, float]) -> None:
    """Writes the model first and its registry row after it, so a row never points at half a model."""
    model.write().overwrite().save(f"{store}/models/{name}/{version}")
    _log(store, [(name, version, "none", json.dumps(metrics, sort_keys=True), time.time_ns())])


def current_stages(log: DataFrame) -> DataFrame:
    """(name, version, stage) from a log (name, version, stage, at): the stage last asked for, unless another version took it later.

    A stage but "none" has one holder per name: the version that asked last.
    """
    last = log.groupBy("name", "version").agg(F.max_by("stage", "at").alias("stage"), F.max("at").alias("at"))
    taken = log.filter("stage <> 'none'").groupBy("name", "stage").agg(F.max_by("version", "at").alias("holder"))
    j = last.join(taken, ["name", "stage"], "left")
    kept = (F.col("stage") != "none") & (F.col("holder") == F.col("version"))
    return j.select("name", "version", F.when(kept, F.col("stage")).otherwise("none").alias("stage"))


def promote(store: str, name: str, version: str, stage: str = "production") -> None:
    """Gives a version a stage; a version that held it before has none from then on."""
    if stage not in STAGES:
        raise ValueError(f"stage is one of {', '.join(STAGES)}")
    spark = SparkSession.active()
    known = spark.read.schema(_REGISTRY).parquet(f"{store}/registry").filter((F.col("name") == name) & (F.col("version") == version))
    if known.isEmpty():
        raise ValueError(f"no version {version} of {name}")
    _log(store, [(name, version, stage, None, time.time_ns())])


def versions(store: str, name: str | None = None) -> DataFrame:
    """(name, version, stage, metrics) of the registry."""
    log = SparkSession.active().read.schema(_REGISTRY).parquet(f"{store}/registry")
    log = log.filter(F.col("name") == name) if name else log
    metrics = log.filter("metrics is not null").groupBy("name", "version").agg(F.max_by("metrics", "at").alias("metrics"))
    return current_stages(log).join(metrics, ["name", "version"], "left")


def latest_version(store: str, name: str, stage: str | None = None) -> str | None:
    """The last version by name, of those at a stage if one is given."""
    v = versions(store, name)
    return (v.filter(F.col("stage") == stage) if stage else v).agg(F.max("version")).first()[0]


def load_version(store: str, name: str, version: str | None = None) -> PipelineModel:
    return PipelineModel.load(f"{store}/models/{name}/{version or latest_version(store, name)}")


def _there(path: str) -> bool:
    sc = SparkSession.active().sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at)


def resolve_model(store: str, name: str, phase: int | None = None) -> str | None:
    """Path of the model to serve: that of the phase, else the version in production, else the latest, else a file of its name."""
    if phase is not None and _there(f"{store}/phases/{phase}/{name}"):
        return f"{store}/phases/{phase}/{name}"
    if _there(f"{store}/registry"):
        v = latest_version(store, name, "production") or latest_version(store, name)
        if v and _there(f"{store}/models/{name}/{v}"):
            return f"{store}/models/{name}/{v}"
    return f"{store}/files/{name}" if _there(f"{store}/files/{name}") else None


def retrain(
    train: DataFrame, valid: DataFrame, cols: list[str], name: str, store: str, version: str, rollouts: int = 10, stage: str | None = "staging"
) -> tuple[list[str], list[float]]:
    """(features, objectives): searches over features to leave out, refits the best set on all rows and saves it.

    Each set is scored by the area under the curve on ``valid`` and by its size; the saved model holds the stage.
    """
    from lodestream.operators.evaluation import curve_metrics
    from lodestream.operators.search import tree_search

    def evaluate(left_out: tuple[str, ...]) -> tuple[list[float], list[str]]:
        kept = [c for c in cols if c not in left_out]
        models, failures = train_all(train, kept, [name])
        if failures:
            return [0.0, 0.0], []
        scored = predict(models[name], valid, kept, ["label"]).select("label", F.col("probability").alias("score"))
        auc = curve_metrics(scored).first()["roc_auc"]
        return list(objectives(auc, len(kept))), [c for c in kept if len(kept) > 1]

    best = tree_search((), evaluate, rollouts)
    kept = [c for c in cols if c not in best.features]
    model = pipeline(name, kept).fit(as_doubles(train.unionByName(valid).filter("label is not null"), [*kept, "label"]))
    save_version(model, store, name, version, {"roc_auc": best.own[0], "features": len(kept)})
    if stage:
        promote(store, name, version, stage)
    return kept, best.own
