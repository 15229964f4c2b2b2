"""Delay models: feature pipelines, estimators, ensembles, evaluation, registry."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Collection
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.risk import band_exclusive, delay_probability
from ..session import stored
from . import features as ft
from .joins import BROADCAST_ROWS, asset_statistics

LABEL = "label"

BASE_NUMERIC = [
    "latitude", "longitude", "inventory_level", "temperature", "humidity", "waiting_time",
    "user_transaction_amount", "user_purchase_frequency", "asset_utilization", "demand_forecast",
]
BASE_TIME = ["hour", "day_of_week", "month"]
BASE_CATEGORIES = ["asset_id", "traffic_status"]
LEAKING_CATEGORIES = ["shipment_status", "logistics_delay_reason"]

FULL_NUMERIC = [
    "latitude", "longitude", "distance_traveled", "fuel_efficiency", "waiting_time", "distance_from_origin", "risk_score",
    "hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos",
    "asset_delay_hours_mean", "asset_delay_hours_std", "asset_delay_hours_count",
    "asset_fuel_efficiency_mean", "asset_distance_traveled_mean",
]
FULL_PLAIN = ["hour", "day_of_week", "month", "quarter"]
FULL_CATEGORIES = ["asset_id", "traffic_conditions", "weather_conditions", "lat_region", "lon_region"]

VOYAGE_NUMERIC = ["cargo_weight", "cargo_value", "cargo_weight_log", "route_complexity", "is_international", "is_priority_flag",
                  "weather_severity_score", "route_avg_delay", "route_delay_std", "route_median_delay", "route_frequency"]
VOYAGE_CATEGORIES = ["origin_port", "destination_port", "cargo_type", "container_type"]


# --- feature plans -----------------------------------------------------------------------
@dataclass
class Features:
    """A fitted feature plan: scaled numbers, plain numbers, and category codes as a table.

    The vocabulary is never on the driver or in a plan's text: a column's codes are rows
    of ``codes``, and rows meet them by a join.
    """

    codes: DataFrame
    sizes: dict[str, int]
    scaling: dict[str, tuple[float, float]]
    plain: list[str]
    categories: list[str]
    unseen: int = 0
    reject_unseen: bool = False

    @property
    def names(self) -> list[str]:
        return [*self.scaling, *self.plain, *self.categories]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the vector ``features``; values that were not seen get one code, or fail the job."""
        out = df
        for c in self.categories:
            own = self.codes.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").alias(f"_{c}_code"))
            # broadcast by the number of codes counted when the plan was fitted
            own = F.broadcast(own) if self.sizes.get(c, 0) <= BROADCAST_ROWS else own
            out = out.join(own, F.coalesce(F.col(c).cast("string"), F.lit("unknown")) == F.col("_value"), "left").drop("_value")
        number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        strange = lambda c: F.raise_error(F.concat(F.lit(f"unseen {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast("double")
        code = lambda c: F.coalesce(F.col(f"_{c}_code").cast("double"), strange(c) if self.reject_unseen else F.lit(float(self.unseen)))
        inputs = {
            **{f"_{c}_scaled": (number(c) - m) / s for c, (m, s) in self.scaling.items()},
            **{f"_{c}_plain": number(c) for c in self.plain},
            **{f"_{c}_code": code(c) for c in self.categories},
        }
        assembler = VectorAssembler(inputCols=list(inputs), outputCol="features", handleInvalid="keep")
        return assembler.transform(out.withColumns(inputs)).drop(*inputs)

    def save(self, path: str) -> dict:
        """Write the codes as a table; returns the rest of the plan for the manifest."""
        self.codes.write.parquet(f"{path}/codes")
        return {k: getattr(self, k) for k in ("sizes", "scaling", "plain", "categories", "unseen", "reject_unseen")}

    @staticmethod
    def load(spark: SparkSession, path: str, plan: dict) -> Features:
        codes = spark.read.schema("column string, value string, code int").parquet(f"{path}/codes")
        return Features(codes, **{**plan, "scaling": {c: tuple(v) for c, v in plan["scaling"].items()}})


def fit_features(
    df: DataFrame, numeric: list[str], plain: list[str], categories: list[str], unseen: int = 0, reject_unseen: bool = False
) -> Features:
    """Learn scales (population deviation, a few numbers) and codes (a written table) from training rows."""
    codes = stored(ft.fit_codes(df, categories), "codes")
    sizes = {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count("*").alias("n")).collect()}
    return Features(codes, sizes, ft.fit_scaling(df, numeric), plain, categories, unseen, reject_unseen)


def base_rows(readings: DataFrame) -> DataFrame:
    """Columns of the base classifier: readings plus hour, weekday and month."""
    timed = ft.time_features(readings)
    return timed.withColumns({c: F.coalesce(F.col(c), F.lit("unknown")) for c in BASE_CATEGORIES})


def base_features(train: DataFrame, with_leaking: bool = False) -> Features:
    return fit_features(train, BASE_NUMERIC, BASE_TIME, BASE_CATEGORIES + (LEAKING_CATEGORIES if with_leaking else []), unseen=-1)


def full_rows(readings: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    """Columns of the full feature set; pass the training rows' asset statistics when scoring."""
    rows = ft.time_features(ft.derived_training_columns(readings))
    rows = ft.delay_features(ft.location_features(rows))
    stats = asset_statistics(rows) if statistics is None else statistics
    return ft.asset_features(rows, stats).withColumns(
        {c: F.coalesce(F.col(c), F.lit("unknown")) for c in FULL_CATEGORIES}
    )


def full_features(train: DataFrame) -> Features:
    return fit_features(train, FULL_NUMERIC, FULL_PLAIN, FULL_CATEGORIES)


def voyage_rows(voyages: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    rows = ft.voyage_temporal_features(voyages, "scheduled_departure", "scheduled_arrival")
    rows = ft.external_features(ft.historical_features(ft.cargo_features(ft.route_features(rows)), statistics))
    return rows.withColumn("is_priority_flag", F.col("is_priority").cast("int"))


def voyage_features(train: DataFrame) -> Features:
    calendar = [c for p in ("scheduled_departure", "scheduled_arrival") for c in train.columns if c.startswith(p + "_")]
    return fit_features(train, VOYAGE_NUMERIC, calendar, VOYAGE_CATEGORIES, reject_unseen=True)


# --- estimators -------------------------------------------------------------------------
#: A core's share is dealt from twice so many rows on; a partition holds no more than the second.
DEALT_ROWS, PART_ROWS = 25_000, 500_000


def dealt(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The same rows spread evenly over the cores.

    Trees are grown by hundreds of passes over the training rows, with one task per partition
    of the scan; a table of a few row groups would keep as many cores busy.  Small tables stay
    as they are.
    """
    rows = df.count() if rows is None else rows
    cores = df.sparkSession.sparkContext.defaultParallelism
    share = min(cores, rows // DEALT_ROWS)
    return df.repartition(max(share, -(-rows // PART_ROWS))) if share > 1 else df


def dealt_once(df: DataFrame, rows: int) -> DataFrame:
    """Dealt rows that several steps read, kept so that they are read and parsed once, by all cores.  Small tables stay as they are."""
    out = dealt(df, rows)
    return out if out is df else out.persist()


def classifiers(rows: int, seed: int = 42, boosting_rounds: int = 100) -> dict[str, Estimator]:
    """Named classifiers.  ``rows`` turns the inverse regularisation C=1 into a per-row weight.

    The forest keeps each row's node of every tree, so that a pass doesn't walk the trees from their roots.
    These are not written as a checkpoint: ten passes make no long lineage, and they are 400 bytes a row.
    """
    common = {"labelCol": LABEL, "featuresCol": "features"}
    boosted = {**common, "maxIter": boosting_rounds, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": seed}
    return {
        "RandomForest": RandomForestClassifier(numTrees=100, maxDepth=10, minInstancesPerNode=2, cacheNodeIds=True, checkpointInterval=-1, seed=seed, **common),
        "LogisticRegression": LogisticRegression(
            maxIter=1000, tol=1e-4, regParam=1.0 / max(rows, 1), elasticNetParam=0.0, standardization=False, **common
        ),
        "GradientBoosting": GBTClassifier(**boosted),
        "ColumnSampledBoosting": GBTClassifier(featureSubsetStrategy="0.8", **boosted),
    }


def regressors(seed: int = 42, boosting_rounds: int = 100) -> dict[str, Estimator]:
    common = {"labelCol": LABEL, "featuresCol": "features", "seed": seed}
    return {
        "boosted": GBTRegressor(maxIter=boosting_rounds, maxDepth=6, stepSize=0.1, subsamplingRate=0.8, **common),
        "random_forest": RandomForestRegressor(numTrees=100, maxDepth=10, cacheNodeIds=True, **common),
    }


REGRESSION_WEIGHTS = {"boosted": 0.4, "random_forest": 0.3}


def at_once(spark: SparkSession, work: dict[str, Callable]) -> dict:
    """What each function returns, by name; they run at the same time with the session's properties."""
    own = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max(len(work), 1)) as pool:
        running = {name: pool.submit(own(does)) for name, does in work.items()}
        return {name: one.result() for name, one in running.items()}


def narrowed(df: DataFrame) -> DataFrame:
    """Dealt rows in half as many partitions, where all of them would run at once."""
    parts, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(parts // 2) if 2 < parts <= cores else df


def beside_boosting(rows: int) -> list[str]:
    """Models that leave cores to the boosting chains; small tables, which are not dealt, keep their partitions."""
    return ["RandomForest"] if rows >= 2 * DEALT_ROWS else []


def fit_all(estimators: dict[str, Estimator], vectors: DataFrame, beside: Collection[str] = ()) -> dict[str, Model]:
    """All fitted models by name.  They are fitted at the same time: boosting is a chain of short jobs that leave cores idle.

    The models named in ``beside`` get half the cores.  A forest's few long tasks would otherwise
    hold every core while the chains wait, and the cores idle once the chains are left alone.
    """
    rows = {name: narrowed(vectors) if name in beside else vectors for name in estimators}
    return at_once(vectors.sparkSession, {name: lambda est=est, own=rows[name]: est.fit(own) for name, est in estimators.items()})


# --- scoring and evaluation ---------------------------------------------------------------
def score(model: Model, vectors: DataFrame) -> DataFrame:
    """Delay flag, probability, confidence and band; a model without probabilities counts as sure."""
    out = model.transform(vectors)
    if "probability" in out.columns:
        p = vector_to_array("probability")
        out = out.withColumns({"delay_probability": F.get(p, F.lit(1)), "confidence": F.array_max(p)})
    else:
        out = out.withColumns({"delay_probability": F.col("prediction"), "confidence": F.lit(1.0)})
    return out.withColumns({"will_delay": F.col("prediction") > 0.5, "risk_level": band_exclusive("delay_probability")})


def score_or_fallback(model: DelayModel | None, readings: DataFrame) -> DataFrame:
    """The registered model when there is one, else the additive heuristic."""
    if model is not None:
        return model.score(base_rows(readings))
    p = delay_probability("traffic_status", "waiting_time", "logistics_delay_reason")
    return readings.withColumn("delay_probability", p).withColumns(
        {
            "will_delay": F.col("delay_probability") > 0.5,
            "confidence": F.greatest(F.col("delay_probability"), 1 - F.col("delay_probability")),
            "risk_level": band_exclusive("delay_probability"),
        }
    )


def confusion_metrics(scored: DataFrame, label: str = LABEL) -> DataFrame:
    """Accuracy, weighted and binary precision, recall and F1 from one aggregate."""
    said, was = F.col("will_delay"), F.col(label) > 0.5
    c = scored.agg(
        F.count_if(said & was).cast("double").alias("tp"),
        F.count_if(said & ~was).cast("double").alias("fp"),
        F.count_if(~said & was).cast("double").alias("fn"),
        F.count_if(~said & ~was).cast("double").alias("tn"),
    )
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n, pos, neg = tp + fp + fn + tn, tp + fn, tn + fp
    c = c.select(
        div(tp + tn, n).alias("accuracy"),
        div(tp, tp + fp).alias("precision"), div(tp, pos).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"),
        div(tn, tn + fn).alias("p0"), div(tn, neg).alias("r0"), div(2 * tn, 2 * tn + fp + fn).alias("f0"),
        div(pos, n).alias("w1"), div(neg, n).alias("w0"),
    )
    w1, w0 = F.col("w1"), F.col("w0")
    return c.select(
        "accuracy", "precision", "recall", "f1",
        (F.col("precision") * w1 + F.col("p0") * w0).alias("weighted_precision"),
        (F.col("recall") * w1 + F.col("r0") * w0).alias("weighted_recall"),
        (F.col("f1") * w1 + F.col("f0") * w0).alias("weighted_f1"),
    )


def evaluate(model: Model, vectors: DataFrame) -> dict[str, float]:
    return evaluate_scored(score(model, vectors))


def evaluate_scored(scored: DataFrame) -> dict[str, float]:
    """Both kinds of figures from rows that are scored once.

    Models are evaluated in turn: the bins behind the area follow from the numbers of Spark's datasets,
    so its last digits would vary between runs if these were dealt out to several threads.
    """
    kept = scored.select(LABEL, "will_delay", "delay_probability").persist()
    out = confusion_metrics(kept).first().asDict()
    auc = BinaryClassificationEvaluator(labelCol=LABEL, rawPredictionCol="delay_probability", metricName="areaUnderROC")
    out["roc_auc"] = auc.evaluate(kept.select(LABEL, "delay_probability"))
    kept.unpersist()
    return out


def metrics_frame(spark: SparkSession, results: dict[str, dict[str, float]]) -> DataFrame:
    rows = [(i, name, *[float(v) for v in m.values()]) for i, (name, m) in enumerate(results.items())]
    names = list(next(iter(results.values())))
    return spark.createDataFrame(rows, "position int, model string, " + ", ".join(f"{n} double" for n in names))


def best_model(results: DataFrame, metric: str = "weighted_f1") -> DataFrame:
    """The first model, in training order, with the best value."""
    return results.agg(
        F.min_by("model", F.struct(-F.col(metric), F.col("position"))).alias("model"), F.max(metric).alias(metric)
    )


def ensemble_weights(models: dict[str, Model], validation: DataFrame) -> dict[str, float]:
    """Weighted F1 on validation rows, normalised; equal shares when all are zero."""
    work = {name: lambda m=m: confusion_metrics(score(m, validation)).first()["weighted_f1"] for name, m in models.items()}
    f1 = at_once(validation.sparkSession, work)
    total = sum(f1.values())
    return {k: v / total for k, v in f1.items()} if total > 0 else {k: 1.0 / len(f1) for k in f1}


def ensemble_score(models: dict[str, Model], weights: dict[str, float], vectors: DataFrame, key: str = "id") -> DataFrame:
    """Weighted mean of probabilities; the flag is the weighted vote above one half.

    Each model appends its own columns to the same rows, so no join is needed.
    """
    out = vectors
    vote, prob = F.lit(0.0), F.lit(0.0)
    total = sum(weights[n] for n in models)
    for name, model in models.items():
        tagged = model.copy({model.predictionCol: f"_v_{name}", model.probabilityCol: f"_p_{name}", model.rawPredictionCol: f"_r_{name}"})
        out = tagged.transform(out)
        vote = vote + F.col(f"_v_{name}") * weights[name]
        prob = prob + F.get(vector_to_array(f"_p_{name}"), F.lit(1)) * weights[name]
    out = out.withColumns({"_vote": vote / total, "delay_probability": prob / total})
    flagged = out.withColumns({"will_delay": F.col("_vote") > 0.5, "risk_level": band_exclusive("delay_probability")})
    return flagged.drop("_vote", *[f"{p}{n}" for n in models for p in ("_v_", "_p_", "_r_")])


def cross_validated_auc(estimator: Estimator, vectors: DataFrame, folds: int = 5, seed: int = 42) -> tuple[float, float]:
    """Mean and two deviations of the AUC over the folds."""
    cv = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=BinaryClassificationEvaluator(labelCol=LABEL),
        numFolds=folds,
        seed=seed,
    ).fit(vectors)
    return float(cv.avgMetrics[0]), 2 * float(cv.stdMetrics[0])


def importances(spark: SparkSession, model: Model, names: list[str]) -> DataFrame:
    """Feature and weight, largest first: impurity shares of trees, absolute coefficients of linear models."""
    values = model.featureImportances if hasattr(model, "featureImportances") else [abs(c) for c in model.coefficients]
    rows = [(n, float(v)) for n, v in zip(names, values)]
    found = spark.createDataFrame(rows, "feature string, importance double")
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))


# --- regressors ------------------------------------------------------------------------------
def regression_metrics(scored: DataFrame) -> dict[str, float]:
    ev = RegressionEvaluator(labelCol=LABEL, predictionCol="prediction")
    return {m: ev.evaluate(scored, {ev.metricName: m}) for m in ("mae", "mse", "rmse", "r2")}


def ensemble_hours(models: dict[str, Model], vectors: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted hours, never negative, and agreement of the models as confidence; weights count relative to those present."""
    weights = weights or REGRESSION_WEIGHTS
    out = vectors
    for name, model in models.items():
        out = model.copy({model.predictionCol: f"_h_{name}"}).transform(out)
    each = F.array(*[F.greatest(F.col(f"_h_{n}"), F.lit(0.0)) for n in models])
    share = sum(weights[n] for n in models)
    total = sum((F.greatest(F.col(f"_h_{n}"), F.lit(0.0)) * (weights[n] / share) for n in models), F.lit(0.0))
    shown = out.withColumns({"_each": each, "predicted_delay_hours": total})
    return shown.withColumn("confidence_score", agreement("_each")).drop("_each", *[f"_h_{n}" for n in models])


def agreement_of(mean, deviation, n):
    """1 / (1 + deviation / |mean|), with one in place of the ratio for a zero mean; one half for a single value."""
    mean, deviation, n = (F.col(c) if isinstance(c, str) else c for c in (mean, deviation, n))
    ratio = F.when(mean != 0, deviation / F.abs(mean)).otherwise(1.0)
    return F.when(n > 1, 1 / (1 + ratio)).otherwise(0.5)


def agreement(values: str):
    """The same over an array holding one value per model."""
    a = F.col(values)
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    variance = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    return agreement_of(mean, F.sqrt(variance), n)


# --- registry ---------------------------------------------------------------------------------
REGISTRY_SCHEMA = "name string, path string, saved_at timestamp, metadata string"


@dataclass
class DelayModel:
    """Feature plan, member models and their weights: what it takes to score raw rows."""

    features: Features
    members: dict[str, Model]
    weights: dict[str, float]

    def score(self, rows: DataFrame) -> DataFrame:
        """A single member scores by itself; several give their weighted mean and vote."""
        vectors = self.features.transform(rows)
        if len(self.members) == 1:
            return score(next(iter(self.members.values())), vectors)
        return ensemble_score(self.members, self.weights, vectors)

    def save(self, path: str) -> None:
        """Members, weights and feature codes in one folder; the manifest comes last and commits it."""
        spark = self.features.codes.sparkSession
        plan = self.features.save(f"{path}/features")
        for name, member in self.members.items():
            PipelineModel([member]).save(f"{path}/members/{name}")
        manifest = json.dumps({"features": plan, "members": list(self.members), "weights": self.weights})
        spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/manifest")

    @staticmethod
    def load(spark: SparkSession, path: str) -> DelayModel:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
        members = {name: PipelineModel.load(f"{path}/members/{name}").stages[0] for name in manifest["members"]}
        return DelayModel(Features.load(spark, f"{path}/features", manifest["features"]), members, manifest["weights"])


def save_model(spark: SparkSession, model: DelayModel, root: str, name: str, metadata: dict) -> str:
    """Store a model, single or ensemble, and one registry row; every save gets its own folder."""
    path = f"{root}/{name}_{time.strftime('%Y%m%d_%H%M%S')}_{time.time_ns() % 10**9:09d}"
    model.save(path)
    row = spark.createDataFrame([(name, path, json.dumps(metadata))], "name string, path string, metadata string")
    row.select("name", "path", F.current_timestamp().alias("saved_at"), "metadata").coalesce(1).write.mode("append").json(f"{root}/registry")
    return path


def list_models(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(REGISTRY_SCHEMA).json(f"{root}/registry").orderBy(F.col("saved_at").desc(), F.col("path").desc())


def load_newest(spark: SparkSession, root: str) -> DelayModel | None:
    from ..sources.files import path_exists

    if not path_exists(spark, f"{root}/registry"):
        return None
    found = spark.read.schema(REGISTRY_SCHEMA).json(f"{root}/registry").agg(F.max_by("path", F.struct("saved_at", "path"))).first()[0]
    return DelayModel.load(spark, found) if found else None


def fit_model(features: Features, estimator: Estimator, train: DataFrame, name: str = "model") -> DelayModel:
    """A model of one member, fitted on raw rows."""
    return DelayModel(features, {name: estimator.fit(features.transform(train))}, {name: 1.0})
