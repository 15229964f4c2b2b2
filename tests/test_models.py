"""Model invariants, and the route forecast against plain least squares."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightlens.operators import models, route_forecast
from freightlens.registry.model_queries import _base_vectors
from freightlens.sources import shapes


def test_route_forecast_equals_row_wise_least_squares(spark):
    rnd = random.Random(3)
    rows, x, y = [], [], []
    for i in range(80):
        day = dt.datetime(2020, 1, 1) + dt.timedelta(days=rnd.randrange(700))
        weight, priority, hours = rnd.uniform(0, 30000), rnd.random() < 0.4, rnd.uniform(-5, 40)
        hours = round(hours * 3600) / 3600
        rows.append((i, "A-B", day, day, day + dt.timedelta(hours=hours), weight, priority))
        years = ((day.date() - dt.date(2000, 1, 1)).days) / 365.25
        waves = [f(2 * np.pi * k * years) for k in (1, 2, 3) for f in (np.sin, np.cos)]
        x.append([1.0, years, *[float(day.weekday() == d) for d in range(1, 7)], *waves, weight / 1000, float(priority)])
        y.append(hours)
    rows.append((900, "C-D", rows[0][2], rows[0][3], rows[0][4], 1.0, False))
    df = spark.createDataFrame(
        rows, "id bigint, route string, scheduled_departure timestamp_ntz, scheduled_arrival timestamp_ntz, actual_arrival timestamp_ntz, cargo_weight double, is_priority boolean"
    )
    out = {r["id"]: r["predicted_delay_hours"] for r in route_forecast.predict(df, route_forecast.fit(df)).collect()}
    beta, *_ = np.linalg.lstsq(np.array(x), np.array(y), rcond=None)
    want = np.maximum(np.array(x) @ beta, 0)
    assert [out[i] for i in range(80)] == pytest.approx(want.tolist(), abs=1e-5)
    assert out[900] == 0.0  # one arrival is not enough


def test_scores_are_probabilities_and_ensemble_is_their_mean(spark, root):
    train, test, plan, cached = _base_vectors(spark, root)
    two = {k: v for k, v in models.classifiers(train.count()).items() if k in ("LogisticRegression",)}
    two["Small"] = models.RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=5, seed=1)
    members = models.fit_all(two, train)
    weights = models.ensemble_weights(members, test)
    assert sum(weights.values()) == pytest.approx(1)
    each = {n: {r["id"]: r["delay_probability"] for r in models.score(m, test).collect()} for n, m in members.items()}
    joint = models.ensemble_score(members, weights, test).collect()
    for r in joint:
        assert 0 <= r["delay_probability"] <= 1
        assert r["delay_probability"] == pytest.approx(sum(weights[n] * each[n][r["id"]] for n in members))
    named = models.importances(spark, members["Small"], plan.names).collect()
    assert len(named) == 15 and [r["rank"] for r in named] == list(range(1, 16))
    cached.unpersist()


def test_confusion_figures(spark):
    rows = [(True, 1.0)] * 3 + [(True, 0.0)] + [(False, 1.0)] * 2 + [(False, 0.0)] * 4
    m = models.confusion_metrics(spark.createDataFrame(rows, "will_delay boolean, label double")).first()
    assert m["accuracy"] == pytest.approx(0.7) and m["precision"] == pytest.approx(0.75) and m["recall"] == pytest.approx(0.6)
    assert m["weighted_recall"] == pytest.approx(0.7)


def test_agreement(spark):
    df = spark.createDataFrame([([2.0, 2.0],), ([1.0, 3.0],), ([5.0],), ([0.0, 0.0],)], "a array<double>")
    assert [r[0] for r in df.select(models.agreement("a")).collect()] == pytest.approx([1.0, 1 / 1.5, 0.5, 0.5])


def test_best_model_takes_the_first_of_equals(spark):
    table = models.metrics_frame(spark, {"a": {"weighted_f1": 0.4}, "b": {"weighted_f1": 0.9}, "c": {"weighted_f1": 0.9}})
    assert models.best_model(table).first()["model"] == "b"


def test_fallback_without_a_model(spark):
    df = spark.createDataFrame([("Heavy", 40, "Weather")], "traffic_status string, waiting_time int, logistics_delay_reason string")
    row = models.score_or_fallback(None, df).first()
    assert row["will_delay"] and row["delay_probability"] == pytest.approx(1.0) and row["risk_level"] == "High"
    assert models.load_newest(spark, "/tmp/no-such-folder") is None
    assert df.select(F.lit(1)).count() == 1


def test_codes_of_many_categories_are_rows(spark):
    n = 60_000
    df = spark.range(n).select(F.concat(F.lit("c"), F.lpad(((F.col("id") * 7919) % n).cast("string"), 6, "0")).alias("a"), (F.col("id") % 3).cast("string").alias("b"), F.lit(1.0).alias("x"), "id")
    plan = models.fit_features(df, ["x"], [], ["a", "b"], unseen=-1)
    assert plan.sizes == {"a": n, "b": 3} and plan.names == ["x", "a", "b"]
    odd = df.unionByName(spark.createDataFrame([("new", None, 1.0, -5)], "a string, b string, x double, id bigint"))
    out = plan.transform(odd)
    assert out.columns == [*df.columns, "features"]
    from pyspark.ml.functions import vector_to_array

    codes = out.select("a", "id", vector_to_array("features").alias("v"))
    wrong = codes.where("id >= 0").where(F.col("v")[1] != F.substring("a", 2, 6).cast("double"))
    assert wrong.count() == 0
    assert codes.where("id = -5").first()["v"][1:] == [-1.0, -1.0]
    assert "c000042" not in out._jdf.queryExecution().toString()


def test_strict_plans_refuse_unseen_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, x double")
    plan = models.fit_features(df, ["x"], [], ["k"], reject_unseen=True)
    assert plan.transform(df).count() == 2
    with pytest.raises(Exception, match="unseen k: c"):
        plan.transform(spark.createDataFrame([("c", 1.0)], "k string, x double")).collect()


def test_a_saved_ensemble_scores_equal(spark, root):
    from freightlens.session import new_path

    rows = models.base_rows(shapes.readings(spark, root)).withColumn("label", F.col("logistics_delay").cast("double"))
    plan = models.base_features(rows)
    vectors = plan.transform(rows)
    members = {"forest": models.RandomForestClassifier(labelCol="label", numTrees=3, seed=1).fit(vectors), "line": models.LogisticRegression(labelCol="label").fit(vectors)}
    model = models.DelayModel(plan, members, {"forest": 0.25, "line": 0.75})
    folder = new_path(spark, "ensemble")
    models.save_model(spark, model, folder, "Ensemble", {})
    loaded = models.load_newest(spark, folder)
    assert loaded.weights == model.weights and list(loaded.members) == ["forest", "line"]
    unknown = rows.withColumn("asset_id", F.when(F.col("id") % 5 == 0, "never seen").otherwise(F.col("asset_id")))
    score = lambda m: [tuple(r) for r in m.score(unknown).select("id", "delay_probability", "will_delay", "risk_level").orderBy("id").collect()]
    assert score(loaded) == score(model)


def test_training_rows_are_dealt_over_the_cores(spark):
    one_split = spark.range(0, 60_000, 1, 1).withColumn("x", F.col("id") % 7)
    out = models.dealt(one_split)
    assert out.rdd.getNumPartitions() == 2 and out.exceptAll(one_split).count() == 0 and out.count() == 60_000
    shares = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) == 2 and max(shares) < 1.1 * min(shares)
    assert models.dealt(one_split, 10**7).rdd.getNumPartitions() == 20  # no partition beyond PART_ROWS
    few = one_split.limit(100)
    assert models.dealt(few) is few
    forests = [models.classifiers(1)["RandomForest"], models.regressors()["random_forest"]]
    assert all(f.getCacheNodeIds() for f in forests)


def test_models_are_fitted_at_the_same_time(spark):
    import threading

    meeting = threading.Barrier(2, timeout=30)

    class Waits:
        def fit(self, vectors):
            meeting.wait()  # broken unless the other is being fitted as well
            return vectors

    rows = spark.range(1)
    assert models.fit_all({"a": Waits(), "b": Waits()}, rows) == {"a": rows, "b": rows}


def test_rows_are_scored_once_for_all_figures(spark):
    scorings = spark.sparkContext.accumulator(0)

    def scoring(p):
        scorings.add(1)
        return p

    rows = spark.createDataFrame([(i / 10, float(i > 4)) for i in range(10)], "p double, label double")
    scored = rows.withColumn("delay_probability", F.udf(scoring, "double")("p")).withColumn("will_delay", F.col("delay_probability") > 0.5)
    found = models.evaluate_scored(scored)
    assert found["roc_auc"] == pytest.approx(1.0) and found["accuracy"] == pytest.approx(0.9)
    assert scorings.value == 10


def test_validation_weights_are_taken_at_the_same_time(spark, monkeypatch):
    import threading

    meeting = threading.Barrier(2, timeout=30)
    half = spark.createDataFrame([(0.5,)], "weighted_f1 double")
    monkeypatch.setattr(models, "score", lambda m, df: (meeting.wait(), df)[1])
    monkeypatch.setattr(models, "confusion_metrics", lambda scored: half)
    assert models.ensemble_weights({"a": 1, "b": 2}, half) == {"a": 0.5, "b": 0.5}
    assert list(models.at_once(spark, {"x": lambda: 3, "y": lambda: 4}).items()) == [("x", 3), ("y", 4)]


def test_a_forest_beside_boosting_leaves_cores_to_it(spark):
    class Sees:
        def fit(self, vectors):
            return vectors.rdd.getNumPartitions(), sorted(r["id"] for r in vectors.collect())

    rows = spark.range(0, 12, 1, 4)
    assert spark.sparkContext.defaultParallelism >= 4
    assert models.fit_all({"forest": Sees(), "boosted": Sees()}, rows, beside=["forest"]) == {"forest": (2, [*range(12)]), "boosted": (4, [*range(12)])}
    assert models.narrowed(one := spark.range(0, 12, 1, 2)) is one
    many = spark.range(0, 1000, 1, spark.sparkContext.defaultParallelism + 1)
    assert models.narrowed(many) is many  # they run in waves already
    assert models.beside_boosting(60_000) == ["RandomForest"] and models.beside_boosting(10_000) == []


def test_forests_write_no_checkpoint_of_their_nodes(spark):
    assert models.classifiers(1)["RandomForest"].getCheckpointInterval() == -1


def test_rows_that_several_steps_read_are_kept(spark):
    few = spark.range(100)
    assert models.dealt_once(few, 100) is few
    out = models.dealt_once(spark.range(0, 60_000, 1, 1), 60_000)
    assert out.storageLevel.useMemory and out.storageLevel.useDisk
    assert out.rdd.getNumPartitions() == 2 and out.agg(F.sum("id")).first()[0] == 60_000 * 59_999 // 2
    out.unpersist()


@pytest.mark.parametrize("query", ["classifier_ensemble", "cross_validation", "full_feature_model"])
def test_training_queries_parse_large_tables_once(spark, query, tmp_path, monkeypatch):
    """The rows are dealt and kept before the split, the feature plan and the vectors read them."""
    from freightlens.catalog import QUERIES

    class Stop(Exception):
        pass

    def stop(df, *_):
        assert df.storageLevel.useMemory and df.rdd.getNumPartitions() == 2
        df.unpersist()
        raise Stop

    i = F.col("id")
    props = F.concat(F.lit('{"k": '), (i % 100).cast("string"), F.lit("}"))
    kind = F.when(i % 7 == 0, "error").otherwise("purchase")
    events = spark.range(0, 60_000, 1, 1).select(
        i.alias("event_id"), F.lit("2024-05-06 07:08:09").cast("timestamp_ntz").alias("ts"), (i % 50).alias("user_id"),
        kind.alias("event_type"), (i % 90).cast("double").alias("value"), props.alias("props"),
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr("freightlens.operators.features.with_split", stop)
    with pytest.raises(Stop):
        QUERIES[query](spark, str(tmp_path))
