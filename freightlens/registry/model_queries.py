"""Features with SQL twins; fitted models with row checks only."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as ft, models, route_forecast
from ..operators.joins import route_statistics
from ..operators.metrics import one_row
from ..operators.windows import ranked
from ..session import new_path, stored
from ..sources import shapes
from .core import register
from .join_queries import _TRAIN

BOOSTING_ROUNDS = 100

_WAVE = "{f}(2 * pi() * {v} / {n})"
_TIME = ", ".join(
    f"{_WAVE.format(f=f, v=v, n=n)} AS {name}_{f}"
    for name, v, n in (("hour", "hour(ts)", 24), ("day", "(isodow(ts) - 1)", 7), ("month", "month(ts)", 12))
    for f in ("sin", "cos")
)


@register(
    "time_features",
    "M-01 X-01 X-05",
    f"SELECT id, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, month(ts) AS month, quarter(ts) AS quarter, {_TIME} FROM readings",
)
def time_features(spark, root):
    return ft.time_features(shapes.readings(spark, root).select("id", "ts")).drop("ts")


_BIN = "least(5, greatest(1, CAST(ceil(({c} - mn) / ((mx - mn) / 5)) AS INTEGER)))"


@register(
    "location_features",
    "M-02 W-08",
    f"""SELECT id, sqrt(latitude * latitude + longitude * longitude) AS distance_from_origin,
         (SELECT 'lat_' || CAST({_BIN.format(c='latitude')} AS VARCHAR) FROM (SELECT min(latitude) AS mn, max(latitude) AS mx FROM readings)) AS lat_region,
         (SELECT 'lon_' || CAST({_BIN.format(c='longitude')} AS VARCHAR) FROM (SELECT min(longitude) AS mn, max(longitude) AS mx FROM readings)) AS lon_region
       FROM readings""",
)
def location_features(spark, root):
    return ft.location_features(shapes.readings(spark, root).select("id", "latitude", "longitude")).drop("latitude", "longitude")


_WEATHER = """CASE WHEN coalesce(temperature, 20) < 0 THEN 'Snowy' WHEN coalesce(humidity, 60) > 75 AND coalesce(temperature, 20) > 28 THEN 'Stormy'
  WHEN coalesce(humidity, 60) > 75 THEN 'Rainy' WHEN coalesce(humidity, 60) > 65 THEN 'Cloudy' ELSE 'Clear' END"""


@register(
    "training_derivations",
    "M-29",
    f"SELECT t.*, {_WEATHER} AS weather_conditions FROM ({_TRAIN}) t JOIN (SELECT id, temperature, humidity FROM readings) r USING (id)",
)
def training_derivations(spark, root):
    return ft.derived_training_columns(shapes.readings(spark, root)).select(
        "id", "asset_id", "delay_hours", "distance_traveled", "fuel_efficiency", "weather_conditions"
    )


@register(
    "delay_features",
    "M-03 U-03",
    f"""WITH t AS (SELECT r.traffic_status, x.*, {_WEATHER} AS w FROM ({_TRAIN}) x JOIN readings r USING (id))
       SELECT id, CASE WHEN delay_hours > 0 THEN 1 ELSE 0 END AS is_delayed,
         least(10, CASE traffic_status WHEN 'Heavy' THEN 3 WHEN 'Moderate' THEN 1 ELSE 0 END
           + CASE w WHEN 'Stormy' THEN 3 WHEN 'Rainy' THEN 2 WHEN 'Snowy' THEN 2 WHEN 'Cloudy' THEN 1 ELSE 0 END
           + CASE WHEN fuel_efficiency < 8 THEN 2 WHEN fuel_efficiency < 10 THEN 1 ELSE 0 END
           + CASE WHEN distance_traveled > 1000 THEN 2 WHEN distance_traveled > 500 THEN 1 ELSE 0 END) AS risk_score FROM t""",
)
def delay_features(spark, root):
    return ft.delay_features(ft.derived_training_columns(shapes.readings(spark, root))).select("id", "is_delayed", "risk_score")


@register(
    "label_codes",
    "M-05 U-04",
    """WITH c AS (SELECT origin_port, dense_rank() OVER (ORDER BY origin_port) - 1 AS code FROM (SELECT DISTINCT origin_port FROM voyages WHERE status <> 'pending'))
       SELECT v.id, coalesce(c.code, -1) AS origin_port_encoded FROM (SELECT id, CASE WHEN id % 29 = 0 THEN 'NOWHERE' ELSE origin_port END AS origin_port FROM voyages) v
       LEFT JOIN c USING (origin_port)""",
)
def label_codes(spark, root):
    voyages = shapes.voyages(spark, root)
    fitted = ft.fit_labels(voyages.filter(F.col("status") != "pending"), "origin_port")
    odd = voyages.select("id", F.when(F.col("id") % 29 == 0, "NOWHERE").otherwise(F.col("origin_port")).alias("origin_port"))
    return ft.encode_labels(odd, "origin_port", fitted, unseen=-1).select("id", "origin_port_encoded")


@register(
    "unseen_labels",
    "M-05",
    "SELECT id FROM voyages WHERE id % 29 = 0",
)
def unseen_labels(spark, root):
    """Rows the strict encoder refuses."""
    voyages = shapes.voyages(spark, root)
    odd = voyages.select("id", F.when(F.col("id") % 29 == 0, "NOWHERE").otherwise(F.col("origin_port")).alias("origin_port"))
    coded = ft.encode_labels(odd, "origin_port", ft.fit_labels(voyages, "origin_port"), unseen=None)
    return coded.filter(F.col("origin_port_encoded").isNull()).select("id")


@register(
    "scaled_features",
    "M-06",
    """SELECT id, (waiting_time - (SELECT avg(waiting_time) FROM readings)) / (SELECT stddev_pop(waiting_time) FROM readings) AS waiting_time,
         (coalesce(temperature, 0) - (SELECT avg(coalesce(temperature, 0)) FROM readings)) / (SELECT stddev_pop(coalesce(temperature, 0)) FROM readings) AS temperature
       FROM readings""",
)
def scaled_features(spark, root):
    rows = shapes.readings(spark, root).select("id", "waiting_time", "temperature")
    return ft.apply_scaling(rows, ft.fit_scaling(rows, ["waiting_time", "temperature"]))


_H = "CAST('0x' || substr(md5('42|' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT)"


@register(
    "stratified_split",
    "M-09",
    f"""SELECT id, logistics_delay, rn <= floor(n * 0.8e0) AS in_train FROM (SELECT id, logistics_delay,
         row_number() OVER (PARTITION BY logistics_delay ORDER BY {_H} % 65536, {_H}, id) AS rn, count(*) OVER (PARTITION BY logistics_delay) AS n FROM readings)""",
)
def stratified_split(spark, root):
    rows = shapes.readings(spark, root).select("id", "logistics_delay")
    return ft.with_split(rows, "logistics_delay", "id")


_PARTS = ", ".join(
    f"{e.format(c=c)} AS {c}_{n}"
    for c in ("scheduled_departure", "scheduled_arrival")
    for n, e in {
        "year": "year({c})", "month": "month({c})", "day": "day({c})", "dayofweek": "isodow({c}) - 1", "hour": "hour({c})",
        "quarter": "quarter({c})", "is_weekend": "CASE WHEN isodow({c}) >= 6 THEN 1 ELSE 0 END",
        "is_month_end": "CASE WHEN last_day({c}) = CAST({c} AS DATE) THEN 1 ELSE 0 END",
        "is_month_start": "CASE WHEN day({c}) = 1 THEN 1 ELSE 0 END",
    }.items()
)


@register("voyage_calendar", "M-21 X-01", f"SELECT id, {_PARTS} FROM voyages")
def voyage_calendar(spark, root):
    cols = ("scheduled_departure", "scheduled_arrival")
    return ft.voyage_temporal_features(shapes.voyages(spark, root).select("id", *cols), *cols).drop(*cols)


@register(
    "voyage_route_features",
    "M-22 X-08",
    """SELECT id, length(route) - length(replace(route, '-', '')) + 1 AS route_complexity,
         CASE WHEN left(origin_port, 2) <> left(destination_port, 2) THEN 1 ELSE 0 END AS is_international FROM voyages""",
)
def voyage_route_features(spark, root):
    return ft.route_features(shapes.voyages(spark, root)).select("id", "route_complexity", "is_international")


@register(
    "voyage_cargo_features",
    "M-23 X-07",
    """SELECT id, CASE WHEN cargo_weight <= 0 THEN NULL WHEN cargo_weight <= 1000 THEN 'very_light' WHEN cargo_weight <= 5000 THEN 'light'
         WHEN cargo_weight <= 10000 THEN 'medium' WHEN cargo_weight <= 50000 THEN 'heavy' ELSE 'very_heavy' END AS cargo_weight_category,
         ln(1 + cargo_weight) AS cargo_weight_log FROM voyages""",
)
def voyage_cargo_features(spark, root):
    return ft.cargo_features(shapes.voyages(spark, root)).select("id", "cargo_weight_category", "cargo_weight_log")


@register(
    "voyage_external_features",
    "M-25 C-26 J-09 U-05",
    """SELECT id, 0.5e0 + CASE WHEN month(scheduled_departure) IN (12, 1, 2) THEN 0.2e0 WHEN month(scheduled_departure) IN (6, 7, 8) THEN 0.1e0 ELSE 0e0 END
         AS weather_severity_score, 0e0 AS origin_congestion, 0e0 AS destination_congestion FROM voyages""",
)
def voyage_external_features(spark, root):
    return ft.external_features(shapes.voyages(spark, root)).select(
        "id", "weather_severity_score", "origin_congestion", "destination_congestion"
    )


# --- fitted models ----------------------------------------------------------------------
def _base_vectors(spark, root):
    """Train and test vectors of the base classifier, and the fitted feature plan."""
    rows = models.base_rows(shapes.readings(spark, root)).withColumn(models.LABEL, F.col("logistics_delay").cast("double"))
    total = rows.count()
    rows = models.dealt_once(rows, total)
    flagged = ft.with_split(rows, models.LABEL, "id")
    features = models.base_features(flagged.filter("in_train"))
    vectors = models.dealt(features.transform(flagged).select("id", models.LABEL, "features", "in_train"), total).persist()
    vectors.count()
    rows.unpersist()
    return vectors.filter("in_train").drop("in_train"), vectors.filter("NOT in_train").drop("in_train"), features, vectors


def _fit(spark, root, name):
    train, test, features, cached = _base_vectors(spark, root)
    model = models.classifiers(train.count(), boosting_rounds=BOOSTING_ROUNDS)[name].fit(train)
    return model, cached, test, features


def _register_classifier(query: str, name: str, covers: str) -> None:
    @register(query, covers)
    def run(spark, root):
        model, cached, test, _ = _fit(spark, root, name)
        found = models.metrics_frame(spark, {name: models.evaluate(model, test)})
        cached.unpersist()
        return found


_register_classifier("classifier_forest", "RandomForest", "M-08 M-10 M-15")
_register_classifier("classifier_logistic", "LogisticRegression", "M-11 M-15")
_register_classifier("classifier_boosted", "GradientBoosting", "M-12 M-15")
_register_classifier("classifier_column_sampled", "ColumnSampledBoosting", "M-13 M-15")


@register("full_feature_model", "M-07 M-04 M-16")
def full_feature_model(spark, root):
    """The full feature set; asset statistics come from training rows only."""
    raw = shapes.readings(spark, root)
    label = F.col("logistics_delay").cast("double").alias(models.LABEL)
    total = raw.count()
    raw = models.dealt_once(raw.select("*", label), total)
    flagged = ft.with_split(raw, models.LABEL, "id")
    statistics = models.asset_statistics(ft.derived_training_columns(flagged.filter("in_train")))
    full = models.full_rows(flagged, statistics).persist()
    prepared = models.full_features(full.filter("in_train"))
    vectors = models.dealt(prepared.transform(full).select("id", models.LABEL, "features", "in_train"), total).persist()
    train = vectors.filter("in_train")
    kinds = models.classifiers(train.count(), boosting_rounds=BOOSTING_ROUNDS)
    vectors.count()
    full.unpersist()
    raw.unpersist()
    members = models.fit_all(kinds, train, models.beside_boosting(total))
    out = models.metrics_frame(spark, {n: models.evaluate(m, vectors.filter("NOT in_train")) for n, m in members.items()})
    vectors.unpersist()
    return out


@register("classifier_ensemble", "M-14 M-16")
def classifier_ensemble(spark, root):
    """All models weighted by validation F1; the best of them and their ensemble by weighted F1."""
    train, test, _, cached = _base_vectors(spark, root)
    total = train.count()
    halves = models.dealt(ft.with_split(train, models.LABEL, "id", seed=7), total).persist()
    fit_rows, validation = halves.filter("in_train").drop("in_train"), halves.filter("NOT in_train").drop("in_train")
    members = models.fit_all(models.classifiers(total, boosting_rounds=BOOSTING_ROUNDS), fit_rows, models.beside_boosting(total))
    weights = models.ensemble_weights(members, validation)
    halves.unpersist()
    results = {name: models.evaluate(m, test) for name, m in members.items()}
    results["Ensemble"] = models.evaluate_scored(models.ensemble_score(members, weights, test))
    cached.unpersist()
    table = models.metrics_frame(spark, results)
    best = models.best_model(table).select(F.col("model").alias("best"))
    return table.withColumn("best", best.scalar())


@register("cross_validation", "M-17")
def cross_validation(spark, root):
    train, _, _, cached = _base_vectors(spark, root)
    mean, spread = models.cross_validated_auc(models.classifiers(train.count())["RandomForest"], train)
    cached.unpersist()
    return spark.createDataFrame([(mean, spread)], "mean_auc double, two_std double")


@register("feature_importance", "M-18 W-10")
def feature_importance(spark, root):
    model, cached, _, features = _fit(spark, root, "RandomForest")
    cached.unpersist()
    return models.importances(spark, model, features.names)


@register("batch_scoring", "M-19 C-19")
def batch_scoring(spark, root):
    """Scores of every reading, those the model learned from included."""
    model, vectors, _, _ = _fit(spark, root, "LogisticRegression")
    out = stored(models.score(model, vectors).select("id", "will_delay", "delay_probability", "confidence", "risk_level"), "scores")
    vectors.unpersist()
    return out


@register(
    "batch_scoring_rules",
    "M-19 C-19",
    """SELECT count(*) AS scored, count(DISTINCT id) AS readings, CAST(0 AS BIGINT) AS wrong_flags, CAST(0 AS BIGINT) AS wrong_bands,
         CAST(0 AS BIGINT) AS wrong_confidence, true AS in_range FROM readings""",
)
def batch_scoring_rules(spark, root):
    """Flag, band and confidence of every score follow from its probability, whatever the model learned."""
    p = F.col("delay_probability")
    band = F.when(p > 0.8, "High").when(p > 0.5, "Medium").when(p > 0.2, "Low").otherwise("Very Low")
    return batch_scoring(spark, root).agg(
        F.count("*").alias("scored"),
        F.count_distinct("id").alias("readings"),
        F.count_if(F.col("will_delay") != (p > 0.5)).alias("wrong_flags"),
        F.count_if(F.col("risk_level") != band).alias("wrong_bands"),
        F.count_if(F.abs(F.col("confidence") - F.greatest(p, 1 - p)) > 1e-12).alias("wrong_confidence"),
        F.bool_and(p.between(0, 1)).alias("in_range"),
    )


@register("model_registry", "S-12 M-20 M-30")
def model_registry(spark, root):
    """Save twice, list, load the newest and evaluate it on the rows it was not fitted on."""
    rows = models.base_rows(shapes.readings(spark, root)).withColumn(models.LABEL, F.col("logistics_delay").cast("double"))
    train, test = ft.stratified_split(rows, models.LABEL, "id")
    folder = new_path(spark, "models")
    fitted = models.fit_model(models.base_features(train), models.classifiers(train.count())["LogisticRegression"], train, "LogisticRegression")
    for version in ("1", "2"):
        models.save_model(spark, fitted, folder, "LogisticRegression", {"version": version})
    newest = models.load_newest(spark, folder)
    saved = models.list_models(spark, folder).agg(F.count("*").alias("models"), F.max("metadata").alias("newest"))
    return one_row(saved, models.metrics_frame(spark, {"LogisticRegression": models.evaluate_scored(newest.score(test))}))


@register(
    "saved_ensemble",
    "S-12 M-14 M-20",
    "SELECT count(*) AS scored, 0 AS different, 1 AS registered, 'Ensemble' AS name, true AS in_range FROM readings",
)
def saved_ensemble(spark, root):
    """An ensemble saved with its weights and codes scores every reading as the one in memory does."""
    rows = models.base_rows(shapes.readings(spark, root)).withColumn(models.LABEL, F.col("logistics_delay").cast("double"))
    flagged = ft.with_split(rows, models.LABEL, "id")
    features = models.base_features(flagged.filter("in_train"))
    total = rows.count()
    vectors = models.dealt(features.transform(flagged).select(models.LABEL, "features", "in_train"), total).persist()
    train = vectors.filter("in_train")
    kinds = models.classifiers(train.count())
    members = models.fit_all({n: kinds[n] for n in ("LogisticRegression", "RandomForest")}, train)
    fitted = models.DelayModel(features, members, models.ensemble_weights(members, vectors.filter("NOT in_train")))
    vectors.unpersist()
    rows = models.dealt(rows, total)
    folder = new_path(spark, "ensembles")
    models.save_model(spark, fitted, folder, "Ensemble", {"members": list(members)})
    loaded = models.load_newest(spark, folder)
    pick = ["id", "will_delay", "delay_probability", "risk_level"]
    before = stored(fitted.score(rows).select(pick), "scores")
    after = loaded.score(rows).select("id", *[F.col(c).alias(f"{c}_2") for c in pick[1:]])
    unequal = ~(F.col("will_delay").eqNullSafe(F.col("will_delay_2")) & (F.col("delay_probability") == F.col("delay_probability_2")) & F.col("risk_level").eqNullSafe(F.col("risk_level_2")))
    figures = before.join(after, "id").agg(
        F.count("*").alias("scored"), F.count_if(unequal).cast("int").alias("different"), F.bool_and(F.col("delay_probability").between(0, 1)).alias("in_range")
    )
    listed = models.list_models(spark, folder).agg(F.count("*").cast("int").alias("registered"), F.max("name").alias("name"))
    return one_row(figures, listed)


@register(
    "score_with_fallback",
    "M-30 C-17",
    """SELECT id, delay_probability, delay_probability > 0.5e0 AS will_delay, greatest(delay_probability, 1 - delay_probability) AS confidence,
         CASE WHEN delay_probability > 0.8e0 THEN 'High' WHEN delay_probability > 0.5e0 THEN 'Medium' WHEN delay_probability > 0.2e0 THEN 'Low' ELSE 'Very Low' END AS risk_level
       FROM scored""",
)
def score_with_fallback(spark, root):
    out = models.score_or_fallback(models.load_newest(spark, new_path(spark, "models")), shapes.readings(spark, root))
    return out.select("id", "delay_probability", "will_delay", "confidence", "risk_level")


@register("voyage_regressors", "M-24 M-26 M-27")
def voyage_regressors(spark, root):
    """Delay hours by two regressors and their weighted ensemble; figures on held-out arrivals."""
    hours = route_forecast.hours_between("scheduled_arrival", "actual_arrival")
    arrived = shapes.voyages(spark, root).filter(F.col("actual_arrival").isNotNull()).withColumn(models.LABEL, hours)
    flagged = ft.with_split(arrived.withColumn("side", F.lit(1)), "side", "id").drop("side")
    statistics = route_statistics(flagged.filter("in_train"))
    full = models.voyage_rows(flagged, statistics).persist()
    prepared = models.voyage_features(full.filter("in_train").drop("in_train"))
    vectors = models.dealt(prepared.transform(full).select("id", models.LABEL, "features", "in_train"), full.count()).persist()
    test = vectors.filter("NOT in_train")
    members = models.fit_all(models.regressors(boosting_rounds=BOOSTING_ROUNDS), vectors.filter("in_train"))
    results = {n: models.regression_metrics(m.transform(test)) for n, m in members.items()}
    joint = models.ensemble_hours(members, test).withColumn("prediction", F.col("predicted_delay_hours"))
    results["ensemble"] = models.regression_metrics(joint)
    full.unpersist()
    vectors.unpersist()
    return models.metrics_frame(spark, results)


@register("route_forecast", "M-28 U-06")
def route_forecast_query(spark, root):
    v = shapes.voyages(spark, root)
    return route_forecast.predict(v, route_forecast.fit(v)).select("id", "route", "predicted_delay_hours")


@register(
    "model_agreement",
    "M-27",
    """SELECT shipment_id, hours, CASE WHEN n > 1 THEN 1 / (1 + CASE WHEN hours <> 0 THEN sd / abs(hours) ELSE 1 END) ELSE 0.5e0 END AS confidence
       FROM (SELECT shipment_id, avg(predicted_delay_hours) AS hours, stddev_pop(predicted_delay_hours) AS sd, count(*) AS n FROM predictions GROUP BY 1)""",
)
def model_agreement(spark, root):
    moments = shapes.predictions(spark, root).groupBy("shipment_id").agg(
        F.avg("predicted_delay_hours").alias("hours"),
        F.stddev_pop("predicted_delay_hours").alias("deviation"),
        F.count("*").alias("n"),
    )
    return moments.select("shipment_id", "hours", models.agreement_of("hours", "deviation", "n").alias("confidence"))


@register(
    "top_predictions",
    "W-10",
    """SELECT model_name, hours, row_number() OVER (ORDER BY hours DESC, model_name) AS rank
       FROM (SELECT model_name, avg(predicted_delay_hours) AS hours FROM predictions GROUP BY 1)""",
)
def top_predictions(spark, root):
    means = shapes.predictions(spark, root).groupBy("model_name").agg(F.avg("predicted_delay_hours").alias("hours"))
    return ranked(means, "hours", "model_name")
