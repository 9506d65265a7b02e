"""Encoding, model, metric, gate and row-selection queries (groups K, E15, E16, H, I, A5, A6)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from abode.catalog import register
from abode.catalog.sqltext import hash_u, price_dataset_sql, price_features_sql, with_listings
from abode.config import CREDIT, PRICE, SEARCH
from abode.operators import encode as K
from abode.operators import metrics as M
from abode.operators import model_store as ST
from abode.operators import models as MD
from abode.operators import search as SR
from abode.operators.split import hash_uniform, two_way_split
from abode.plans.credit import prepare_credit_dataset
from abode.plans.price import prepare_price_dataset, prepare_price_features
from abode.session import materialize, scratch_path
from abode.sources import files as A
from abode.sources.listing_view import listing_view

TE_COLS = PRICE["encoding"]["target_encoder_cols"]
PRICE_NUMERIC = ["building_size", "location_latitude", "location_longitude"]


def _split_features(spark, sf_dir):
    return two_way_split(prepare_price_features(listing_view(spark, sf_dir)), "listing_id", 0.2, 42)


_SPLIT_SQL = (f", f AS ({price_features_sql()}),\n"
              f"s AS (SELECT *, CASE WHEN {hash_u('listing_id', 42)} < 0.2 THEN 'val' ELSE 'train' END AS split FROM f)")


def _te_sql(mode: str) -> str:
    parts = []
    for c in TE_COLS:
        if mode == "sigmoid":
            enc = "prior * (1 - w) + m * w"
            inner = (f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS level, count(*) AS n, avg(price_value) AS m, "
                     f"sum(price_value) AS sm, 1.0 / (1.0 + exp(-(count(*) - 20.0) / 10.0)) AS w "
                     f"FROM s WHERE split = 'train' GROUP BY {c}")
        else:
            enc = "(sm + 10.0 * prior) / (n + 10.0)"
            inner = (f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS level, count(*) AS n, avg(price_value) AS m, "
                     f"sum(price_value) AS sm, 0.0 AS w FROM s WHERE split = 'train' GROUP BY {c}")
        parts.append(f"SELECT column_name, level, n, round({enc}, 2) AS encoding FROM ({inner}) x, "
                     f"(SELECT avg(price_value) AS prior FROM s WHERE split = 'train') p")
    return with_listings(_SPLIT_SQL + "\n" + "\nUNION ALL\n".join(parts))


def _te_table(spark, sf_dir, mode):
    d = _split_features(spark, sf_dir)
    table, prior = K.target_encoding_table(d.where(F.col("split") == "train"), TE_COLS, "price_value", 10.0, 20.0, mode)
    return d, table, prior


@register("k01_target_encoding_fit", _te_sql("sigmoid"))
def k01(spark, sf_dir):
    _, table, _ = _te_table(spark, sf_dir, "sigmoid")
    return table.select("column_name", "level", "n", F.round("encoding", 2).alias("encoding"))


@register("k01b_target_encoding_fit_additive", _te_sql("additive"))
def k01b(spark, sf_dir):
    _, table, _ = _te_table(spark, sf_dir, "additive")
    return table.select("column_name", "level", "n", F.round("encoding", 2).alias("encoding"))


def _te_apply_sql():
    joins, cols = [], []
    for i, c in enumerate(TE_COLS):
        joins.append(
            f"LEFT JOIN (SELECT CAST({c} AS VARCHAR) AS lvl{i}, prior * (1 - w) + m * w AS enc{i} FROM ("
            f"SELECT {c}, avg(price_value) AS m, 1.0 / (1.0 + exp(-(count(*) - 20.0) / 10.0)) AS w "
            f"FROM s WHERE split = 'train' GROUP BY {c}) x, (SELECT avg(price_value) AS prior FROM s WHERE split = 'train') p) t{i} "
            f"ON CAST(v.{c} AS VARCHAR) IS NOT DISTINCT FROM t{i}.lvl{i}")
        cols.append(f"round(coalesce(enc{i}, (SELECT avg(price_value) FROM s WHERE split = 'train')), 2) AS {c}_te")
    return with_listings(_SPLIT_SQL + f"\nSELECT v.listing_id, {', '.join(cols)} FROM (SELECT * FROM s WHERE split = 'val') v "
                         + " ".join(joins))


@register("k02_target_encoding_apply", _te_apply_sql())
def k02(spark, sf_dir):
    d, table, prior = _te_table(spark, sf_dir, "sigmoid")
    val = d.where(F.col("split") == "val").select("listing_id", *TE_COLS)
    out = K.apply_target_encoding(val, table, prior, TE_COLS)
    return out.select("listing_id", *[F.round(f"{c}_te", 2).alias(f"{c}_te") for c in TE_COLS])


OHE_COLS = ["cat2_slug", "cat3_slug", "rooms_count", "building_age", "luxury_score", "deed_type"]


@register("k03_one_hot_long", with_listings(_SPLIT_SQL + "\n" + "\nUNION ALL\n".join(
    f"SELECT listing_id, '{c}' AS column_name, {c} AS level FROM s WHERE split = 'val' AND "
    f"coalesce({c}, '__null__') IN (SELECT DISTINCT coalesce({c}, '__null__') FROM s WHERE split = 'train')"
    for c in OHE_COLS)))
def k03(spark, sf_dir):
    from pyspark.ml import Pipeline
    d = _split_features(spark, sf_dir)
    model = Pipeline(stages=K.one_hot_stages(OHE_COLS)).fit(d.where(F.col("split") == "train"))
    indexer = model.stages[1]
    labels = dict(zip(OHE_COLS, indexer.labelsArray))
    out = model.transform(d.where(F.col("split") == "val"))
    return K.one_hot_long(out, labels, OHE_COLS, "listing_id")


@register("k04_feature_columns_pre_assembly", f"""WITH s AS ({price_dataset_sql()})
SELECT v.listing_id, v.building_size,
  coalesce(CAST(v.is_rebuilt AS INTEGER), -1) AS is_rebuilt_code,
  coalesce(CAST(v.has_business_deed AS INTEGER), -1) AS has_business_deed_code,
  round(coalesce(t.enc, (SELECT avg(price_value) FROM s WHERE split = 'train')), 2) AS city_slug_te
FROM (SELECT * FROM s WHERE split = 'val') v
LEFT JOIN (SELECT CAST(city_slug AS VARCHAR) AS lvl, prior * (1 - w) + m * w AS enc FROM (
   SELECT city_slug, avg(price_value) AS m, 1.0 / (1.0 + exp(-(count(*) - 20.0) / 10.0)) AS w
   FROM s WHERE split = 'train' GROUP BY city_slug) x, (SELECT avg(price_value) AS prior FROM s WHERE split = 'train') p) t
ON CAST(v.city_slug AS VARCHAR) IS NOT DISTINCT FROM t.lvl""")
def k04(spark, sf_dir):
    d = _price_data(spark, sf_dir).withColumnRenamed("price_value", "label")
    pipe = K.feature_pipeline(PRICE, PRICE_NUMERIC, "label").fit(d.where(F.col("split") == "train"))
    out = pipe.transform(d.where(F.col("split") == "val"))
    return out.select("listing_id", "building_size", "is_rebuilt_code", "has_business_deed_code",
                      F.round("city_slug_te", 2).alias("city_slug_te"))


def _encoded_te(alias: str, c: str) -> str:
    """Target encoding of column ``c`` of the val rows ``alias``, as SQL."""
    return (f"coalesce((SELECT prior * (1 - w) + m * w FROM (SELECT {c} AS lvl, avg(price_value) AS m, 1.0 / (1.0 + exp(-(count(*) - 20.0) / 10.0)) AS w "
            f"FROM s WHERE split = 'train' GROUP BY {c}) x, prior WHERE x.lvl IS NOT DISTINCT FROM {alias}.{c}), (SELECT prior FROM prior))")


_ENC = PRICE["encoding"]
_FEATURES_SQL = f"""WITH s AS MATERIALIZED ({price_dataset_sql()}),
prior AS (SELECT avg(price_value) AS prior FROM s WHERE split = 'train'),
v AS (SELECT * FROM s WHERE split = 'val')"""


@register("k04b_feature_vector", _FEATURES_SQL + "\nSELECT * FROM (" + "\nUNION ALL\n".join(
    [f"SELECT listing_id, '{c}' AS feature, round({c}::DOUBLE, 5) AS value FROM v WHERE {c} <> 0" for c in PRICE_NUMERIC]
    + [f"SELECT listing_id, '{c}_te' AS feature, round({_encoded_te('v', c)}, 2) AS value FROM v" for c in TE_COLS]
    + [f"SELECT listing_id, '{c}_code' AS feature, round(coalesce(CAST({c} AS INTEGER), -1)::DOUBLE, 2) AS value FROM v WHERE coalesce(CAST({c} AS INTEGER), -1) <> 0"
       for c in _ENC["boolean_columns"]]
    + [f"SELECT listing_id, '{c}=' || coalesce(CAST({c} AS VARCHAR), '{K.NULL_LEVEL}') AS feature, 1.0::DOUBLE AS value FROM v "
       f"WHERE EXISTS (SELECT 1 FROM s WHERE split = 'train' AND s.{c} IS NOT DISTINCT FROM v.{c})" for c in _ENC["categorical_columns"]]) + ") u")
def k04b(spark, sf_dir):
    """K4: every slot of the assembled vectors of the val rows that is not 0, by name."""
    d = _price_data(spark, sf_dir).withColumnRenamed("price_value", "label")
    fitted = K.feature_pipeline(PRICE, PRICE_NUMERIC, "label").fit(d.where(F.col("split") == "train"))
    out = K.features_long(fitted.transform(d.where(F.col("split") == "val")), K.feature_names(fitted, PRICE, PRICE_NUMERIC), "listing_id")
    return out.select("listing_id", "feature", F.when(F.col("feature").endswith("_te"), F.round("value", 2)).otherwise(F.round("value", 5)).alias("value"))


@register("f05_columns_side_by_side", _FEATURES_SQL + "\nSELECT listing_id, " + ", ".join(
    [f"round({c}::DOUBLE, 5) AS {c}" for c in PRICE_NUMERIC] + [f"round({_encoded_te('v', c)}, 2) AS {c}_te" for c in TE_COLS]
    + [f"coalesce(CAST({c} AS INTEGER), -1) AS {c}_code" for c in _ENC["boolean_columns"]]
    + [f"coalesce(CAST({c} AS VARCHAR), '{K.NULL_LEVEL}') AS {c}_lvl" for c in _ENC["categorical_columns"]]) + " FROM v")
def f05(spark, sf_dir):
    """the encoders' columns beside the numeric ones, one frame and one row per listing, without a join by index."""
    d = _price_data(spark, sf_dir).withColumnRenamed("price_value", "label")
    fitted = K.feature_pipeline(PRICE, PRICE_NUMERIC, "label").fit(d.where(F.col("split") == "train"))
    out = fitted.transform(d.where(F.col("split") == "val"))
    return out.select("listing_id", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in PRICE_NUMERIC],
                      *[F.round(f"{c}_te", 2).alias(f"{c}_te") for c in TE_COLS],
                      *[f"{c}_code" for c in _ENC["boolean_columns"]], *[f"{c}_lvl" for c in _ENC["categorical_columns"]])


def _price_data(spark, sf_dir):
    """The prepared price dataset, written once: model fits run many jobs over it."""
    return materialize(prepare_price_dataset(listing_view(spark, sf_dir)), "price-prepared", "split")


def _fitted(data, *names, presets=None):
    """Models of the task's own presets, or of those given; all of them, or those named."""
    presets = PRICE["models"] if presets is None else presets
    return MD.train_and_evaluate(data, PRICE, {n: presets[n] for n in names or presets}, PRICE_NUMERIC, eval_splits=("val",))


def _trained(spark, sf_dir, *names, presets=None):
    return _fitted(_price_data(spark, sf_dir), *names, presets=presets)


@register("k07_train_evaluate")
def k07(spark, sf_dir, presets=None):
    _, _, metrics = _trained(spark, sf_dir, presets=presets)
    return metrics


@register("k05_random_forest_predictions")
def k05(spark, sf_dir):
    _, preds, _ = _trained(spark, sf_dir, "random_forest")
    return preds


@register("k06_gbt_predictions")
def k06(spark, sf_dir):
    _, preds, _ = _trained(spark, sf_dir, "lightgbm")
    return preds


@register("k08_pipeline_save_load_score")
def k08(spark, sf_dir):
    """A6 + K8 + K9: fit encoders+forest once, save, reload, batch-score val rows."""
    data = _price_data(spark, sf_dir)
    models, _, _ = _fitted(data, "random_forest")
    path = scratch_path(spark, "price-rf-pipeline")
    models["random_forest"].write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    val = data.where(F.col("split") == "val")
    return MD.batch_score(loaded, val, PRICE["inference_columns"])


def _mean_pipelines(train):
    """City means and the overall mean of the train prices as pipelines: name -> (pipeline, columns it needs)."""
    from pyspark.ml.feature import SQLTransformer
    labelled = train.withColumnRenamed("price_value", "label")
    means = K.SmoothedTargetEncoder(inputCols=["city_slug"], smoothing=0.0, mode="additive").fit(labelled)
    as_prediction = SQLTransformer(statement="SELECT *, city_slug_te AS prediction FROM __THIS__")
    overall = SQLTransformer(statement=f"SELECT *, CAST({means.getOrDefault('prior')!r} AS DOUBLE) AS prediction FROM __THIS__")
    pipelines = {"city_mean": PipelineModel(stages=[means, as_prediction]), "global_mean": PipelineModel(stages=[overall])}
    return {name: (p, ["city_slug"]) for name, p in pipelines.items()}


@register("k09_score_by_task_model", with_listings(_SPLIT_SQL + """,
cm AS (SELECT city_slug, avg(price_value) AS city_mean FROM s WHERE split = 'train' GROUP BY city_slug),
g AS (SELECT avg(price_value) AS gm FROM s WHERE split = 'train')
SELECT listing_id, 'city_mean' AS model, round(coalesce(city_mean, gm), 2) AS prediction FROM s LEFT JOIN cm USING (city_slug) CROSS JOIN g WHERE split = 'val'
UNION ALL SELECT listing_id, 'global_mean' AS model, round(gm, 2) AS prediction FROM s CROSS JOIN g WHERE split = 'val'"""))
def k09(spark, sf_dir):
    """K9: pipelines resolved in the model store by (task, model), one prediction per row."""
    store = scratch_path(spark, "model-store")
    d = _split_features(spark, sf_dir)
    for name, (pipeline, columns) in _mean_pipelines(d.where(F.col("split") == "train")).items():
        ST.publish(spark, store, "price", name, pipeline, columns)
    val = d.where(F.col("split") == "val").select("listing_id", "city_slug")
    out = None
    for name in ("city_mean", "global_mean"):
        scored = ST.score(spark, store, "price", name, val).select("listing_id", F.lit(name).alias("model"), F.round("prediction", 2).alias("prediction"))
        out = scored if out is None else out.unionByName(scored)
    return out


SCENARIOS = [
    {"scenario": "bigger", "set": {"building_size": 150.0}},
    {"scenario": "no_city", "set": {"city_slug": None}},
    {"scenario": "new_building", "set": {"building_age": "new", "building_size": 90.0}},
]


@register("k10_what_if_overrides", with_listings(f""", f AS ({price_features_sql()})
SELECT f.listing_id, sc.scenario,
  CASE WHEN sc.set_size THEN sc.v_size ELSE f.building_size END AS building_size,
  CASE WHEN sc.set_city THEN sc.v_city ELSE f.city_slug END AS city_slug,
  CASE WHEN sc.set_age THEN sc.v_age ELSE f.building_age END AS building_age
FROM f CROSS JOIN (VALUES ('bigger', TRUE, 150.0::DOUBLE, FALSE, NULL::VARCHAR, FALSE, NULL::VARCHAR),
                          ('no_city', FALSE, NULL::DOUBLE, TRUE, NULL::VARCHAR, FALSE, NULL::VARCHAR),
                          ('new_building', TRUE, 90.0::DOUBLE, FALSE, NULL::VARCHAR, TRUE, 'new'))
  sc(scenario, set_size, v_size, set_city, v_city, set_age, v_age)""".replace("\n, f AS", ", f AS")))
def k10(spark, sf_dir):
    f = prepare_price_features(listing_view(spark, sf_dir)).select("listing_id", "building_size", "city_slug", "building_age")
    return MD.apply_scenarios(f, SCENARIOS).select("listing_id", "scenario", "building_size", "city_slug", "building_age")


@register("k10c_what_if_scores_of_means", with_listings(_SPLIT_SQL + """,
cm AS (SELECT city_slug AS c, avg(price_value) AS city_mean FROM s WHERE split = 'train' GROUP BY city_slug),
g AS (SELECT avg(price_value) AS gm FROM s WHERE split = 'train'),
x AS (SELECT listing_id, price_value, sc.scenario, CASE WHEN sc.set_city THEN NULL ELSE city_slug END AS city
      FROM s CROSS JOIN (VALUES ('bigger', FALSE), ('no_city', TRUE), ('new_building', FALSE)) sc(scenario, set_city) WHERE split = 'val'),
y AS (SELECT listing_id, scenario, 'city_mean' AS model, coalesce(city_mean, gm) AS prediction, price_value AS actual FROM x LEFT JOIN cm ON x.city = cm.c CROSS JOIN g
      UNION ALL SELECT listing_id, scenario, 'global_mean' AS model, gm AS prediction, price_value AS actual FROM x CROSS JOIN g)
SELECT listing_id, scenario, model, round(prediction, 2) AS prediction, actual, round(100.0 * (prediction - actual) / actual, 6) AS pct_error FROM y"""))
def k10c(spark, sf_dir):
    """K10 scores: scenarios scored by two pipelines whose predictions SQL can compute."""
    d = _split_features(spark, sf_dir)
    models = {name: p for name, (p, _) in _mean_pipelines(d.where(F.col("split") == "train")).items()}
    out = MD.what_if(models, d.where(F.col("split") == "val"), SCENARIOS, ["building_size", "city_slug", "building_age"], "price_value")
    return out.select("listing_id", "scenario", "model", F.round("prediction", 2).alias("prediction"), "actual", F.round("pct_error", 6).alias("pct_error"))


@register("k10b_what_if_scores")
def k10b(spark, sf_dir):
    data = _price_data(spark, sf_dir)
    models, _, _ = _fitted(data, "random_forest")
    val = data.where(F.col("split") == "val")
    return MD.what_if(models, val, SCENARIOS, PRICE["inference_columns"], "price_value")


def _credit_data(spark, sf_dir):
    """The prepared credit dataset, written once."""
    return materialize(prepare_credit_dataset(listing_view(spark, sf_dir)), "credit-prepared", "split")


def _search(spark, sf_dir, learner):
    """The reference's searches: on credit, with its ranges and trial counts."""
    return SR.parameter_search(_credit_data(spark, sf_dir), CREDIT, learner, SEARCH[learner]["space"], SEARCH[learner]["trials"], PRICE_NUMERIC)


@register("k11_parameter_search")
def k11(spark, sf_dir):
    return _search(spark, sf_dir, "random_forest")


@register("k11b_boosting_search")
def k11b(spark, sf_dir):
    return _search(spark, sf_dir, "lightgbm")


# ---- SQL-expressible metrics over a baseline predictor (train city mean, train mean) ----

def _baseline_predictions(spark, sf_dir):
    d = _split_features(spark, sf_dir)
    train = d.where(F.col("split") == "train")
    city = train.groupBy("city_slug").agg(F.avg("price_value").alias("_city_mean"))
    overall = train.agg(F.avg("price_value")).scalar()
    j = d.join(city, "city_slug", "left")
    a = j.select("split", F.lit("city_mean").alias("model"), F.col("price_value").alias("label"),
                 F.coalesce("_city_mean", overall).alias("prediction"))
    b = d.select("split", F.lit("global_mean").alias("model"), F.col("price_value").alias("label"),
                 overall.alias("prediction"))
    return a.unionByName(b)


_BASE_SQL = _SPLIT_SQL + """,
cm AS (SELECT city_slug, avg(price_value) AS city_mean FROM s WHERE split = 'train' GROUP BY city_slug),
g AS (SELECT avg(price_value) AS gm FROM s WHERE split = 'train'),
pred AS (SELECT split, 'city_mean' AS model, price_value AS label, coalesce(city_mean, gm) AS prediction
         FROM s LEFT JOIN cm USING (city_slug) CROSS JOIN g
         UNION ALL SELECT split, 'global_mean' AS model, price_value AS label, gm AS prediction FROM s CROSS JOIN g),
mu AS (SELECT split, model, avg(label) AS m FROM pred GROUP BY split, model),
agg AS (SELECT split, model, 1 - sum((label - prediction) * (label - prediction)) / sum((label - m) * (label - m)) AS r2,
               avg(abs(label - prediction)) AS mae, sqrt(avg((label - prediction) * (label - prediction))) AS rmse
        FROM pred JOIN mu USING (split, model) GROUP BY split, model),
met AS (SELECT split, model, 'r2' AS metric, r2 AS value FROM agg UNION ALL SELECT split, model, 'mae', mae FROM agg
        UNION ALL SELECT split, model, 'rmse', rmse FROM agg)"""


def _round_metric(col="value"):
    return F.when(F.col("metric") == "r2", F.round(col, 8)).otherwise(F.round(col, 2))


_RM = "CASE WHEN metric = 'r2' THEN round(value, 8) ELSE round(value, 2) END"


def _metrics(spark, sf_dir):
    return M.regression_metrics(_baseline_predictions(spark, sf_dir))


@register("e15_regression_metrics", with_listings(_BASE_SQL + f"\nSELECT split, model, metric, {_RM} AS value FROM met"))
def e15(spark, sf_dir):
    return _metrics(spark, sf_dir).withColumn("value", _round_metric())


@register("e16_flatten_metrics", with_listings(_BASE_SQL + f"""
SELECT split || '_' || model || '_' || metric AS name, {_RM} AS value FROM met
UNION ALL SELECT 'val_' || model || '_' || metric AS name, {_RM} AS value FROM met WHERE split = 'val'"""))
def e16(spark, sf_dir):
    m = _metrics(spark, sf_dir).withColumn("value", _round_metric())
    nested = M.flatten_metrics(m, nested=True)
    flat = M.flatten_metrics(m.where(F.col("split") == "val"), nested=False, prefix="val_")
    return nested.unionByName(flat)


@register("a05_metrics_json_roundtrip", with_listings(_BASE_SQL + f"""
SELECT split || '_' || model || '_' || metric AS name, {_RM} AS value FROM met"""))
def a05(spark, sf_dir):
    m = _metrics(spark, sf_dir).withColumn("value", _round_metric())
    return A.write_metrics_json(M.flatten_metrics(m), scratch_path(spark, "metrics-json"))


@register("k12_registry_gate", with_listings(_BASE_SQL + """
SELECT 'price' AS task, model, round(max(value), 8) AS val_r2, coalesce(max(value) >= 0.65, FALSE) AS qualifies
FROM met WHERE split = 'val' AND metric = 'r2' GROUP BY model"""))
def k12(spark, sf_dir):
    m = _metrics(spark, sf_dir).withColumn("value", _round_metric()).withColumn("task", F.lit("price"))
    return M.registry_gate(m).select("task", "model", "val_r2", "qualifies")


@register("k13_model_comparison", with_listings(_BASE_SQL + f"""
SELECT model, {_RM.replace("metric = 'r2'", "TRUE")} AS r2 FROM met WHERE split = 'val' AND metric = 'r2'"""))
def k13(spark, sf_dir):
    m = _metrics(spark, sf_dir).withColumn("value", _round_metric())
    flat = M.flatten_metrics(m.where(F.col("split") == "val"), nested=False, prefix="val_").unionByName(
        M.flatten_metrics(m.where(F.col("split") == "train"), nested=False, prefix=""))
    return M.compare_models(flat, ["city_mean", "global_mean", "absent_model"])


# ---- row selection (H) and per-split rules (I) ------------------------------------

@register("h01_sort_desc", with_listings(
    "SELECT column_name, round(100.0 * (count(*) FILTER (WHERE v IS NULL)) / count(*), 6) AS missing_pct FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS v FROM listings"
                         for c in ("land_size", "deed_type", "floor_material", "property_type", "cat3_slug"))
    + ") u GROUP BY column_name ORDER BY missing_pct DESC, column_name"))
def h01(spark, sf_dir):
    from abode.operators.profile import missing_share
    m = missing_share(listing_view(spark, sf_dir), ["land_size", "deed_type", "floor_material", "property_type", "cat3_slug"])
    return m.select("column_name", F.round("missing_pct", 6).alias("missing_pct")).orderBy(F.desc("missing_pct"), "column_name")


@register("h02_head", with_listings("SELECT listing_id, city_slug, price_value FROM listings ORDER BY listing_id LIMIT 5"))
def h02(spark, sf_dir):
    return listing_view(spark, sf_dir).select("listing_id", "city_slug", "price_value").orderBy("listing_id").limit(5)


@register("h03_row_at_position", with_listings(
    "SELECT listing_id, city_slug FROM listings ORDER BY listing_id LIMIT 1 OFFSET 100"))
def h03(spark, sf_dir):
    L = listing_view(spark, sf_dir).select("listing_id", "city_slug")
    # top-(idx+1) per partition then merged: bounded by the position, no full sort
    return L.orderBy("listing_id").limit(101).orderBy(F.desc("listing_id")).limit(1)


@register("h04_random_row", with_listings(
    f"SELECT listing_id, city_slug FROM listings ORDER BY {hash_u('listing_id', 7)}, listing_id LIMIT 1"))
def h04(spark, sf_dir):
    L = listing_view(spark, sf_dir).select("listing_id", "city_slug")
    return L.orderBy(hash_uniform("listing_id", 7), "listing_id").limit(1).select("listing_id", "city_slug")


@register("i01_rule_on_separate_splits", with_listings(_SPLIT_SQL + """
SELECT listing_id, split, coalesce(floor_material, 'unselect') AS floor_material FROM s"""))
def i01(spark, sf_dir):
    from abode.operators.projections import fill_unselect
    d = _split_features(spark, sf_dir).select("listing_id", "split", "floor_material")
    root = scratch_path(spark, "sep-splits")
    for sp in ("train", "val"):
        d.where(F.col("split") == sp).drop("split").write.parquet(f"{root}/{sp}")
    parts = [spark.read.parquet(f"{root}/{sp}").withColumn("split", F.lit(sp)) for sp in ("train", "val")]
    return fill_unselect(parts[0].unionByName(parts[1]), ["floor_material"])
