"""Model training and the registry table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.catalog import inputs
from tallyward.catalog.area_queries import run_date
from tallyward.operators.features import area_features
from tallyward.operators.horizon import split_windows
from tallyward.operators.layout import stage
from tallyward.operators.registry import promotion, resolve_model
from tallyward.operators.training import finite_only, load_model, regression_metrics, save_model, train
from tallyward.plans.area_risk import score_batch
from tallyward.session import scratch_path

# Few rounds keep the query short; the library default is the full number.
ROUNDS = {"num_round": 5}


def train_score(spark, sf):
    """Fit on the training window, save, load, score the run date."""
    run = run_date(spark, sf)
    windows = split_windows(run)
    features = stage(area_features(inputs.silver(spark, sf), windows["train"][0], run), "features")
    model, metrics = train(features, windows, params=ROUNDS)
    path = scratch_path(spark, "model")
    save_model(model, path)
    scored = score_batch(features, load_model(spark, path), run, "area_risk", "1", run_id="train-score")
    return scored.drop("created_at").withColumn("test_rmse", F.lit(metrics.get("test_rmse")))


def registry(spark, sf):
    """One model version per embedding label: models are label % 3, the metric is the error of one
    coordinate as a guess of the next. Versions below 6 start in Production or None."""
    a, b = F.element_at("embedding", 1).cast("double"), F.element_at("embedding", 2).cast("double")
    stats = (inputs.table(spark, sf, "embeddings").select("label", a.alias("y"), b.alias("p"))
             .groupBy("label").agg(F.round(regression_metrics(F.col("y"), F.col("p"))["rmse"], 6).alias("rmse")))
    label = F.col("label")
    return stats.select(
        F.concat(F.lit("model_"), (label % 3).cast("string")).alias("model_name"), label.alias("version"),
        F.concat(F.lit("run-"), label.cast("string")).alias("run_id"),
        F.concat(F.lit("s3://models/"), label.cast("string")).alias("model_path"),
        F.when(label % 4 != 3, F.col("rmse")).alias("metric"),
        F.when(label.between(2, 3), "Production").otherwise("None").alias("stage"),
        F.date_add(F.lit("2024-01-01").cast("date"), label).alias("created_at"))


REGISTRY_CTE = """registry AS (SELECT 'model_' || (label % 3) AS model_name, label AS version, 'run-' || label AS run_id,
  's3://models/' || label AS model_path, CASE WHEN label % 4 <> 3 THEN rmse END AS metric,
  CASE WHEN label BETWEEN 2 AND 3 THEN 'Production' ELSE 'None' END AS stage,
  DATE '2024-01-01' + CAST(label AS INTEGER) AS created_at
  FROM (SELECT label, round(sqrt(avg((embedding[1]::DOUBLE - embedding[2]::DOUBLE) * (embedding[1]::DOUBLE - embedding[2]::DOUBLE))), 6) AS rmse
    FROM embeddings GROUP BY 1))"""


def registry_promote(spark, sf):
    return promotion(registry(spark, sf))


REGISTRY_PROMOTE = f"""WITH {REGISTRY_CTE},
newest AS (SELECT model_name, arg_max(version, created_at) AS nv, coalesce(arg_max(coalesce(metric, 'inf'::DOUBLE), created_at), 'inf'::DOUBLE) AS nm
  FROM registry GROUP BY 1),
prod AS (SELECT model_name, arg_max(version, created_at) AS pv, arg_max(coalesce(metric, 'inf'::DOUBLE), created_at) AS pm
  FROM registry WHERE stage = 'Production' GROUP BY 1),
decided AS (SELECT n.*, pv, n.nm < coalesce(pm, 'inf'::DOUBLE) AS win FROM newest n LEFT JOIN prod p USING (model_name))
SELECT r.model_name, r.version, r.run_id, r.model_path, r.metric, r.created_at,
  CASE WHEN r.version = nv AND win THEN 'Production' WHEN r.stage = 'Production' AND win THEN 'Archived' ELSE r.stage END AS stage,
  CASE WHEN r.version = nv THEN CASE WHEN win THEN 'promoted' ELSE 'not_promoted' END END AS decision,
  CASE WHEN r.version = nv AND win THEN 'champion' WHEN r.version = pv AND r.stage = 'Production' AND win THEN 'archived'
    WHEN r.version = pv AND r.stage = 'Production' THEN 'champion' WHEN r.version = nv THEN 'challenger' END AS model_role
FROM registry r JOIN decided d USING (model_name)"""


def registry_resolve(spark, sf):
    """H7: the Production version of each model, and one version by number."""
    promoted = promotion(registry(spark, sf))
    parts = [resolve_model(promoted, f"model_{k}", "Production") for k in range(3)]
    parts.append(resolve_model(promoted, "model_1", "4"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("model_name", "version", "run_id", "model_path", "stage")


REGISTRY_RESOLVE = f"""WITH promoted AS ({REGISTRY_PROMOTE}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY created_at DESC, version DESC) AS rn
  FROM promoted WHERE stage = 'Production')
SELECT model_name, version, run_id, replace(model_path, 's3://', 's3a://') AS model_path, stage FROM ranked WHERE rn = 1
UNION ALL SELECT model_name, version, run_id, replace(model_path, 's3://', 's3a://'), stage FROM promoted
WHERE model_name = 'model_1' AND version = 4"""


def finite_metrics(spark, sf):
    """Finite and dropped metric values over all registry rows."""
    rows = registry(spark, sf).select(F.col("run_id").alias("metric"), F.coalesce("metric", F.lit(float("inf"))).alias("value"))
    kept, dropped = finite_only(rows)
    return kept.withColumn("kept", F.lit(True)).unionByName(
        dropped.select("metric", F.lit(None).cast("double").alias("value"), F.lit(False).alias("kept")))


FINITE_METRICS = f"""WITH {REGISTRY_CTE} SELECT run_id AS metric, metric AS value, metric IS NOT NULL AS kept FROM registry"""

QUERIES = {
    "train_score": (train_score, None),
    "registry_promote": (registry_promote, REGISTRY_PROMOTE),
    "registry_resolve": (registry_resolve, REGISTRY_RESOLVE),
    "finite_metrics": (finite_metrics, FINITE_METRICS),
}
