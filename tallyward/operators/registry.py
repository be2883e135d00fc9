"""Model registry as a table (H6-H8).

Columns: model_name, version, run_id, model_path, metric, stage, created_at. The table holds one row
per trained version, so its groups are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyward.operators.training import model_complete

PRODUCTION, ARCHIVED = "Production", "Archived"


def promotion(registry: DataFrame) -> DataFrame:
    """H6: the registry after comparing each model's newest version with its Production version.

    The newest version is promoted when its metric is strictly lower; a missing or non-finite metric
    counts as infinite. Promotion archives the old Production version. Adds ``decision``
    (promoted, not_promoted or null) and ``model_role`` (champion, challenger, archived or null).
    """
    metric = F.coalesce(F.nanvl(F.col("metric"), F.lit(float("inf"))), F.lit(float("inf")))
    by_model = W.partitionBy("model_name")
    newest = F.max(F.struct("created_at", "version")).over(by_model)
    in_production = F.col("stage") == PRODUCTION
    df = registry.withColumns({
        "_metric": metric,
        "_newest": (F.col("version") == newest["version"]) & (F.col("created_at") == newest["created_at"]),
        "_prod": F.max(F.when(in_production, F.struct("created_at", "version"))).over(by_model),
    })
    df = df.withColumns({
        "_candidate_metric": F.min(F.when(F.col("_newest"), F.col("_metric"))).over(by_model),
        "_current": in_production & (F.col("version") == F.col("_prod.version")),
    })
    prod_metric = F.coalesce(F.min(F.when(F.col("_current"), F.col("_metric"))).over(by_model), F.lit(float("inf")))
    df = df.withColumn("_win", F.col("_candidate_metric") < prod_metric)
    promoted = F.col("_newest") & F.col("_win")
    current = F.coalesce(F.col("_current"), F.lit(False))
    demoted = in_production & F.col("_win") & ~F.col("_newest")
    return df.select(
        *[c for c in registry.columns if c != "stage"],
        F.when(promoted, PRODUCTION).when(demoted, ARCHIVED).otherwise(F.col("stage")).alias("stage"),
        F.when(F.col("_newest"), F.when(F.col("_win"), "promoted").otherwise("not_promoted")).alias("decision"),
        F.when(promoted, "champion").when(current & F.col("_win"), "archived").when(current, "champion")
        .when(F.col("_newest"), "challenger").alias("model_role"),
    )


def promote(registry: DataFrame, check_paths: bool = True) -> DataFrame:
    """H6 with the completeness guard: an unreadable candidate stops the promotion."""
    out = promotion(registry)
    if check_paths:
        spark = registry.sparkSession
        for row in out.filter(F.col("decision").isNotNull()).select("model_name", "version", "model_path").collect():
            if row["model_path"] and not model_complete(spark, row["model_path"]):
                raise RuntimeError(f"model {row['model_name']} version {row['version']} is incomplete; not promoted")
    return out


def resolve_model(registry: DataFrame, model_name: str, stage_or_version: str) -> DataFrame:
    """H7: newest row of a stage, or the row of a numeric version; object-store paths in s3a form."""
    rows = registry.filter(F.col("model_name") == model_name)
    if stage_or_version.isdigit():
        rows = rows.filter(F.col("version") == int(stage_or_version))
    else:
        rows = rows.filter(F.col("stage") == stage_or_version)
    path = F.regexp_replace("model_path", r"\As3://", "s3a://")
    return rows.withColumn("model_path", path).orderBy(F.desc("created_at"), F.desc("version")).limit(1)


def has_production(registry: DataFrame, model_name: str) -> bool:
    """H8: whether scoring can run at all."""
    return not resolve_model(registry, model_name, PRODUCTION).isEmpty()
