"""Model pipeline, fit and per-split metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.operators.horizon import FEATURE_COLUMNS, LABEL_COLUMN, Windows, expand_horizons, split_rows
from tallyward.session import ensure_checkpoint_dir, scratch_path

# Hyperparameters of the boosted trees.
HYPERPARAMETERS = {
    "num_round": 1000, "max_depth": 5, "eta": 0.1, "subsample": 1.0, "colsample_bytree": 1.0, "gamma": 0.05,
    "min_child_weight": 1.0, "reg_lambda": 1.0, "reg_alpha": 0.5, "seed": 42,
}
IMPUTER_STRATEGY = "median"


def build_pipeline(feature_columns: Sequence[str] = tuple(FEATURE_COLUMNS), label_col: str = LABEL_COLUMN,
                   params: dict | None = None, engine: str = "gbt") -> Pipeline:
    """H1, H2: median imputer, assembler, boosted trees.

    ``engine="gbt"`` uses Spark's own trees; they have no L1/L2 terms, so reg_lambda, reg_alpha and
    colsample_bytree do not apply. ``engine="xgboost"`` needs that package on the cluster.
    """
    p = {**HYPERPARAMETERS, **(params or {})}
    imputed = [f"{c}_imputed" for c in feature_columns]
    imputer = Imputer(inputCols=list(feature_columns), outputCols=imputed, strategy=IMPUTER_STRATEGY)
    assembler = VectorAssembler(inputCols=imputed, outputCol="features_raw")
    if engine == "gbt":
        trees = GBTRegressor(
            featuresCol="features_raw", labelCol=label_col, predictionCol="prediction", maxIter=p["num_round"],
            maxDepth=p["max_depth"], stepSize=p["eta"], subsamplingRate=p["subsample"],
            minInfoGain=p["gamma"], minInstancesPerNode=max(1, int(p["min_child_weight"])), seed=p["seed"],
        )
    elif engine == "xgboost":
        try:
            from xgboost.spark import SparkXGBRegressor
        except ImportError as exc:
            raise RuntimeError("engine='xgboost' needs the xgboost package on driver and executors") from exc
        trees = SparkXGBRegressor(features_col="features_raw", label_col=label_col, prediction_col="prediction",
                                  objective="reg:squarederror", **p)
    else:
        raise ValueError(f"unknown engine {engine!r}")
    return Pipeline(stages=[imputer, assembler, trees])


def regression_metrics(actual: Column, predicted: Column) -> dict[str, Column]:
    """Rmse, mae and r2 as aggregates of one pass.

    r2 is 1 - SSE/SST (not the squared correlation); SST comes from the mergeable central moment.
    """
    error = actual - predicted
    sse, sst = F.sum(error * error), F.var_pop(actual) * F.count(actual)
    degenerate = F.when(sse == 0, F.lit(float("nan"))).otherwise(F.lit(float("-inf")))
    return {
        "rmse": F.sqrt(F.avg(error * error)),
        "mae": F.avg(F.abs(error)),
        "r2": F.when(sst == 0, degenerate).otherwise(F.lit(1.0) - sse / F.nullif(sst, F.lit(0.0))),
    }


def finite_only(metrics: DataFrame, name_col: str = "metric", value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Rows with a finite value, and the rest."""
    v = F.col(value_col)
    finite = F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))
    return metrics.filter(finite), metrics.filter(~finite).select(name_col)


def train(features: DataFrame, windows: Windows, params: dict | None = None, engine: str = "gbt",
          embargo: bool = False, label_col: str = LABEL_COLUMN) -> tuple[PipelineModel, dict[str, float]] | None:
    """H3, H4: build the training set, fit, and measure val and test; None when a split is empty.

    The expanded set is written once to the shared scratch folder: fitting reads it many times and
    a lost executor then re-reads files instead of recomputing windows.
    """
    spark = features.sparkSession
    ensure_checkpoint_dir(spark)
    staged = scratch_path(spark, "training")
    expand_horizons(features, windows["train"][0], windows["test"][1], label_col=label_col).write.parquet(staged)
    expanded = spark.read.parquet(staged)
    splits = {name: split_rows(expanded, window, embargo) for name, window in windows.items()}
    if any(df.isEmpty() for df in splits.values()):
        return None
    model = build_pipeline(label_col=label_col, params=params, engine=engine).fit(splits["train"])
    metrics: dict[str, float] = {"train_row_count": float(splits["train"].count())}
    for name in ("val", "test"):
        aggregates = regression_metrics(F.col(label_col).cast("double"), F.col("prediction"))
        row = model.transform(splits[name]).agg(
            F.count(F.lit(1)).cast("double").alias("row_count"),
            *[c.alias(m) for m, c in aggregates.items()]).first()
        metrics.update({f"{name}_{m}": row[m] for m in row.asDict()})
    return model, {k: v for k, v in metrics.items() if v is not None and math.isfinite(v)}


def save_model(model: PipelineModel, path: str) -> None:
    """A23."""
    model.write().overwrite().save(path)


def model_complete(spark: SparkSession, path: str) -> bool:
    """The pipeline's metadata was fully written (its first part exists)."""
    sentinel = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/metadata/part-00000*")
    found = sentinel.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(sentinel)
    return found is not None and len(found) > 0


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    """Refuse an incomplete model with a clear message."""
    if not model_complete(spark, path):
        raise FileNotFoundError(f"no complete model under {path}")
    return PipelineModel.load(path)


def run_parameters(spark: SparkSession, run_id: str, feature_table: str, windows: Windows, label_col: str = LABEL_COLUMN,
                   tags: dict[str, str] | None = None, params: dict | None = None) -> DataFrame:
    """H9: one provenance row (run_id, params map, tags map)."""
    facts = {"feature_table": feature_table, "label_col": label_col, "max_horizon": "10",
             "num_features": str(len(FEATURE_COLUMNS)), "feature_cols": ",".join(FEATURE_COLUMNS),
             "imputer_strategy": IMPUTER_STRATEGY}
    for name, (first, last) in windows.items():
        facts |= {f"{name}_start_date": _iso(first), f"{name}_end_date": _iso(last)}
    facts |= {k: str(v) for k, v in {**HYPERPARAMETERS, **(params or {})}.items()}
    role = {"model_role": "challenger", "promotion_status": "pending", **(tags or {})}
    return spark.createDataFrame([(run_id, facts, role)], "run_id string, params map<string,string>, tags map<string,string>")


def _iso(day: date) -> str:
    return day.isoformat()
