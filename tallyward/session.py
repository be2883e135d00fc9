"""Session settings and the shared scratch area."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Runtime SQL settings the operators are tuned for. Partition counts stay with AQE: the initial
# number is a ceiling that coalescing brings down to the advisory size.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def shuffle_partitions(input_bytes: int, cores: int, target_bytes: int = 256 * 1024 * 1024,
                       most: int = 50_000) -> int:
    """Initial shuffle partitions for a job over ``input_bytes``: about ``target_bytes`` each, at least
    two per core, and no more than a driver can track. AQE merges the ones that turn out small."""
    return int(min(max(2 * cores, -(-input_bytes // target_bytes)), most))


def build_session(app_name: str = "tallyward", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the settings above; ``conf`` entries win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, "spark.sql.session.timeZone": "UTC", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for intermediate tables, under the folder every executor can reach.

    The cluster names that folder in ``spark.checkpoint.dir`` and has to: its warehouse may be a folder of the driver's machine.
    Only a session in one process (``local``) falls back to the warehouse folder; a temporary folder is never used.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_CONF} has to name a folder that the driver and all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point iterative jobs (boosted trees) at the shared folder so that lineage can be cut."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_path(spark, "checkpoint"))
