"""Session construction and lineage cutting.

Library code never invents storage locations on a cluster: the checkpoint
folder comes from ``spark.checkpoint.dir`` (a shared filesystem on a real
cluster).  Only a local master without that setting (tests, laptops) gets a
private folder under the system temp directory.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # broadcast only what the planner has sized; 32 MB keeps executors safe
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # remove checkpoint files once their DataFrame is gone (shared folder stays small)
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(app: str = "quarry", cpus: int | str = "*", shuffle_partitions: int = 8,
              driver_memory: str = "8g", extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, configuring the context with it.

    Reads ``spark.checkpoint.dir`` from the session.  When it is unset and the
    master is local, a private temp folder is used (test mode); on a cluster
    an unset value is an error rather than a silent machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running ordered operators")
        conf = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf)
    sc.setCheckpointDir(conf)
    return conf


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never a local one): survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep_table(df: DataFrame, tag: str = "kept") -> DataFrame:
    """Write ``df`` once as a columnar table below the shared checkpoint folder and read it
    back: later reads take only their columns, and lineage ends at shared files."""
    path = os.path.join(checkpoint_dir(df.sparkSession), f"{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))
