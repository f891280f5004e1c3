"""Session defaults and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows of one key that a single task may have to order. See operators/scan.py.
CHUNK_CONF = "spark.reelspark.chunkWidth"
CHUNK_DEFAULT = 65_536


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("reelspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def chunk_width(spark: SparkSession) -> int:
    return int(spark.conf.get(CHUNK_CONF, str(CHUNK_DEFAULT)))


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder all executors share.

    The cluster names it in spark.checkpoint.dir; only where that is unset and Spark runs
    on this machine alone, as in tests, a local folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder.

    Cuts the lineage where a costly or long plan has several consumers. The table outlives
    executors, so nothing is computed again when one is lost.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
