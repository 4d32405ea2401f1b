"""Session defaults and table access shared by every operator."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def get_session(app: str = "caselake", cpus: str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session in UTC with adaptive execution; clusters bring their own settings."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.driver.memory", os.environ.get("CASELAKE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``; any path that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows of a vocabulary that is broadcast.
SMALL = 20_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A table with a broadcast hint if it has at most ``most`` rows; else as it is, so that Spark chooses another join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Splits below which an input may leave cores idle.
FEW_SPLITS = 32


def spread(df: DataFrame, cut: bool = False) -> DataFrame:
    """Rows dealt to more tasks where an input has few splits (a small table, often one row group), for work that costs more than moving
    the rows. Inputs of FEW_SPLITS splits or more, some gigabytes, stay as they are; with ``cut`` only those do, as a split may lie inside a
    row group and hold no row."""
    cores = min(df.sparkSession.sparkContext.defaultParallelism, FEW_SPLITS)
    return df.repartition(cores) if df.rdd.getNumPartitions() < (FEW_SPLITS if cut else cores) else df
