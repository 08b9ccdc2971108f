"""Session defaults, checked broadcasts and reliable checkpoints shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size of a side that is broadcast by hint.
BROADCAST_LIMIT = 8 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hints a broadcast only if the estimated size is within ``limit``; otherwise AQE picks the join."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared folder named by ``spark.checkpoint.dir``.

    Only where that setting is absent (tests on one machine) a temporary folder is used."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = os.path.join(tempfile.gettempdir(), "tessella-checkpoints")
        sc.setCheckpointDir(where)
    return df.checkpoint(eager)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def widen(df: DataFrame) -> DataFrame:
    """Round-robin repartition for work that is heavy per row, only if the input has fewer splits than the session's width."""
    n = parallelism(df.sparkSession)
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
