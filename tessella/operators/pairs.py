"""All-pairs reductions in blocks: every row meets every other one, no row set is broadcast or collected.

Rows are dealt into B blocks of about ``block`` rows by key hash. Each of the B x B block pairs is one
task that reduces its pairs with a vectorised kernel to one partial row per left row; partials are
then added up by Spark. Work is quadratic by nature, memory is not."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(df: DataFrame, key: str, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int = 2000) -> DataFrame:
    blocks = max(1, math.ceil(df.count() / block))
    spread = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    all_blocks = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = df.withColumn("_b", spread).withColumn("_o", F.explode(all_blocks))
    right = df.select([F.col(c).alias(c) for c in df.columns]).withColumn("_o", spread).withColumn("_b", F.explode(all_blocks))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return kernel(a, b) if len(a) and len(b) else pd.DataFrame(columns=[f.split()[0] for f in schema.split(", ")])
    return left.groupBy("_b", "_o").cogroup(right.groupBy("_b", "_o")).applyInPandas(run, schema)
