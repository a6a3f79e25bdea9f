"""Lineage control for iterative operators."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

MAX_ROUNDS = 200


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only in local mode, where one machine has all."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or tempfile.mkdtemp(prefix="gridloom-")


def cut(df: DataFrame) -> DataFrame:
    """df, written to shared storage and read again.

    A checkpoint would keep the estimated size of its plan. Joins multiply such estimates, so
    over the rounds of a loop they become numbers of millions of digits, and planning never
    ends. A written table has the size of its files.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """df, cut unless it comes straight from a cut: for grids that several
    branches of a plan read."""
    if getattr(df, "_settled", False):
        return df
    out = cut(df)
    out._settled = True
    return out
