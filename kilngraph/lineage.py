"""Cutting lineage in iterative operators: a Parquet table in the folder named by spark.checkpoint.dir.

Only in local mode, where one machine does everything, an unset folder is replaced by ``/tmp/checkpoints``.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_FALLBACK = "/tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (root or LOCAL_FALLBACK).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_root(spark)}/lineage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_folder = path
    return out
