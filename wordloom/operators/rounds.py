"""Iterated joins: each round's table is written, so that lineage stays short and a lost executor costs one round."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df, written to the shared folder of spark.checkpoint.dir and read back. Where that is unset and Spark is one process,
    a temporary folder takes its place."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        base = "file://" + tempfile.mkdtemp(prefix="wordloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    at = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
