"""Small helpers that the training-data operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark hands to Python at once. Documents are long, so batches are short.
BATCH_ROWS = 256
#: Words as the near-duplicate, decontamination and licence operators take them, on text whose A-Z are lowered.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = {i: i + 32 for i in range(65, 91)}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of a Python worker: at most BATCH_ROWS rows are in flight."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def own_names(df: DataFrame) -> str:
    """A beginning for column names that no column of df has."""
    p = "lm_"
    while any(c.lower().startswith(p) for c in df.columns):
        p += "_"
    return p


def lower_ascii(text: str) -> str:
    """A-Z only; every other character stays."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def lower_ascii_col(c: Column) -> Column:
    """A-Z only. lower() does that for ASCII strings, and much faster."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """f over each batch."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """A new folder, as a URI, below the one the cluster names in spark.checkpoint.dir. Where that is unset and all of Spark
    is one process (tests, a single machine), a temporary folder is named there first; on a cluster that is an error, since
    a machine's own folder isn't shared."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        base = "file://" + tempfile.mkdtemp(prefix="wordloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def local_path(uri: str) -> str:
    """The mounted path of a shared folder; memory mapping needs one."""
    path = re.sub(r"^file:(//)?", "", uri)
    if "://" in path:
        raise ValueError(f"memory-mapped files need a mounted folder in spark.checkpoint.dir, not {uri}")
    os.makedirs(path, exist_ok=True)
    return path


def saved(df: DataFrame, at: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, and a lost executor takes nothing with it."""
    at = at or shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
