"""Postings of a stream of documents, appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators.index import token_postings


def append_postings(docs: DataFrame, path: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Writes (term, doc) of each new document once. A batch that runs again after a failure overwrites its own folder,
    so nothing is written twice."""

    def add(batch: DataFrame, epoch: int) -> None:
        token_postings(batch, key).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def word_counts(docs: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """Words by event-time window; documents later than `late` are dropped with their state."""
    words = docs.withWatermark(time, late).select(time, F.explode(T.split_words(F.col("text"))).alias("word"))
    return words.groupBy(F.window(time, window), "word").agg(F.count("*").alias("n"))
