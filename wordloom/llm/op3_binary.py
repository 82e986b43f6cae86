"""Token ids in flat binary files, with 64-bit document offsets, for memory mapping.

A data set is a folder of parts, in ascending document order: tokens-K.bin (unsigned 16- or 32-bit ids, little-endian),
offsets-K.bin (unsigned 64-bit: where each document starts in its part, then the part's length) and docs-K.bin (signed
64-bit doc_id; a null one is the smallest integer). manifest.json has the type and, for each part, its file key, documents,
tokens, and both bases: prefix sums over the parts before it, so that any document's global position is base + offset.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import crc32_u32, encoder
from .common import local_path, small_batches

NULL_ID = -(1 << 63)


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 2) -> dict:
    """Encodes every whole text (null: empty), ends each document with end_id and writes the parts in ascending doc_id
    order (ties in any order; nulls first). Returns the manifest. A task writes under names of its own, so a task that
    runs twice (lost executor, speculation) leaves at most files that no manifest names. The driver sees one row a part."""
    small_batches(docs.sparkSession)
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, key, starts, ids, at = encoder(vocabulary), uuid.uuid4().hex, [], [], 0
        end = np.array([end_id], enc.dtype).tobytes()
        part = None
        with open(f"{folder}/tokens-{key}.bin", "wb") as f:
            for batch in batches:
                part = batch.column(2)[0].as_py() if part is None and batch.num_rows else part
                for raw in enc.encode_all([x or "" for x in batch.column(1).to_pylist()]):
                    starts.append(at)
                    at += len(raw) // enc.dtype.itemsize + 1
                    f.write(raw + end)
                ids += [NULL_ID if x is None else x for x in batch.column(0).to_pylist()]
        if not ids:
            os.remove(f"{folder}/tokens-{key}.bin")
            return
        np.array([*starts, at], "<u8").tofile(f"{folder}/offsets-{key}.bin")
        np.array(ids, "<i8").tofile(f"{folder}/docs-{key}.bin")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "key": [key], "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([at], pa.int64())})

    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id())
    rows = sorted(ordered.mapInArrow(run, "part int, key string, n_docs long, n_tokens long").collect())
    bases = [0, *accumulate(r.n_tokens for r in rows)], [0, *accumulate(r.n_docs for r in rows)]
    parts = [{"key": r.key, "n_docs": r.n_docs, "n_tokens": r.n_tokens, "token_base": t, "doc_base": d} for r, t, d in zip(rows, *bases)]
    manifest = {"dtype": encoder(vocabulary).dtype.str, "end_id": end_id, "n_docs": bases[1][-1], "n_tokens": bases[0][-1], "parts": parts}
    with open(f"{folder}/manifest.json", "w") as f:
        json.dump(manifest, f)
    return manifest


def open_part(folder: str, manifest: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part k, memory-mapped: ids, offsets, doc_ids."""
    key = manifest["parts"][k]["key"]
    return tuple(np.memmap(f"{folder}/{name}-{key}.bin", np.dtype(kind), "r") for name, kind in (("tokens", manifest["dtype"]), ("offsets", "<u8"), ("docs", "<i8")))


def document(folder: str, manifest: dict, i: int) -> np.ndarray:
    """Ids of the i-th document of the whole set, its end id included; only its pages are read."""
    bases = [p["doc_base"] for p in manifest["parts"]]
    k = int(np.searchsorted(bases, i, "right")) - 1
    ids, offsets, _ = open_part(folder, manifest, k)
    j = i - bases[k]
    return ids[int(offsets[j]) : int(offsets[j + 1])]


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (end id included) and ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers) of every document, from the files. Parts are read in parallel."""
    small_batches(spark)
    with open(f"{folder}/manifest.json") as f:
        manifest = json.load(f)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest["parts"]:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                ids, offsets, docs = open_part(folder, manifest, k)
                base = manifest["parts"][k]["token_base"]
                for lo in range(0, len(docs), 4096):
                    cut = offsets[lo : lo + 4097].astype(np.int64)
                    some = np.asarray(docs[lo : lo + 4096])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(some.astype(np.int64), mask=some == NULL_ID),
                            "start": pa.array(cut[:-1] + base),
                            "n_tokens": pa.array(np.diff(cut)),
                            "ids_crc32": pa.array([crc32_u32(ids[a:b]) for a, b in zip(cut[:-1], cut[1:])], pa.int64()),
                        }
                    )

    n = len(manifest["parts"])
    return spark.range(0, n, 1, min(n, 4 * max(8, spark.sparkContext.defaultParallelism))).mapInArrow(run, schema)


def token_file_round_trip(docs: DataFrame, vocabulary: str, folder_uri: str, end_id: int = 2) -> DataFrame:
    """Writes the files below folder_uri, which must be a mounted folder, and reads every document back from them.
    Null and empty texts are documents of one id; repeated rows stay; an empty table gives an empty set."""
    folder = local_path(folder_uri)
    write_tokens(docs, vocabulary, folder, end_id)
    return read_tokens(docs.sparkSession, folder)
