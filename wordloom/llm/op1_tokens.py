"""Token counts of whole texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_bpe import encoder
from .common import map_arrow


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row, as the tokenizers library gives them for
    the file `vocabulary` without added special tokens; special strings inside a text are special tokens.

    Null and empty texts have 0 bytes and tokens. Repeated rows are counted one by one; an empty table gives no rows;
    other columns aren't read. Texts beyond byte_bpe.HUGE characters are counted in overlapping chunks, so memory for
    encodings is bounded by a chunk however long a text is."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        n = encoder(vocabulary).count_all(texts)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
