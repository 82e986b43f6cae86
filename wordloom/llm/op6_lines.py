"""Line dedup, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, lower_ascii_col, own_names

#: Code points a key needs, and documents it must be found in, for its lines to be dropped.
MIN_CHARS, MIN_DOCS = 10, 2


def line_key(line: Column) -> Column:
    return lower_ascii_col(F.btrim(line, F.lit(SPACES)))


def key_hash(key: Column) -> Column:
    """128 bits, as two 64-bit hashes with different beginnings."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """One entry a line, in order: the hash of its key, or null where the key is too short to count."""
    return F.transform(lines_of(text), lambda x: F.when(F.length(F.btrim(x, F.lit(SPACES))) >= min_chars, key_hash(line_key(x))))


def text_hash(text: Column) -> Column:
    """Tells the rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without(lines: Column, places: Column) -> Column:
    """The lines whose places (from 0) aren't in an array. array_except hashes, so this is linear in the lines."""
    return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places), lambda i: F.get(lines, i))


def droppable(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """did, t, drops: the places of the lines that a row of document did with text hash t loses. Lines are exploded with their
    places, and counts and smallest ids are pre-aggregated before the shuffle, so a line that a third of the documents
    share is one row a task. The join back has one row a key on its small side, so that adaptive execution can split a hot key."""
    rows = docs.select(F.col("doc_id").alias("did"), text_hash(F.col("text")).alias("t"), F.posexplode(line_hashes(F.col("text"), min_chars)).alias("pos", "h")).filter(F.col("h").isNotNull() & F.col("did").isNotNull())
    keys = rows.select("did", "t", "pos", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
    least = F.min("did").alias("first")
    found = keys.groupBy("a", "b")
    if min_docs == 2:  # two distinct documents or more: the smallest and the largest id tell
        found = found.agg(least, F.max("did").alias("last")).filter("first < last")
    else:
        found = keys.groupBy("a", "b", "did").agg(F.lit(1).alias("one")).groupBy("a", "b").agg(least, F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    return keys.join(found.select("a", "b", "first"), ["a", "b"]).filter("did > first").groupBy("did", "t").agg(F.collect_set("pos").alias("drops"))


def with_kept(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with two more columns, n_lines and kept (array of the lines that stay, in order), under own_names(docs)."""
    p = own_names(docs)
    drops = droppable(docs.select("doc_id", "text"), min_chars, min_docs).withColumnsRenamed({"did": f"{p}did", "t": f"{p}t", "drops": f"{p}drops"})
    joined = docs.join(drops, (F.col("doc_id") == F.col(f"{p}did")) & (text_hash(F.col("text")) == F.col(f"{p}t")), "left")
    lines, gone = lines_of(F.col("text")), F.col(f"{p}drops")
    kept = F.when(gone.isNull(), lines).otherwise(without(lines, gone))
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.size(lines).cast("long").alias(f"{p}n_lines"), kept.alias(f"{p}kept"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with repeated lines taken out of text, by line position.

    A line's key is the line stripped of blanks and with A-Z lowered. Keys of min_chars code points that min_docs
    documents hold lose their lines in all of these but the one of the smallest doc_id, where each repeat stays. Null
    text has one empty line and stays null, and a text all of whose lines go becomes empty. Rows that repeat a doc_id count as one
    document and lose the same lines; rows whose doc_id is null lose none and count for nobody. Other columns stay; a
    column n_chars is set anew. An empty table stays empty."""
    out = with_kept(docs, min_chars, min_docs)
    text = F.when(F.col("text").isNotNull(), F.array_join(f"{own_names(docs)}kept", "\n"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row."""
    out = with_kept(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("lm_n_lines").alias("n_lines"), (F.col("lm_n_lines") - F.size("lm_kept")).cast("long").alias("n_dropped"), F.sha2(F.encode(F.array_join("lm_kept", "\n"), "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
d AS (SELECT key, min(doc_id) AS least FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, (d.key IS NOT NULL AND k.doc_id > d.least) AS gone FROM k LEFT JOIN d ON k.key = d.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
