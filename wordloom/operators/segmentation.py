"""Manual segmentations against the analyses of a pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

BOUNDARY = "[-=~<]"


def collected(records: DataFrame) -> DataFrame:
    """The records whose segmentation has a boundary."""
    return records.filter(F.col("segmentation").rlike(BOUNDARY))


def parts(c: Column) -> Column:
    """Parts between hyphens, = as one; of a part before ~ nothing stays, and infixes and brackets are taken out."""
    flat = F.regexp_replace(F.translate(c, "=", "-"), "[^-~]*~", "")
    return F.transform(F.filter(F.split(flat, "-"), lambda p: p != ""), lambda p: F.regexp_replace(F.regexp_replace(p, "<[^>]+>", ""), "[()]", ""))


def parsed(c: Column) -> Column:
    """prefix, suffix, infixes, root of a segmentation: the root is the first of the longest parts, the outermost parts on its sides are
    prefix and suffix; keys, null where there is none."""
    p = parts(c)
    length = F.array_max(F.transform(p, lambda x: F.length(x)))
    at = F.array_position(F.transform(p, lambda x: F.length(x)), length)
    infix = F.filter(F.transform(F.regexp_extract_all(c, F.lit("<([^>]+)>"), F.lit(1)), T.search_key), lambda x: x != "")
    key = lambda x: F.nullif(T.search_key(x), F.lit(""))
    return F.struct(
        F.when(at > 1, key(F.element_at(p, 1))).alias("prefix"),
        F.when(at < F.size(p), key(F.element_at(p, -1))).alias("suffix"),
        infix.alias("infixes"),
        F.when(F.size(p) > 0, T.search_key(F.get(p, (at - 1).cast("int")))).alias("root"),
    )


def affixes(records: DataFrame) -> DataFrame:
    """doc, word, type, form: the affixes of each segmented record (doc, word, segmentation)."""
    p = records.withColumn("p", parsed(F.col("segmentation")))
    one = lambda kind, c: F.when(c.isNotNull(), F.struct(F.lit(kind).alias("type"), c.alias("form")))
    every = F.array_compact(F.concat(F.array(one("prefix", F.col("p.prefix")), one("suffix", F.col("p.suffix"))), F.transform("p.infixes", lambda x: F.struct(F.lit("infix").alias("type"), x.alias("form")))))
    return p.select("doc", "word", F.explode(every).alias("a")).select("doc", "word", "a.type", "a.form")


def compared(records: DataFrame, found: DataFrame) -> DataFrame:
    """doc, word, type, form, status over segmented records and the conditions (type, form) that any of them has: tp, fp or fn.
    found: word, type, form, what the pattern finds; truth is the union of all segmentations of a word. Pairs that neither
    side has aren't made."""
    gold = affixes(records)
    conditions = gold.select("type", "form").distinct()
    truth = gold.select("word", "type", "form").distinct().withColumn("true", F.lit(True))
    got = found.select("word", "type", "form").distinct().join(conditions, ["type", "form"], "left_semi").withColumn("got", F.lit(True))
    both = truth.join(got, ["word", "type", "form"], "full")
    status = F.when(F.col("true") & F.col("got"), "tp").when(F.col("got"), "fp").otherwise("fn")
    return records.select("doc", "word").distinct().join(both, "word").select("doc", "word", "type", "form", status.alias("status"))


def scored(rows: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall."""
    n = rows.agg(*(F.count_if(F.col("status") == x).alias(x) for x in ("tp", "fp", "fn")))
    ratio = lambda a, b: F.round(F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))), 9)
    return n.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn")})
