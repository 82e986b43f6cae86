"""Records, postings and the lexicon as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .rounds import kept

KINDS = ("head", "alt", "variant", "root", "token")
#: Partial matches that one query keeps.
PARTIAL_LIMIT = 300


def line_records(docs: DataFrame) -> DataFrame:
    """doc_id, line, text, source, lang, unit: every line of every document as a record of its own."""
    lines = docs.select("doc_id", "source", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "text"))
    return lines.filter(F.trim("text") != "").withColumn("unit", T.unit_class(F.col("text"), F.lit("segment")))


def token_postings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """term, doc: distinct."""
    out = docs.select(F.explode(T.tokenize(F.col("text"))).alias("term"), F.col(key).alias("doc"))
    return out.distinct() if repeated(docs, key) else out


def repeated(rows: DataFrame, key: str) -> bool:
    """Whether two rows have one key. Where none do, what is distinct within rows is distinct, and needs no shuffle."""
    return bool(rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").take(1))


def postings(heads: DataFrame | None = None, alts: DataFrame | None = None, variants: DataFrame | None = None, roots: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """term, doc, kind, code (doc * 5 + kind) from tables of (doc, text): whole texts are terms of one kind each, and running texts
    give their tokens. Distinct."""
    out = None
    for kind, df in enumerate((heads, alts, variants, roots, texts)):
        if df is None:
            continue
        c = F.col("text")
        if kind == 4:
            one = token_postings(df, "doc")  # keys already
        else:
            term = F.explode(T.derivation_candidates(c)) if kind == 3 else T.search_key(c)
            one = df.select(term.alias("term"), "doc").select(T.search_key(F.col("term")).alias("term"), "doc").filter("term <> ''").distinct()
        one = one.withColumn("kind", F.lit(KINDS[kind])).withColumn("code", F.col("doc") * 5 + kind)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("postings of nothing")
    return out


def lexicon(terms: DataFrame) -> DataFrame:
    """term_id, term: ranks by code point from 0. Terms are ranked within their first two characters, and the counts of smaller
    beginnings are added; only the table of beginnings is ordered as a whole."""
    t = kept(terms.select("term").distinct()).withColumn("head", F.substring("term", 1, 2))
    sizes = t.groupBy("head").agg(F.count("*").alias("n"))
    before = sizes.select("head", (F.sum("n").over(Window.orderBy("head")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("head").orderBy("term"))
    return t.withColumn("rank", rank).join(before, "head").select((F.col("before") + F.col("rank") - 1).cast("long").alias("term_id"), "term")


def grams(c: Column) -> Column:
    """Distinct characters and adjacent pairs."""
    n = F.length(c)
    chars = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(c, i, 1))
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(c, i, 2))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(chars, pairs))


def partial_matches(queries: DataFrame, terms: DataFrame, limit: int = PARTIAL_LIMIT) -> DataFrame:
    """q, term, match_type, score, rank for the longer terms that hold a query: those that begin with it first, shorter
    ones before longer ones. Candidates come from the query's rarest character or pair in the lexicon, so this is an equi-join
    and no product."""
    index = terms.select("term", F.explode(grams(F.col("term"))).alias("gram"))
    df = index.groupBy("gram").agg(F.count("*").alias("n"))
    wanted = queries.select("q", F.explode(grams(F.col("q"))).alias("gram")).join(df, "gram", "left")
    rarest = wanted.groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).select("q", F.col("r.gram").alias("gram"))
    hits = rarest.join(index, "gram").filter(F.col("term").contains(F.col("q")) & (F.col("term") != F.col("q")))
    kind = F.when(F.col("term").startswith(F.col("q")), "prefix").when(F.col("term").endswith(F.col("q")), "suffix").otherwise("substring")
    order = Window.partitionBy("q").orderBy(F.when(F.col("match_type") == "prefix", 0).otherwise(1), F.length("term"), "term")
    out = hits.select("q", "term", kind.alias("match_type")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return out.withColumn("score", rank_score(F.col("match_type"), F.lit(0.0), F.length("term") - F.length("q")))


def rank_score(kind: Column, distance: Column, extra: Column) -> Column:
    """Fuzzy matches rank by distance, partial ones by extra length, morphological ones behind."""
    longer = F.least(F.greatest(extra, F.lit(0)), F.lit(12)) * 0.05
    return F.round(F.when(kind == "fuzzy", distance).when(kind.isin("lemma", "derived", "sibling"), distance + 0.4).when(kind == "prefix", longer + 0.35).otherwise(longer + 0.9), 9)


def thresholds(c: Column) -> dict[str, Column]:
    """The greatest distance at each level for a query of this length, and that of a lemma at the normal level."""
    n = F.length(c)
    clamp = lambda x, lo, hi: F.round(F.greatest(F.lit(lo), F.least(x, F.lit(hi))), 9)
    normal = clamp(n * 0.15 + 0.2, 0.3, 1.6)
    return {"max_exact": F.lit(0.0), "max_normal": normal, "max_loose": clamp(n * 0.25 + 0.5, 0.8, 3.0), "max_lemma": F.round(F.least(F.lit(1.0), normal + 0.6), 9)}
