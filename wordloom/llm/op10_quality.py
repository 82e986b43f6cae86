"""Quality rules with cross-document line frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, own_names
from .op6_lines import key_hash, line_key, lines_of, text_hash, without

SYMBOLS = "#*$%&|<>"
#: Base rule: the least words of a document, and the most per cent of them in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT = 50, 50
#: A line is boilerplate of its host if more than FEW documents of the host hold it, and more than SHARE of them. Keys of
#: fewer than KEY_CHARS code points don't count.
SHARE, FEW, KEY_CHARS = 0.005, 5, 10
#: A document is depleted if more than this part of its words stood in boilerplate lines, or fewer than MIN_WORDS are left.
DEPLETED = 0.5


def words_of(text: Column) -> Column:
    """Runs of anything but blanks; no words in a null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+", -1))


def bound(value: Column, f) -> Column:
    """f(value), with value computed once and not once for each use of it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def repeat_words(words: Column) -> Column:
    """How many words stand in 3-word windows that are found twice or more in this text. Windows are compared by a 64-bit hash
    within one document. Sorted (hash, place) pairs put equal windows side by side, so the work is n log n for any text."""
    hashes = F.when(F.size(words) >= 4, F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2))))

    def covered(places: Column) -> Column:
        return F.size(F.array_union(F.array_union(places, F.transform(places, lambda p: p + 1)), F.transform(places, lambda p: p + 2)))

    def by_sort(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s: F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        return covered(F.transform(bound(pairs, same), lambda x: x["i"]))

    def of(h: Column) -> Column:
        """Most texts repeat few windows or none; for these, primitive sorting and a scan for the repeated values do."""
        twice = bound(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, j: (j > 0) & (F.get(s, j - 1) == x))))
        places = lambda d: F.transform(F.filter(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))), lambda p: F.array_contains(d, p["h"])), lambda p: p["i"])
        return bound(twice, lambda d: F.when(F.size(d) == 0, F.lit(0)).when(F.size(d) <= 32, covered(places(d))).otherwise(by_sort(h)))

    return F.coalesce(bound(hashes, lambda h: F.when(h.isNotNull(), of(h))), F.lit(0)).cast("long")


def measures(docs: DataFrame, p: str = "lm_") -> DataFrame:
    """docs with w (words, and those in repeated windows), word_chars, n_symbols and n_dup_lines, under names that begin with p."""
    text = F.coalesce(F.col("text"), F.lit(""))
    real = F.filter(lines_of(F.col("text")), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    stats = bound(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    return docs.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        stats.alias(f"{p}w"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias(f"{p}word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias(f"{p}n_symbols"),
        bound(real, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias(f"{p}n_dup_lines"),
    )


def host_lines(docs: DataFrame) -> DataFrame:
    """did, host, t (hash of the text), pos, w (words), a and b (hash of the key) of each line whose key is long enough."""
    row = lambda x: F.when(F.length(F.btrim(x, F.lit(SPACES))) >= KEY_CHARS, F.struct(key_hash(line_key(x)).alias("h"), F.size(words_of(x)).alias("w")))
    lines = docs.select(F.col("doc_id").alias("did"), F.col("source").alias("host"), text_hash(F.col("text")).alias("t"), F.posexplode(F.transform(lines_of(F.col("text")), row)).alias("pos", "x")).filter(F.col("x").isNotNull())
    return lines.select("did", "host", "t", "pos", F.col("x.w").alias("w"), F.col("x.h.a").alias("a"), F.col("x.h.b").alias("b"))


def boilerplate(docs: DataFrame, share: float = SHARE, few: int = FEW) -> DataFrame:
    """host, a, b: the keys of the lines above the limits. Documents of a host are counted once for each distinct text, so
    repeated rows and exact copies are one document; removing copies is another operator's task. Counts are pre-aggregated
    by text before the shuffle, so a line that a third of all rows share is spread by these."""
    hosts = docs.groupBy(F.col("source").alias("host")).agg(F.count_distinct(text_hash(F.col("text"))).alias("docs"))
    hashes = F.array_distinct(F.transform(F.filter(lines_of(F.col("text")), lambda x: F.length(F.btrim(x, F.lit(SPACES))) >= KEY_CHARS), lambda x: key_hash(line_key(x))))
    per = docs.select(F.col("source").alias("host"), text_hash(F.col("text")).alias("t"), F.explode(hashes).alias("h"))
    often = per.groupBy("host", F.col("h.a").alias("a"), F.col("h.b").alias("b")).agg(F.count_distinct("t").alias("n")).filter(F.col("n") > few)
    return often.alias("o").join(hosts.alias("s"), F.col("o.host").eqNullSafe(F.col("s.host"))).filter(F.col("n") > F.col("docs") * share).select("o.host", "a", "b")


def lost(docs: DataFrame, share: float = SHARE, few: int = FEW) -> DataFrame:
    """did, host, t, drops (place and words of each line that a row with these loses). Only keys above the limits are joined
    back to the lines."""
    often = boilerplate(docs, share, few)
    x = host_lines(docs).alias("l").join(often.alias("f"), (F.col("l.a") == F.col("f.a")) & (F.col("l.b") == F.col("f.b")) & F.col("l.host").eqNullSafe(F.col("f.host")))
    return x.filter(F.col("l.did").isNotNull()).groupBy("l.did", "l.host", "l.t").agg(F.collect_set(F.struct("l.pos", "l.w")).alias("drops"))


def judge(docs: DataFrame, share: float = SHARE, few: int = FEW) -> DataFrame:
    """docs with two more columns under own_names(docs): drops (places and words of the boilerplate lines of this row, or null) and m,
    a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_boilerplate_words and n_boilerplate_lines.

    Base: fewer than MIN_WORDS words, or over MAX_REPEAT per cent of them in repeated 3-word windows, fails. Method: lines
    (stripped, A-Z lowered, at least KEY_CHARS code points) are counted by distinct documents of the same source, copies
    of one text being one document; those in more than FEW documents and more than SHARE of the source's are boilerplate. A
    document over DEPLETED of whose words are boilerplate, or that has fewer than MIN_WORDS others, is rejected. Each row
    is judged by its own text, however often its doc_id is there. Null text has no words, so it fails; a null source is a
    host of its own; a null doc_id is judged by the base rules alone. An empty table gives no rows."""
    p = own_names(docs)
    gone = lost(docs.select("doc_id", "source", "text"), share, few).withColumnsRenamed({c: p + c for c in ("did", "host", "t", "drops")})
    same = (F.col("doc_id") == F.col(f"{p}did")) & (F.col(f"{p}text_hash") == F.col(f"{p}t")) & F.col("source").eqNullSafe(F.col(f"{p}host"))
    m = measures(docs, p).withColumn(f"{p}text_hash", text_hash(F.col("text"))).join(gone, same, "left")
    n, repeats = F.col(f"{p}w")["n"], F.col(f"{p}w")["r"]
    failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT * n)
    drops = F.coalesce(F.col(f"{p}drops"), F.array().cast("array<struct<pos:int,w:int>>"))
    less = F.aggregate(drops, F.lit(0).cast("long"), lambda s, x: s + x["w"])
    found = F.struct(
        n.alias("n_words"),
        *(F.col(p + c).alias(c) for c in ("word_chars", "n_symbols", "n_dup_lines")),
        repeats.alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (less <= DEPLETED * n) & ((less == 0) | (n - less >= MIN_WORDS))).alias("kept"),
        less.alias("n_boilerplate_words"),
        F.size(drops).cast("long").alias("n_boilerplate_lines"),
    )
    return m.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(f"{p}drops"), found.alias(f"{p}m"))


def quality_report(docs: DataFrame) -> DataFrame:
    """The measures and verdict of every row. The text isn't shuffled: only measures and line hashes are."""
    m = judge(docs.select("doc_id", "source", "text"))
    return m.select("doc_id", "lm_m.*").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_boilerplate_words", "n_boilerplate_lines")


def keep_good(docs: DataFrame, share: float = SHARE, few: int = FEW) -> DataFrame:
    """The documents that the rules keep (see judge), with their own columns, without their hosts' boilerplate lines. A
    column n_chars is set anew where lines go. Clashing names do no harm; an empty table stays empty."""
    p = own_names(docs)
    kept = judge(docs, share, few).filter(F.col(f"{p}m")["kept"])
    drops = F.col(f"{p}drops")
    less = F.array_join(without(lines_of(F.col("text")), F.transform(drops, lambda x: x["pos"])), "\n")
    out = kept.withColumn("text", F.when(drops.isNull(), F.col("text")).otherwise(less))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(drops.isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM t),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS n FROM g WHERE w3 IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n >= 2) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
d AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY doc_id),
k AS (SELECT l.doc_id, s.source AS host, hash(s.text) AS whole, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l JOIN documents s ON l.doc_id = s.doc_id),
h AS (SELECT source AS host, count(DISTINCT coalesce(text, '')) AS docs FROM documents GROUP BY source),
o AS (SELECT k.host, k.key FROM k JOIN h ON k.host = h.host WHERE length(k.key) >= 10 GROUP BY k.host, k.key, h.docs HAVING count(DISTINCT whole) > 5 AND count(DISTINCT whole) > 0.005 * h.docs),
b AS (SELECT k.doc_id, sum(len(list_filter(regexp_split_to_array(k.key, '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))) AS gone, count(*) AS lines FROM k JOIN o ON k.host = o.host AND k.key = o.key GROUP BY k.doc_id),
m AS (SELECT w.doc_id, len(w.ws) AS n_words, coalesce(list_sum(list_transform(w.ws, lambda x: length(x))), 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(d.n_dup_lines, 0) AS n_dup_lines, coalesce(r.n_repeat_words, 0) AS n_repeat_words, coalesce(b.gone, 0) AS gone, coalesce(b.lines, 0) AS lines
  FROM w LEFT JOIN d ON w.doc_id = d.doc_id LEFT JOIN r ON w.doc_id = r.doc_id LEFT JOIN b ON w.doc_id = b.doc_id),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, (NOT base_failed AND gone <= 0.5 * n_words AND (gone = 0 OR n_words - gone >= 50)) AS kept, CAST(gone AS BIGINT) AS n_boilerplate_words, CAST(lines AS BIGINT) AS n_boilerplate_lines
FROM f
"""
