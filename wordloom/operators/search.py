"""Search over postings: entries, occurrences, tallies, caps, glosses. Everything takes a batch of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .index import grams, partial_matches, repeated
from .rounds import kept

TYPE_RANK = {kind: i for i, kind in enumerate("fuzzy prefix lemma derived sibling suffix substring".split())}
GROUPS = {"exact": "spelling", "fuzzy": "spelling", "prefix": "partial", "suffix": "partial", "substring": "partial", "lemma": "automatic", "derived": "automatic", "sibling": "automatic"}


def lookup(c: Column, table: dict) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(c == k, F.lit(v))
    return out


def term_matches(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """q, term, match_type, distance, score: equal terms and partial ones."""
    same = queries.join(terms.select("term"), F.col("q") == F.col("term")).select("q", "term", F.lit("fuzzy").alias("match_type"), F.lit(0.0).alias("score"))
    return same.unionByName(partial_matches(queries, terms).select("q", "term", "match_type", "score")).withColumn("distance", F.lit(0.0))


def method(match_type: Column, distance: Column) -> Column:
    return F.when(match_type != "fuzzy", match_type).when(distance > 0, "fuzzy").otherwise("exact")


def entries(matches: DataFrame, heads: DataFrame) -> DataFrame:
    """q, doc, term, match_type, score: the best posting of each record for each query. heads: term, doc."""
    order = Window.partitionBy("q", "doc").orderBy("score", lookup(F.col("match_type"), TYPE_RANK), F.length("term"), "term")
    hits = matches.join(heads, "term").withColumn("n", F.row_number().over(order)).filter("n = 1")
    return hits.select("q", "doc", "term", "match_type", "distance", "score")


def tally(hits: DataFrame) -> DataFrame:
    """q, grouping (method or group), name, docs: distinct records by method and by group of methods, as two grouping sets."""
    m = hits.select("q", "doc", method(F.col("match_type"), F.col("distance")).alias("method")).withColumn("group", lookup(F.col("method"), GROUPS))
    by = lambda c: m.groupBy("q", F.lit(c).alias("grouping"), F.col(c).alias("name")).agg(F.count_distinct("doc").alias("docs"))
    return by("method").unionByName(by("group"))


def capped(hits: DataFrame, limit: int) -> DataFrame:
    """The first `limit` hits of each query; those of the sibling tier are kept beyond it."""
    tier = F.when(F.col("match_type") == "sibling", 1).otherwise(0)
    order = Window.partitionBy("q", "tier").orderBy("score", lookup(F.col("match_type"), TYPE_RANK), F.length("term"), "term", "doc")
    return hits.withColumn("tier", tier).withColumn("place", F.row_number().over(order)).filter((F.col("tier") == 1) | (F.col("place") <= limit)).drop("tier")


def merged(hits: DataFrame) -> DataFrame:
    """One row for each (q, term): a sibling match never displaces another, a partial match yields to a morphological one at the smaller
    score, else the smaller score wins and spelling wins ties."""
    morph = F.col("match_type").isin("lemma", "derived")
    best = lambda cond: F.min(F.when(cond, F.struct("score", lookup(F.col("match_type"), TYPE_RANK).alias("r"), "match_type")))
    g = hits.groupBy("q", "term").agg(best(F.col("match_type") == "fuzzy").alias("f"), best(F.col("match_type").isin("prefix", "suffix", "substring")).alias("p"), best(morph).alias("m"), best(F.col("match_type") == "sibling").alias("s"))
    row = lambda kind, score: F.struct(kind.alias("match_type"), score.alias("score"))
    f, p, m, s = (F.col(c) for c in "fpms")
    pick = (
        F.when(f.isNotNull() & (m.isNull() | (m["score"] >= f["score"] - 1e-9)), row(f["match_type"], f["score"]))
        .when(m.isNotNull() & f.isNull() & p.isNotNull(), row(m["match_type"], F.least(m["score"], p["score"])))
        .when(m.isNotNull(), row(m["match_type"], m["score"]))
        .when(p.isNotNull(), row(p["match_type"], p["score"]))
        .otherwise(row(s["match_type"], s["score"]))
    )
    return g.select("q", "term", pick.alias("x")).select("q", "term", "x.match_type", "x.score")


def occurrences(queries: DataFrame, tokens: DataFrame) -> DataFrame:
    """qid, doc, n_words, n_distinct: records that hold every word of a query (relational division). queries: qid, text; tokens: term, doc.

    A query's rarest word proposes the records; its other words are then looked up only there."""
    words = queries.select("qid", F.explode(T.split_words(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("k"))
    need = words.groupBy("qid").agg(F.count("*").alias("n_distinct"), F.sum("k").alias("n_words"))
    tokens = kept(tokens.join(words.select("term").distinct(), "term", "left_semi"))
    df = tokens.groupBy("term").agg(F.count("*").alias("n"))
    rare = words.join(df, "term").groupBy("qid").agg(F.min(F.struct("n", "term")).alias("r")).select("qid", F.col("r.term").alias("term"))
    proposed = rare.join(tokens, "term").select("qid", "doc")
    found = proposed.join(words.select("qid", "term"), "qid").join(tokens, ["term", "doc"]).groupBy("qid", "doc").agg(F.count("*").alias("found"))
    return found.join(need, "qid").filter("found = n_distinct").select("qid", "doc", "n_words", "n_distinct")


def gloss_hits(queries: DataFrame, glosses: DataFrame) -> DataFrame:
    """qid, doc, rank of glosses that hold every query word that is no stop word: whole words, or beginnings of at least three letters.

    rank: 0 a sense is the phrase, 1 it begins with it, 2 it holds it, 3 else; `to ` may stand before it. queries: qid, text;
    glosses: doc, gloss (senses parted by semicolons)."""
    q = queries.select("qid", F.filter(T.gloss_tokens(F.col("text")), lambda w: ~w.isin(*T.STOPWORDS)).alias("ws")).filter(F.size("ws") > 0)
    # The words of all glosses of a doc count; where no doc repeats, that is the gloss itself.
    g = glosses.select("doc", "gloss", F.col("gloss").alias("whole"))
    if repeated(glosses, "doc"):
        g = g.drop("whole").join(glosses.groupBy("doc").agg(F.array_join(F.sort_array(F.collect_set("gloss")), ";").alias("whole")), "doc")
    # Equal glosses are looked at once; a query's word with the fewest glosses proposes them, the other words are looked up there.
    senses = F.transform(F.split("gloss", "[;；]"), lambda s: F.array_join(T.gloss_tokens(s), " "))
    kinds = kept(g.select("whole", "gloss").distinct())
    texts = kept(kinds.select("whole").distinct().select("whole", T.gloss_tokens(F.col("whole")).alias("tokens")))
    index = texts.select("whole", F.explode("tokens").alias("token"))
    vocabulary = index.groupBy("token").agg(F.count("*").alias("k"))
    # Beginnings are an equi-join on the first three letters; shorter words are looked up whole.
    need = q.select("qid", "ws", F.explode("ws").alias("w"))
    asked = need.select("w").distinct()
    long = asked.filter(F.length("w") >= 3).join(vocabulary, (F.substring("w", 1, 3) == F.substring("token", 1, 3)) & F.col("token").startswith(F.col("w")))
    forms = kept(long.unionByName(asked.filter(F.length("w") < 3).join(vocabulary, F.col("w") == F.col("token"))))
    reach = forms.groupBy("w").agg(F.sum("k").alias("k"))
    rare = need.join(reach, "w").groupBy("qid", "ws").agg(F.min(F.struct("k", "w")).alias("r"), F.count("*").alias("have")).filter(F.col("have") == F.size("ws")).select("qid", "ws", F.col("r.w").alias("w"))
    proposed = index.join(rare.join(forms, "w"), "token").select("qid", "ws", "whole").distinct()
    holds = F.forall("ws", lambda w: F.exists("tokens", lambda t: (t == w) | ((F.length(w) >= 3) & t.startswith(w))))
    found = proposed.join(texts, "whole").filter(holds).select("qid", "whole", F.array_join("ws", " ").alias("phrase"))
    p = F.col("phrase")
    has = lambda f: F.exists("senses", f)
    to = F.concat(F.lit("to "), p)
    rank = F.when(has(lambda s: (s == p) | (s == to)), 0).when(has(lambda s: s.startswith(p) | s.startswith(to)), 1).when(has(lambda s: F.concat(F.lit(" "), s, F.lit(" ")).contains(F.concat(F.lit(" "), p, F.lit(" ")))), 2).otherwise(3)
    ranked = found.join(kinds.select("whole", "gloss", senses.alias("senses")), "whole").select("whole", "gloss", "qid", rank.alias("rank"))
    return g.join(ranked, ["whole", "gloss"]).select("qid", "doc", "rank")


def zh_gloss_hits(queries: DataFrame, glosses: DataFrame) -> DataFrame:
    """qid, doc, rank of glosses that hold a query, blanks aside: 0 a sense is the query, 1 it begins with it, else 3. Candidates
    come from the query's rarest character or pair. queries: qid, text; glosses: doc, gloss (senses parted by ；;，,、)."""
    q = queries.select("qid", T.zh_key(F.col("text")).alias("q")).filter("q <> ''")
    g = glosses.select("doc", T.zh_key(F.col("gloss")).alias("zh"))
    texts = g.select("zh").distinct()
    index = texts.select("zh", F.explode(grams(F.col("zh"))).alias("gram"))
    df = index.groupBy("gram").agg(F.count("*").alias("n"))
    asked = q.select("q").distinct()
    rare = asked.select("q", F.explode(grams(F.col("q"))).alias("gram")).join(df, "gram", "left").groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).select("q", F.col("r.gram").alias("gram"))
    senses = F.transform(F.split("zh", "[；;，,、]"), lambda x: F.trim(x))
    rank = F.when(F.exists(senses, lambda x: x == F.col("q")), 0).when(F.exists(senses, lambda x: x.startswith(F.col("q"))), 1).otherwise(3)
    hits = rare.join(index, "gram").filter(F.col("zh").contains(F.col("q"))).select("q", "zh", rank.alias("rank"))
    return q.join(hits, "q").join(g, "zh").select("qid", "doc", "rank")


def gloss_order(hits: DataFrame, glosses: DataFrame) -> DataFrame:
    """hits (qid, doc, rank) with place: by rank, then the shorter gloss, then doc."""
    order = Window.partitionBy("qid").orderBy("rank", F.length("gloss"), "doc")
    return hits.join(glosses.select("doc", "gloss"), "doc").withColumn("place", F.row_number().over(order)).select("qid", "doc", "rank", "place")


KIND_RANK = {k: i for i, k in enumerate(("head", "alt", "variant", "root", "token"))}


def entry_order(hits: DataFrame) -> DataFrame:
    """Hits (q, doc, term, match_type, score, kind, role, text) with place, by eight keys: those of the sibling tier last; score, match
    type, the term's length, kind, role, the text's length, doc."""
    tier = F.when(F.col("match_type") == "sibling", 1).otherwise(0)
    order = Window.partitionBy("q").orderBy(tier, "score", lookup(F.col("match_type"), TYPE_RANK), F.length("term"), lookup(F.col("kind"), KIND_RANK), "role", F.length("text"), "doc")
    return hits.withColumn("place", F.row_number().over(order))


def replaced(hits: DataFrame) -> DataFrame:
    """One hit for each (q, doc): a sibling only where there is nothing else, then the smallest score, then spelling first."""
    order = Window.partitionBy("q", "doc").orderBy(F.when(F.col("match_type") == "sibling", 1).otherwise(0), "score", lookup(F.col("match_type"), TYPE_RANK), F.length("term"), "term")
    return hits.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def placed_hits(matches: DataFrame, postings: DataFrame) -> DataFrame:
    """q, doc, term, match_type, score: every posting (term, doc, kind but token) of each match. Derived and sibling matches skip
    root postings, and a root posting costs 0.1 more."""
    hits = matches.join(postings.filter("kind <> 'token'"), "term").filter(~(F.col("match_type").isin("derived", "sibling") & (F.col("kind") == "root")))
    return hits.withColumn("score", F.round(F.col("score") + F.when(F.col("kind") == "root", 0.1).otherwise(0.0), 9))


def scored_occurrences(queries: DataFrame, matches: DataFrame, tokens: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """qid, doc, score, match_type, n_terms: records that hold a match of every query word. The best match of each word counts; scores
    add up, once for each repeat of a word; the weakest match type names the hit. Records in `without` (qid, doc) are left
    out. queries: qid, text; matches: q, term, match_type, score; tokens: term, doc.

    A query's word with the fewest records proposes them; the other words are looked up only there."""
    words = queries.select("qid", F.explode(T.split_words(F.col("text"))).alias("q")).groupBy("qid", "q").agg(F.count("*").alias("times"))
    need = words.groupBy("qid").agg(F.count("*").alias("n"))
    sizes = tokens.groupBy("term").agg(F.count("*").alias("k"))
    reach = matches.join(sizes, "term").groupBy("q").agg(F.sum("k").alias("k"))
    rare = words.join(reach, "q").groupBy("qid").agg(F.min(F.struct("k", "q")).alias("r"), F.count("*").alias("have")).join(need, "qid").filter("have = n").select("qid", F.col("r.q").alias("q"))
    proposed = rare.join(matches.select("q", "term"), "q").join(tokens, "term").select("qid", "doc").distinct()
    asked = proposed.join(words, "qid").join(matches, "q").select("qid", "doc", "q", "times", "term", "match_type", "score").join(tokens, ["term", "doc"])
    best = asked.groupBy("qid", "doc", "q", "times").agg(F.min(F.struct("score", lookup(F.col("match_type"), TYPE_RANK).alias("rank"))).alias("b"), F.count_distinct("term").alias("terms"))
    out = best.groupBy("qid", "doc").agg(F.count("*").alias("found"), F.sum(F.col("b.score") * F.col("times")).alias("score"), F.max("b.rank").alias("rank"), F.sum("terms").alias("n_terms"))
    out = out.join(need, "qid").filter("found = n")
    if without is not None:
        out = out.join(without, ["qid", "doc"], "left_anti")
    names = F.array(*(F.lit(k) for k in TYPE_RANK))
    return out.select("qid", "doc", F.round("score", 9).alias("score"), F.element_at(names, F.col("rank") + 1).alias("match_type"), "n_terms")


def occurrence_order(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Scored occurrences with place: score, weakest match type, the text's length, doc. docs: doc, length."""
    order = Window.partitionBy("qid").orderBy(F.when(F.col("match_type") == "sibling", 1).otherwise(0), "score", lookup(F.col("match_type"), TYPE_RANK), "length", "doc")
    return hits.join(docs.select("doc", "length"), "doc").withColumn("place", F.row_number().over(order)).drop("length")


def doc_filter(docs: DataFrame, sources=(), langs=(), statuses=()) -> DataFrame:
    """Empty lists filter nothing; `none` among langs takes records without a variety."""
    for name, values in (("source", sources), ("status", statuses)):
        if values:
            docs = docs.filter(F.col(name).isin(*values))
    if langs:
        cond = F.col("lang").isin(*[x for x in langs if x != "none"])
        docs = docs.filter(F.coalesce(cond, F.lit(False)) | (F.col("lang").isNull() if "none" in langs else F.lit(False)))
    return docs


def page(df: DataFrame, keys: list, offset: int, limit: int) -> DataFrame:
    """A page in key order, with the total of all rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*keys).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def kwic(docs: DataFrame, nodes: DataFrame, width: int = 3) -> DataFrame:
    """doc, pos, word, left, right: each place of each node word with its neighbours, nearest first. nodes: word. Contexts are
    cut before words become rows, so a row is a word and its neighbours and never the whole text."""
    words = docs.select(F.col("doc_id").alias("doc"), T.split_words(F.col("text")).alias("ws"))

    def place(w: Column, i: Column) -> Column:
        left = F.reverse(F.slice("ws", F.greatest(i - width + 1, F.lit(1)), F.least(i, F.lit(width))))
        return F.struct(i.alias("pos"), w.alias("word"), F.array_join(left, " ").alias("left"), F.array_join(F.slice("ws", i + 2, width), " ").alias("right"))

    each = words.select("doc", F.explode(F.transform("ws", place)).alias("x")).select("doc", "x.*")
    return each.join(nodes, "word", "left_semi").select("doc", "pos", "word", "left", "right")


def ngram_frequency(docs: DataFrame, n: int) -> DataFrame:
    """gram, count, docs over all runs of n words."""
    size = F.greatest(F.size("ws") - n + 1, F.lit(0))
    run = F.slice("ws", F.lit(1), size)
    for k in range(2, n + 1):
        run = F.zip_with(run, F.slice("ws", F.lit(k), size), lambda a, b: F.concat(a, F.lit(" "), b))
    grams = docs.select("doc_id", T.split_words(F.col("text")).alias("ws")).select("doc_id", run.alias("grams"))
    if not repeated(docs, "doc_id"):
        # Each run counts, and once more for its document, so only counts of runs are shuffled.
        one = lambda count, docs: lambda g: F.struct(g.alias("gram"), F.lit(count).alias("count"), F.lit(docs).alias("docs"))
        each = F.concat(F.transform("grams", one(1, 0)), F.transform(F.array_distinct("grams"), one(0, 1)))
        return grams.select(F.explode(each).alias("x")).groupBy("x.gram").agg(F.sum("x.count").alias("count"), F.sum("x.docs").alias("docs"))
    runs = grams.select("doc_id", F.explode("grams").alias("gram"))
    per = runs.groupBy("gram", "doc_id").agg(F.count("*").alias("k"))
    return per.groupBy("gram").agg(F.sum("k").alias("count"), F.count("*").alias("docs"))
