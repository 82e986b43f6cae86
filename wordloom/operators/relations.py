"""Graphs, morphology, correspondences and data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import EPSILON, Metric, normalized, weighted_distance
from .index import lexicon
from .rounds import kept

#: (kind, form) of affixes, for stripping.
AFFIXES = [("prefix", f) for f in ("re", "un", "in", "th", "wh")] + [("suffix", f) for f in ("ing", "ed", "ly", "tion", "er")]
MIN_STEM = 3


def closure(edges: DataFrame) -> DataFrame:
    """code, member: each code with itself and all that lies below it, however deep, from edges (parent, child). A cycle is
    an error."""
    edges = kept(edges.select("parent", "child").distinct())
    nodes = edges.select(F.col("parent").alias("code")).union(edges.select("child")).distinct()
    out = nodes.select("code", F.col("code").alias("member"))
    new = edges.select(F.col("parent").alias("code"), F.col("child").alias("member"))
    while new.take(1):
        out = kept(out.union(new))
        step = kept(new.join(edges, F.col("member") == F.col("parent")).select("code", F.col("child").alias("member")).distinct())
        if step.filter("code = member").take(1):
            raise ValueError("the edges have a cycle")
        new = kept(step.join(out, ["code", "member"], "left_anti"))
    return out


def strip_once(words: DataFrame, affixes: DataFrame) -> DataFrame:
    """word, stem, n, last: one affix off, by its kind, from (word, stem, n, last). Affixes are a short list, so it is sent to the tasks; each
    form is looked up by what the word begins or ends with, at the lengths that the list has."""
    lengths = sorted({(r[0], r[1]) for r in affixes.select("kind", F.length("form")).distinct().collect()})
    ends = words.select("word", "stem", "n", "last", F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), (F.expr(f"left(stem, {k})") if kind == "prefix" else F.expr(f"right(stem, {k})")).alias("form")) for kind, k in lengths))).alias("e"))
    ends = ends.select("word", "stem", "n", "last", "e.kind", "e.form").filter((F.length("stem") - F.length("form") >= MIN_STEM) & (F.col("last").isNull() | (F.col("last") != F.col("kind"))))
    left = F.when(F.col("kind") == "prefix", F.expr("substring(stem, length(form) + 1)")).otherwise(F.expr("left(stem, length(stem) - length(form))"))
    return ends.join(F.broadcast(affixes), ["kind", "form"]).select("word", left.alias("stem"), (F.col("n") + 1).alias("n"), F.col("kind").alias("last"))


def strip_affixes(words: DataFrame, affixes: DataFrame) -> DataFrame:
    """word, stem, n: all stems within two affixes, each kind at most once, with the fewest affixes that give them."""
    zero = words.select("word", F.col("word").alias("stem"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("last"))
    one = strip_once(zero, affixes)
    two = strip_once(one, affixes)
    return zero.unionByName(one).unionByName(two).groupBy("word", "stem").agg(F.min("n").alias("n"))


def descendants(edges: DataFrame, seeds: DataFrame, cap: float) -> DataFrame:
    """word, cost, root, steps: the cheapest way from a seed to each word over edges (root, word, cost) whose costs add up to at
    most cap, with the seed it begins at and its length (of equally cheap ways one of the fewest steps, then of the first seed); the seeds (word, cost) themselves are left out. Costs are
    positive. Rounds go on until no word gets cheaper; each keeps one row a word, so rounds don't multiply ways."""
    edges = kept(edges.select("root", F.col("word").alias("to"), F.col("cost").alias("w")))
    seeds = kept(seeds.select("word", F.col("cost").cast("double").alias("cost"), F.lit(0.0).alias("path"), F.col("word").alias("start"), F.lit(0).alias("steps")))
    best, new = seeds, seeds
    while new.take(1):
        step = new.join(edges, F.col("word") == F.col("root")).filter(F.col("path") + F.col("w") <= cap + 1e-9)
        way = F.struct(F.round(F.col("cost") + F.col("w"), 9).alias("cost"), F.round(F.col("path") + F.col("w"), 9).alias("path"), F.col("start"), (F.col("steps") + 1).alias("steps"))
        least = step.groupBy(F.col("to").alias("word")).agg(F.min(way).alias("b")).select("word", "b.*")
        old = best.select("word", F.col("cost").alias("had"))
        new = kept(least.join(old, "word", "left").filter(F.col("had").isNull() | (F.col("cost") < F.col("had") - 1e-12)).drop("had"))
        best = kept(best.join(new.select("word"), "word", "left_anti").unionByName(new))
    return best.filter("steps > 0").join(seeds.select("word"), "word", "left_anti").select("word", F.round("cost", 9).alias("cost"), F.col("start").alias("root"), "steps")


def select_parses(parses: DataFrame, spread: float, cap: float | None = None) -> DataFrame:
    """Parses (word, stem, cost) within spread of their word's best; with cap none dearer than that."""
    best = F.min("cost").over(Window.partitionBy("word"))
    out = parses.withColumn("best", best).filter(F.col("cost") <= F.col("best") + spread + 1e-9)
    return (out.filter(F.col("cost") <= cap + 1e-9) if cap is not None else out).drop("best")


def spread_cut(hits: DataFrame, spread: float) -> DataFrame:
    """Hits (q, distance) within spread of their query's best."""
    return hits.withColumn("b", F.min("distance").over(Window.partitionBy("q"))).filter(F.col("distance") <= F.col("b") + spread + 1e-9).drop("b")


def children(items: DataFrame, parent: str, child: str) -> DataFrame:
    """parent, n, first, last of each parent's children."""
    return items.groupBy(F.col(parent).alias("parent")).agg(F.count("*").alias("n"), F.min(child).alias("first_child"), F.max(child).alias("last_child"))


def blocked(queries: DataFrame, terms: DataFrame, top: int = 300) -> DataFrame:
    """q, term, shared, place: the terms that share most adjacent pairs of ^term$ with a query, of equals the first by code point.
    Texts are numbered first, in that order, so that pairs of them are counted as single numbers."""
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.xxhash64(F.substring(F.concat(F.lit("^"), c, F.lit("$")), i, 2))))
    numbers = kept(lexicon(queries.select(F.col("q").alias("term")).union(terms.select("term"))))
    of = lambda df, c: df.select(F.col(c).alias("term")).join(numbers, "term").select("term_id", F.explode(pairs(F.col("term"))).alias("pair"))
    a, b = of(queries, "q").withColumnRenamed("term_id", "x"), of(terms, "term").withColumnRenamed("term_id", "y")
    both = a.join(b, "pair").filter("x <> y").groupBy("x", "y").agg(F.count("*").alias("shared"))
    order = Window.partitionBy("x").orderBy(F.desc("shared"), "y")
    best = both.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    named = lambda c, name: numbers.select(F.col("term_id").alias(c), F.col("term").alias(name))
    return best.join(named("x", "q"), "x").join(named("y", "term"), "y").select("q", "term", "shared", "place")


def shortened(words: DataFrame, edits: int) -> DataFrame:
    """The rows of words (with a column key) with gram, the key less any `left` of its characters, for 0 to edits, each gram once."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    levels = [F.array("key")]
    for _ in range(edits):
        levels.append(F.array_distinct(F.flatten(F.transform(F.filter(levels[-1], lambda w: w != ""), less))))
    # All in one row: a union of levels would read and split the words' source once for each.
    at = lambda n: lambda w: F.struct(w.alias("gram"), F.lit(n).alias("left"))
    each = F.concat(*(F.transform(x, at(n)) for n, x in enumerate(levels)))
    # Texts of different levels have different lengths, so a gram is there once.
    return words.withColumn("e", F.explode(each)).select(*words.columns, "e.gram", "e.left")


def within(queries: DataFrame, terms: DataFrame, metric: Metric, most: Column, limit: float, normal: float) -> DataFrame:
    """q, term, distance: all terms within a weighted distance of `most` (of q, limit at most) and, divided by the longer length, of `normal`.

    Each plain edit costs at least `plain`, so a term within the distance is at most most/plain plain edits away; rules
    don't change folded texts (Metric.fold). Two texts at most n edits apart become equal when up to n characters are taken
    from each, so this equi-join finds every such term; edits of the folded texts and the distance itself then decide."""
    plain = min(metric.costs.substitute, metric.costs.delete, metric.costs.insert)
    fold = metric.fold()
    kept = [c for c in fold if fold[c]]
    key = lambda c: F.translate(c, "".join([*kept, *(c for c in fold if not fold[c])]), "".join(fold[c] for c in kept))
    edits = F.floor((F.least(most, F.lit(limit)) + EPSILON) / plain)
    n = int((limit + EPSILON) / plain)
    q = queries.select("q", key(F.col("q")).alias("key"), most.alias("most"), edits.alias("edits"))
    # A term longer than the longest query by more edits than there are can't be near any.
    longest = q.agg(F.max(F.length("key") + F.col("edits"))).first()[0] or 0
    # Grams meet as hashes: the edits of whole texts decide, so two grams of one hash do no harm.
    hashed = lambda df: df.withColumn("gram", F.xxhash64("gram"))
    a = hashed(shortened(q, n).filter("left <= edits"))
    b = hashed(shortened(terms.select("term", key(F.col("term")).alias("key")).filter(F.length("key") <= longest), n)).drop("key")
    pairs = a.alias("a").join(b.alias("b"), F.col("a.gram") == F.col("b.gram")).filter(F.col("b.left") <= F.col("edits"))
    pairs = pairs.filter(F.levenshtein(F.col("a.key"), key(F.col("b.term"))) <= F.col("edits")).select("q", "term", "most").distinct()
    # Distances cost more than their few bytes tell, so pairs are spread by number.
    pairs = pairs.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = pairs.withColumn("distance", weighted_distance(metric)("q", "term"))
    return d.filter((F.col("distance") <= F.least("most", F.lit(limit)) + EPSILON) & (normalized(F.col("distance"), F.col("q"), F.col("term"), "max") <= normal + EPSILON)).select("q", "term", "distance")


def cost_table(counts: DataFrame, beta: float = 1.0) -> DataFrame:
    """a, b, s, w, cost: minus log of the share of w among what s corresponds to, smoothed towards identity. counts: a, b, s, w, n, with an
    empty s or w for nothing."""
    rows = counts.groupBy("a", "b", "s", "w").agg(F.sum("n").alias("n"))
    same = F.when((F.col("s") == F.col("w")) & (F.col("s") != ""), beta).otherwise(0.0)
    total = F.sum("n").over(Window.partitionBy("a", "b", "s")) + F.when(F.col("s") != "", beta).otherwise(0.0)
    return rows.select("a", "b", "s", "w", F.round(-F.log((F.col("n") + same) / total), 9).alias("cost"))


def treated(tokens: DataFrame) -> DataFrame:
    """term, n: word-like terms of running text with the number of their records. tokens: term, doc; distinct."""
    return tokens.filter(F.col("term").rlike(r"[\p{L}\p{N}]")).groupBy("term").agg(F.count("doc").alias("n"))


def untreated(tokens: DataFrame, heads: DataFrame) -> DataFrame:
    """term, n: those terms without an entry."""
    return treated(tokens.distinct()).join(heads.select("term").distinct(), "term", "left_anti")


def duplicates(records: DataFrame, key: Column) -> DataFrame:
    """text, n, sources, same_source, cross_source: texts that more than one record has."""
    g = records.select(key.alias("text"), "source").filter("text <> ''").groupBy("text").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources")).filter("n > 1")
    return g.select("text", "n", "sources", (F.col("sources") < F.col("n")).alias("same_source"), (F.col("sources") > 1).alias("cross_source"))


def issues(records: DataFrame, ident: str, parent: str, parents: DataFrame, parent_id: str) -> DataFrame:
    """issue, id, n: repeated ids, and references to a parent that isn't there."""
    twice = records.groupBy(F.col(ident).alias("id")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate id").alias("issue"), "id", "n")
    lost = records.join(parents.select(F.col(parent_id).alias(parent)), parent, "left_anti").groupBy(F.col(parent).alias("id")).agg(F.count("*").alias("n")).select(F.lit("missing parent").alias("issue"), "id", "n")
    return twice.unionByName(lost)


def source_stats(records: DataFrame, units: tuple[str, ...] = ("affix", "word", "phrase", "sentence")) -> DataFrame:
    """source, records, groups, and a count for each unit, from records (source, doc_id, unit)."""
    return records.groupBy("source").agg(F.count("*").alias("records"), F.count_distinct("doc_id").alias("groups"), *(F.count_if(F.col("unit") == u).alias(u) for u in units))
