"""Families of entries: parents, ways up, trees, spellings, dictionary relations, and the graph of analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import kept

DEPTH = 32


def parents(items: DataFrame) -> DataFrame:
    """id, parent (null at the top) of every item.

    items: id, source, key (search key), text, grp (entry group or null), head (whether it heads it), seq, up (a parent that
    the group names), links (ids it is said to derive from), derived (texts it may derive from, in order). A member of an
    entry group hangs below the parent its group names, else below the group's first head. Any other item hangs below its first link
    that exists, else, if a head, below the head of its source that alone has a derived text as its key, or alone as its text. A
    way up that comes back or has more than DEPTH steps is cut."""
    items = kept(items)
    ids = items.select(F.col("id").alias("known"))
    heads = items.filter("grp IS NOT NULL AND head")
    first = heads.groupBy(F.col("grp").alias("g")).agg(F.min_by("id", F.struct("seq", "id")).alias("first"))
    member = items.filter("grp IS NOT NULL AND NOT head").select("id", "grp", "up")
    member = member.join(ids, F.col("up") == F.col("known"), "left").join(first, F.col("grp") == F.col("g"), "left").select("id", F.coalesce("known", "first").alias("parent"))
    rest = items.filter("grp IS NULL OR head")
    link = rest.select("id", F.posexplode("links").alias("pos", "target")).join(ids, F.col("target") == F.col("known")).groupBy("id").agg(F.min_by("target", "pos").alias("parent"))
    note = heads.join(link, "id", "left_anti").select("id", "source", F.col("grp").alias("own"), F.posexplode("derived").alias("pos", "d")).select("id", "source", "own", "pos", F.col("d.key").alias("dk"), F.col("d.text").alias("dt"))
    h = heads.select(F.col("id").alias("hid"), F.col("source").alias("hs"), F.col("key").alias("hk"), F.col("text").alias("ht"), F.col("grp").alias("hg"))
    found = note.join(h, (F.col("source") == F.col("hs")) & (F.col("dk") == F.col("hk")) & (F.col("own") != F.col("hg")))
    same = F.col("ht") == F.col("dt")
    found = found.groupBy("id", "pos").agg(F.count("*").alias("n"), F.min("hid").alias("one"), F.count_if(same).alias("exact"), F.min(F.when(same, F.col("hid"))).alias("alike"))
    found = found.withColumn("p", F.when(F.col("n") == 1, F.col("one")).when(F.col("exact") == 1, F.col("alike"))).filter("p IS NOT NULL")
    derived = found.groupBy("id").agg(F.min_by("p", "pos").alias("parent"))
    one = member.unionByName(link).unionByName(derived).filter("parent <> id")
    return cut(items.select("id").join(one, "id", "left"))


def cut(tree: DataFrame) -> DataFrame:
    """id, parent, without the parents of those whose way up never ends within DEPTH steps. Ways double each round, and only those that
    go on are looked at again."""
    tree = kept(tree.select("id", "parent"))
    far = tree.filter("parent IS NOT NULL")
    for _ in range(DEPTH.bit_length() - 1):
        far = kept(far.join(far.select(F.col("id").alias("parent"), F.col("parent").alias("next")), "parent").select("id", F.col("next").alias("parent")))
        if not far.take(1):
            return tree
    endless = far.select("id").withColumn("bad", F.lit(True))
    return tree.join(endless, "id", "left").select("id", F.when(F.col("bad").isNull(), F.col("parent")).alias("parent"))


def ancestors(tree: DataFrame) -> DataFrame:
    """id, ancestor, depth: all ways up, from 1 step on."""
    step = kept(tree.filter("parent IS NOT NULL").select("id", "parent"))
    new = step.select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    out = new
    while new.take(1):
        new = kept(new.join(step.select(F.col("id").alias("ancestor"), F.col("parent").alias("next")), "ancestor").select("id", F.col("next").alias("ancestor"), (F.col("depth") + 1).alias("depth")))
        out = out.unionByName(new)
    return out


def children(tree: DataFrame) -> DataFrame:
    """parent, children: the ids below each, in order."""
    return tree.filter("parent IS NOT NULL").groupBy("parent").agg(F.sort_array(F.collect_list("id")).alias("children"))


def families(tree: DataFrame, hits: DataFrame) -> DataFrame:
    """root, members, hits, best, best_id of each tree that has a hit (id, score), members being all of it."""
    up = ancestors(tree)
    top = up.groupBy("id").agg(F.max_by("ancestor", "depth").alias("root"))
    of = kept(tree.select("id").join(top, "id", "left").select("id", F.coalesce("root", "id").alias("root")))
    size = of.groupBy("root").agg(F.count("*").alias("members"))
    best = of.join(hits, "id").groupBy("root").agg(F.count("*").alias("hits"), F.min(F.struct("score", "id")).alias("b"))
    return best.join(size, "root").select("root", "members", "hits", F.col("b.score").alias("best"), F.col("b.id").alias("best_id"))


def spellings(items: DataFrame) -> DataFrame:
    """text, n, first: texts that two or more of the items (id, text) have, blanks at the ends aside."""
    return items.select("id", F.trim("text").alias("text")).filter("text <> ''").groupBy("text").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1")


def relations(tree: DataFrame, seeds: DataFrame) -> DataFrame:
    """q, id, kind, depth: what a dictionary relates to each seed (q, id): what is below it (root), above it (parent) and, at the sum of both
    ways, below what is above it (sibling). The shallowest relation of an item stays; of equals root comes before parent
    and sibling."""
    up = kept(ancestors(tree))
    down = seeds.join(up.select(F.col("id").alias("x"), F.col("ancestor").alias("id"), "depth"), "id").select("q", F.col("x").alias("id"), F.lit(0).alias("rank"), "depth")
    above = seeds.join(up, "id").select("q", F.col("ancestor").alias("id"), F.lit(1).alias("rank"), "depth")
    side = above.join(up.select(F.col("id").alias("x"), F.col("ancestor").alias("id"), F.col("depth").alias("d")), "id").select("q", F.col("x").alias("id"), F.lit(2).alias("rank"), (F.col("depth") + F.col("d")).alias("depth"))
    near = kept(down.unionByName(above).unionByName(seeds.select("q", "id", F.lit(-1).alias("rank"), F.lit(0).alias("depth"))))
    every = near.unionByName(side.join(near.select("q", "id").distinct(), ["q", "id"], "left_anti"))
    best = every.groupBy("q", "id").agg(F.min(F.struct("depth", "rank")).alias("b")).filter("b.rank >= 0")
    return best.select("q", "id", F.element_at(F.array(F.lit("root"), F.lit("parent"), F.lit("sibling")), F.col("b.rank") + 1).alias("kind"), F.col("b.depth").alias("depth"))


def parse_rows(parses: DataFrame, root_cost: Column) -> DataFrame:
    """parses (word, stem, cost, steps: costs of its affixes) with sound: what is left of the cost after affixes and root."""
    spent = F.aggregate("steps", F.lit(0.0), lambda a, x: a + x)
    return parses.withColumn("sound", F.round(F.greatest(F.lit(0.0), F.col("cost") - spent - root_cost), 9))


def parse_chart(parses: DataFrame) -> DataFrame:
    """word, place, stem, cost, best: all analyses of each word, cheapest first, with the best of those whose stem is listed."""
    w = Window.partitionBy("word")
    best = F.min(F.when(F.col("listed"), F.col("cost"))).over(w)
    return parses.withColumn("best", best).withColumn("place", F.row_number().over(w.orderBy("cost", "stem"))).select("word", "place", "stem", "cost", "best")


def direct_children(edges: DataFrame, seeds: DataFrame, most: float) -> DataFrame:
    """word, root, cost: the words one edge (root, word, cost) from a seed (word), by the cheapest edge of at most that cost; seeds
    are left out."""
    hop = edges.join(seeds.select(F.col("word").alias("root")), "root").filter(F.col("cost") <= most + 1e-9)
    return hop.groupBy("word").agg(F.min(F.struct("cost", "root")).alias("b")).join(seeds, "word", "left_anti").select("word", "b.root", "b.cost")


def unlisted_roots(candidates: DataFrame, listed: DataFrame) -> DataFrame:
    """Candidates (word, stem, score) whose word and stem aren't listed (term): the cheapest of each word, ties all."""
    names = listed.select("term").distinct()
    free = candidates.join(names, F.col("stem") == F.col("term"), "left_anti").join(names, F.col("word") == F.col("term"), "left_anti")
    best = F.min("score").over(Window.partitionBy("word"))
    return free.withColumn("b", best).filter(F.col("score") <= F.col("b") + 1e-9).drop("b")


def edge_deltas(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """word_id, root_id, delta: edges as term numbers in order, each root less the one before it under the same word."""
    n = lambda c: numbers.select(F.col("term").alias(c), F.col("term_id").alias(f"{c}_id"))
    e = edges.select("word", "root").distinct().join(n("word"), "word").join(n("root"), "root")
    before = F.lag("root_id").over(Window.partitionBy("word_id").orderBy("root_id"))
    return e.select("word_id", "root_id", (F.col("root_id") - F.coalesce(before, F.lit(0))).alias("delta"))


def entry_terms(postings: DataFrame) -> DataFrame:
    """term, entry: whether any posting (term, kind) of it is more than a token."""
    return postings.groupBy("term").agg(F.bool_or(F.col("kind") != "token").alias("entry"))
