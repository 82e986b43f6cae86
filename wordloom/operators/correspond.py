"""Correspondences between varieties: segments, context costs, classes, retrieval, and a greedy learner."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rounds import kept


def validate(model: dict) -> list[str]:
    """What is wrong with a model: dialects, segments, patterns (reflexes by dialect, sites, position), occurrences."""
    out = []
    dialects = model.get("dialects") or []
    if len(set(dialects)) != len(dialects) or len(dialects) < 2:
        out.append("dialects: two different ones at least")
    for k, p in enumerate(model.get("patterns") or []):
        r = p.get("reflexes") or {}
        if unknown := sorted(set(r) - set(dialects)):
            out.append(f"patterns[{k}]: unknown dialects {', '.join(unknown)}")
        if len(r) < 2 or all(x in ("", "-") for x in r.values()):
            out.append(f"patterns[{k}]: needs two reflexes and not only gaps")
        if not isinstance(p.get("sites"), int) or p["sites"] < 1:
            out.append(f"patterns[{k}]: sites")
        if p.get("position") not in (None, "initial", "final"):
            out.append(f"patterns[{k}]: position")
    return out


def segments(c: Column, inventory: list[str]) -> Column:
    """A text as segments, at each place the longest of the inventory that stands there, else one character."""
    forms = sorted({x for x in inventory if x}, key=lambda x: (-len(x), x))
    quoted = "|".join(re.escape(x) for x in forms)
    return F.regexp_extract_all(c, F.lit(f"({quoted}|.)" if forms else "(.)"), F.lit(1))


def context_table(sites: DataFrame, least: int) -> DataFrame:
    """a, b, s, w, position, cost: minus log of how many of the `of` places of s in a are sites of w in b, for `least` sites or more."""
    share = F.least(F.lit(1.0), F.col("sites") / F.greatest("of", "sites"))
    return sites.filter(F.col("sites") >= least).select("a", "b", "s", "w", "position", F.round(-F.log(share), 9).alias("cost"))


def sound_classes(table: DataFrame, p: float) -> DataFrame:
    """segment, class (its smallest member): segments joined wherever one costs at most -log p as the other. Each round every
    segment takes the least class among its neighbours, until none changes."""
    s = table.filter("s <> '' AND w <> ''")
    near = s.filter(F.col("cost") <= -math.log(p) + 1e-9).select("s", "w")
    edges = kept(near.union(near.select("w", "s")).distinct())
    label = kept(s.select(F.col("s").alias("segment")).union(s.select("w")).distinct().withColumn("class", F.col("segment")))
    while True:
        least = edges.join(label.withColumnsRenamed({"segment": "w", "class": "c"}), "w").groupBy(F.col("s").alias("segment")).agg(F.min("c").alias("c"))
        new = kept(label.join(least, "segment", "left").select("segment", F.least("class", F.coalesce("c", "class")).alias("class")))
        if not new.join(label.withColumnRenamed("class", "old"), "segment").filter("class <> old").take(1):
            return new
        label = new


def adjacency(words: DataFrame) -> DataFrame:
    """a, b, n: how often two different letters stand side by side, in both orders. words: letters."""
    each = F.transform(F.sequence(F.lit(1), F.size("letters") - 1), lambda i: F.struct(F.element_at("letters", i).alias("a"), F.element_at("letters", i + 1).alias("b")))
    pairs = words.withColumn("letters", F.filter("letters", lambda x: x != "")).filter(F.size("letters") >= 2).select(F.explode(each).alias("p")).select("p.a", "p.b").filter("a <> b")
    one = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    return one.union(one.select("b", "a", "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))


def vowels(neighbours: DataFrame) -> list[str]:
    """Letters taken for vowels, in the order they are found: the letter with most neighbours left, as long as that is more than none; then each
    neighbour loses twice what it shares with it. The matrix is of the alphabet's size."""
    m: dict[str, dict[str, int]] = {}
    for r in neighbours.collect():
        m.setdefault(r.a, {})[r.b] = r.n
    left = {a: sum(row.values()) for a, row in m.items()}
    out: list[str] = []
    while True:
        best = min((a for a in left if a not in out and left[a] > 0), key=lambda a: (-left[a], a), default=None)
        if best is None:
            return out
        out.append(best)
        for b, n in m[best].items():
            if b not in out:
                left[b] -= 2 * n


def as_dict(table: DataFrame) -> dict[tuple[str, str], float]:
    """A cost table of two dialects; of the alphabets' size."""
    return {(r.s, r.w): r.cost for r in table.select("s", "w", "cost").collect()}


def aligned(x: str, y: str, costs: dict[tuple[str, str], float], typo: float = 4.0, longest: int = 1, bound: float = math.inf) -> float:
    """Least cost of y for x: any run of up to `longest` characters of either side may stand for one of the other at its cost, a
    character for another or for nothing at typo. Infinite beyond bound."""
    d = [[math.inf] * (len(y) + 1) for _ in range(len(x) + 1)]
    d[0][0] = 0.0
    for i in range(len(x) + 1):
        for j in range(len(y) + 1):
            here = d[i][j]
            if here > bound:
                continue
            if i < len(x) and j < len(y):
                d[i + 1][j + 1] = min(d[i + 1][j + 1], here + (0.0 if x[i] == y[j] and (x[i], y[j]) not in costs else typo))
            if i < len(x):
                d[i + 1][j] = min(d[i + 1][j], here + typo)
            if j < len(y):
                d[i][j + 1] = min(d[i][j + 1], here + typo)
            for m in range(longest + 1):
                for n in range(longest + 1):
                    if m + n and i + m <= len(x) and j + n <= len(y) and (c := costs.get((x[i : i + m], y[j : j + n]))) is not None:
                        d[i + m][j + n] = min(d[i + m][j + n], here + c)
    out = d[-1][-1]
    return out if out <= bound else math.inf


def retrieved(pairs: DataFrame, costs: dict[tuple[str, str], float], most: float, typo: float = 4.0) -> DataFrame:
    """x, y, score, exact: the pairs within `most`, by aligned cost."""
    longest = max((len(s) for pair in costs for s in pair), default=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            score = [round(aligned(x, y, costs, typo, longest, most), 9) for x, y in zip(b["x"], b["y"])]
            out = b.assign(score=score, exact=b["x"] == b["y"])
            yield out[out["score"] <= most]

    return pairs.select("x", "y").mapInPandas(run, "x string, y string, score double, exact boolean")


def candidates(pairs: DataFrame, columns: int) -> DataFrame:
    """s, w, sites, left, right: runs of up to `columns` letters at the same place of pairs (x, y) of one length, with how often and in how
    many different words of either side."""
    ks = F.sequence(F.lit(1), F.lit(columns))
    runs = F.flatten(F.transform(ks, lambda k: F.transform(F.filter(F.sequence(F.lit(1), F.length("x")), lambda i: i + k - 1 <= F.length("x")), lambda i: F.struct(F.substring(F.col("x"), i, k).alias("s"), F.substring(F.col("y"), i, k).alias("w")))))
    each = pairs.select("x", "y", F.explode(runs).alias("r")).select("x", "y", "r.s", "r.w").filter("s <> w")
    return each.groupBy("s", "w").agg(F.count("*").alias("sites"), F.count_distinct("x").alias("left"), F.count_distinct("y").alias("right"))


def learned(pairs: DataFrame, spark: SparkSession, columns: int = 2, support: int = 2, penalty: float = 16.0, sites: int = 2) -> DataFrame:
    """s, w, sites, gain: the correspondences that a greedy learner takes, in its order.

    Counts of letters and candidate runs are made in Spark; what reaches the driver are tables of the alphabet's size to the
    power `columns`. A candidate gains what its letters cost one by one, less what it costs itself and a penalty for being
    listed; the strictly best is taken, and what it covers counts no more, until none gains."""
    free = kept(pairs.filter(F.length("x") == F.length("y")))
    table = [r.asDict() for r in candidates(free, columns).filter((F.least("left", "right") >= support) & (F.col("sites") >= sites)).collect()]
    letters = {(r.s, r.w): r.n for r in free.select(F.explode(F.arrays_zip(F.split("x", "").alias("s"), F.split("y", "").alias("w"))).alias("c")).select("c.s", "c.w").filter("s <> ''").groupBy("s", "w").agg(F.count("*").alias("n")).collect()}
    total: dict[str, int] = {}
    for (s, _), n in letters.items():
        total[s] = total.get(s, 0) + n
    cost = {k: -math.log(n / total[k[0]]) for k, n in letters.items()}
    left = {(c["s"], c["w"]): c["sites"] for c in table}
    # What a candidate saves at a place, and of its places those that are free by source.
    saves = {k: sum(cost[p] for p in zip(*k)) for k in left}
    of: dict[str, int] = {}
    for (s, _), n in left.items():
        of[s] = of.get(s, 0) + n

    def gain(k: tuple[str, str]) -> float:
        n = max(left[k], 1)
        return left[k] * (saves[k] + math.log(n / max(of[k[0]], n))) - penalty

    out = []
    while left:
        best = min(left, key=lambda k: (-gain(k), k))
        if (g := gain(best)) <= 0:
            break
        n = left.pop(best)
        of[best[0]] -= n
        out.append((best[0], best[1], n, round(g, 9)))
        # Places of runs inside or around the one taken are no longer free.
        for k in [k for k in left if best[0] in k[0] and best[1] in k[1] or k[0] in best[0] and k[1] in best[1]]:
            less = min(left[k], n)
            left[k] -= less
            of[k[0]] -= less
            if left[k] < sites:
                of[k[0]] -= left.pop(k)
    return spark.createDataFrame(out, "s string, w string, sites long, gain double")
