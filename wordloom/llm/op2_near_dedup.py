"""Near-duplicate classes by a containment ensemble over MinHash.

Two documents are linked if at least THRESHOLD of the smaller one's distinct five-word shingles are in the larger one, however
much larger that is; classes are the connected components. Equal sets are one node from the start. Two steps find the links:

The ensemble merges most of a class early, from pairs whose sizes are within RATIO. Documents are partitioned by the size of
their shingle set. For each partition the containment threshold becomes the least Jaccard similarity that such a pair can have
there, and bands are tuned to it apart from other partitions. A bucket is a star around its smallest id, never all pairs.

The rest is exact, for any sizes. Only shingles that two classes share can link these classes, so a node with too few of them
is no smaller side of a new link. One with s of them, of which a link takes t, shares one of its first s - t + 1 with the other
side, in whatever order; the rarest come first. These are looked up among the shared shingles of all nodes, first from one
node a shingle, then, once links have merged classes, from all that are still apart. Every pair of both steps is checked on
the shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, own_names, saved, small_batches
from .shingles import coefficients, mix, shingle_sets, signature

THRESHOLD, WIDTH, RATIO = 0.8, 5, 1.25
#: Values of a signature, and the least chance that a pair at the threshold meets in a bucket.
HASHES, RECALL = 114, 0.999
#: Shingles that a group of the exact step has on average, at most.
GROUP = 1 << 18


@lru_cache(maxsize=64)
def jaccard_floor(k: int) -> float:
    """The least Jaccard similarity of a linked pair within RATIO whose smaller set has 2^k to 2^(k+1)-1 shingles."""
    if k > 8:
        return THRESHOLD / (1 + RATIO - THRESHOLD)
    both = [(a, math.ceil(THRESHOLD * a - 1e-9)) for a in range(1 << k, 2 << k)]
    return min(c / (a + math.floor(RATIO * a) - c) for a, c in both)


@lru_cache(maxsize=64)
def banding(k: int) -> tuple[int, int]:
    """Bands and rows for partition k: the longest rows whose bands still fit into the signature and give RECALL."""
    for rows in (4, 3, 2, 1):
        bands = math.ceil(math.log(1 - RECALL) / math.log(max(1e-9, 1 - jaccard_floor(k) ** rows)))
        if bands * rows <= HASHES:
            return bands, rows
    return HASHES, 1


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, a and b (128 bits that stand for the shingle set), n (its size) and its signature."""
    coef = coefficients(HASHES)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        sets = shingle_sets(texts, WIDTH)
        blank = np.zeros(1, np.uint64)
        sig = signature([s if len(s) else blank for s in sets], *coef) if sets else np.empty((0, HASHES), np.uint32)
        # Without words, the text itself stands for the set.
        raw = [s.tobytes() if len(s) else b"=" + (t or "").encode() for s, t in zip(sets, texts)]
        key = np.array([np.frombuffer(hashlib.blake2b(x, digest_size=16).digest(), np.int64) for x in raw], np.int64).reshape(-1, 2)
        ids = batch.column(0).to_pylist()
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "a": key[:, 0], "b": key[:, 1], "n": pa.array(map(len, sets), pa.int64()), "sig": pa.array([r.tobytes() for r in sig], pa.binary())})

    return map_arrow(docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull()), run, "doc_id long, a long, b long, n long, sig binary")


def band_keys(nodes: DataFrame) -> DataFrame:
    """node, n, key: one row for each band of a node, for its own partition and the one below."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = batch.column(1).to_numpy()
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, HASHES).astype(np.uint64)
        part = np.floor(np.log2(sizes)).astype(int) if len(sizes) else sizes.astype(int)
        keys: list[list[int]] = [[] for _ in sizes]
        plan = {k: {r: max(b for b, q in (banding(k), banding(max(0, k - 1))) if q == r) for r in {banding(k)[1], banding(max(0, k - 1))[1]}} for k in set(part.tolist())}
        for k, by in plan.items():
            rows = np.flatnonzero(part == k)
            found = []
            for r, bands in by.items():
                v = sig[rows, : bands * r].reshape(len(rows), bands, r)
                h = mix(np.arange(bands, dtype=np.uint64) + np.uint64(1000 * r))[None, :] + np.zeros((len(rows), 1), np.uint64)
                for j in range(r):
                    h = mix(h + v[:, :, j])
                found.append(h)
            for i, x in zip(rows.tolist(), np.concatenate(found, 1).view(np.int64)):
                keys[i] = x
        return pa.RecordBatch.from_pydict({"node": batch.column(0), "n": batch.column(1), "keys": pa.array(keys, pa.list_(pa.int64()))})

    return map_arrow(nodes.select("node", "n", "sig"), run, "node long, n long, keys array<long>").select("node", "n", F.explode("keys").alias("key"))


def buckets(nodes: DataFrame) -> DataFrame:
    """key, w, node, n: the members of each bucket of two or more; w is the partition of the smaller side. Keys that one
    node has alone, nearly all, are gone after a count that is pre-aggregated; the join back has one row a key."""
    rows = band_keys(nodes)
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    k = F.floor(F.log2("n")).cast("int")
    return rows.join(shared, "key").select("key", "node", "n", F.explode(F.array(k, k - 1)).alias("w"))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, items: the shingle set of each wanted document; a document of several texts has a row for each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1).to_pylist(), WIDTH)
        ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        items = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
        return pa.RecordBatch.from_pydict({"node": batch.column(0), "items": pa.ListArray.from_arrays(ends, items)})

    text = docs.select(F.col("doc_id").alias("node"), "text").join(wanted.select("node"), "node", "left_semi")
    return map_arrow(text, run, "node long, items array<long>")


def contained(x: bytes, y: bytes) -> bool:
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    least = min(len(p), len(q))
    return least > 0 and len(np.intersect1d(p, q, assume_unique=True)) >= THRESHOLD * least - 1e-9


def common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) with their other columns, the items of x as p, those of y as q, and how many are in both. What
    goes along with a pair to the place of y is the set of x alone."""
    both = pairs.join(sets.select(F.col("node").alias("x"), F.col("items").alias("p")), "x").join(sets.select(F.col("node").alias("y"), F.col("items").alias("q")), "y")
    return both.withColumn("both", F.size(F.array_intersect("p", "q")))


def check_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) that are linked, by their whole sets."""
    least = F.least(F.size("p"), F.size("q"))
    return common(pairs.select("x", "y"), sets).filter((least > 0) & (F.col("both") >= THRESHOLD * least - 1e-9)).select("x", "y")


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of each connected component. In each round every label that touches a smaller one
    takes the smallest of these, and chains are shortened twice; each round is written, so lineage stays short."""
    ends = links.select("x", "y")
    label = saved(ends.union(links.select("y", "x")).toDF("node", "other").groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("label")))
    while True:
        e = ends.join(label.withColumnsRenamed({"node": "x", "label": "p"}), "x").join(label.withColumnsRenamed({"node": "y", "label": "q"}), "y").filter("p != q")
        hooks = saved(e.select(F.greatest("p", "q").alias("hi"), F.least("p", "q").alias("lo")).groupBy("hi").agg(F.min("lo").alias("lo")))
        if not hooks.take(1):
            return label
        for _ in range(2):
            label = label.join(hooks, F.col("label") == F.col("hi"), "left").select("node", F.coalesce("lo", "label").alias("label"))
        label = saved(label)


def sized(pairs: DataFrame) -> DataFrame:
    """Pairs that the bands are tuned to; the exact step has the others."""
    return pairs.filter(F.greatest("m", "n") <= RATIO * F.least("m", "n"))


def packed(x: np.ndarray, starts: list[int]) -> list[bytes]:
    """The numbers from each start to the next, in as few bytes as hold all of them."""
    return [run.astype(np.min_scalar_type(run.max())).tobytes() for run in np.split(x.view(np.uint64), starts[1:])]


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n}").astype(np.uint64)


def shingle_blocks(text: DataFrame, bits: int) -> DataFrame:
    """All shingles of node, label, text, in blocks: part is their upper bits, rest the lower 56 of each. Nodes ascend from n0 by
    the steps of node, nearly all of one byte; label is how far below its node a label is, nearly always 0."""

    def block(held: list[tuple]) -> pa.RecordBatch:
        held = sorted(held, key=lambda x: x[1])
        h, count = np.concatenate([x[0] for x in held]), [len(x[0]) for x in held]
        node, label = (np.repeat(np.array([x[j] for x in held], np.int64), count) for j in (1, 2))
        part = (h >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
        order = np.argsort(part, kind="stable")
        h, node, label, part = h[order], node[order], label[order], part[order]
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist()
        raw = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :7])
        step = np.diff(node, prepend=node[:1])
        step[starts] = 0
        return pa.RecordBatch.from_pydict({"part": pa.array(part[starts].astype(np.int32)), "rest": pa.array([x.tobytes() for x in np.split(raw, starts[1:])], pa.binary()), "n0": pa.array(node[starts]), "node": pa.array(packed(step, starts), pa.binary()), "label": pa.array(packed(node - label, starts), pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            sets = shingle_sets(batch.column(2).to_pylist(), WIDTH)
            held += [x for x in zip(sets, batch.column(0).to_pylist(), batch.column(1).to_pylist()) if len(x[0])]
            size += sum(map(len, sets))
            if size >= 1 << 19:
                yield block(held)
                held, size = [], 0
        if held:
            yield block(held)

    small_batches(text.sparkSession)
    return text.select("node", "label", "text").mapInArrow(run, "part int, rest binary, n0 long, node binary, label binary")


def shared_shingles(text: DataFrame, total: int) -> DataFrame:
    """v, node, label, c: the shingles v of each node that nodes of at least two labels have; c nodes have v."""
    bits = min(31, max(8, math.ceil(math.log2(max(1, total) / GROUP))))

    def run(blocks: pa.Table) -> pa.Table:
        rest = blocks["rest"].to_pylist()
        raw = np.zeros((sum(map(len, rest)) // 7, 8), np.uint8)
        raw[:, :7] = np.frombuffer(b"".join(rest), np.uint8).reshape(-1, 7)
        v = raw.view(np.uint64).ravel() | np.uint64((blocks["part"][0].as_py() << (64 - bits)) & ((1 << 64) - 1))
        at = []
        for first, steps, below, r in zip(*(blocks[k].to_pylist() for k in ("n0", "node", "label", "rest"))):
            ids = np.cumsum(unpacked(steps, len(r) // 7)).view(np.int64) + first
            at.append((ids, ids - unpacked(below, len(r) // 7).view(np.int64)))
        node, label = (np.concatenate(x) for x in zip(*at))
        order = np.argsort(v)
        v, node, label = v[order], node[order], label[order]
        # Most shingles have one node: only the others are put in order of their nodes, for rows that repeat a document.
        again = v[1:] == v[:-1]
        many = np.concatenate([again, [False]]) | np.concatenate([[False], again])
        v, node, label = v[many], node[many], label[many]
        order = np.lexsort((node, v))
        v, node, label = v[order], node[order], label[order]
        if len(v):
            once = np.concatenate([[True], (v[1:] != v[:-1]) | (node[1:] != node[:-1])])
            v, node, label = v[once], node[once], label[once]
            starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            count = np.diff(np.append(starts, len(v)))
            c = np.repeat(count, count)
            apart = np.repeat(np.minimum.reduceat(label, starts) < np.maximum.reduceat(label, starts), count)
            v, node, label, c = v[apart], node[apart], label[apart], c[apart]
        else:
            c = node
        return pa.table({"v": v.view(np.int64), "node": node, "label": label, "c": c.astype(np.int64)})

    return shingle_blocks(text, bits).groupBy("part").applyInArrow(run, "v long, node long, label long, c long")


def probes(shared: DataFrame, sizes: DataFrame) -> DataFrame:
    """v, x, m, need, probe: the shared shingles v of each node x, of m shingles, that can be the smaller side of a link, which
    takes `need` of them; of those with probe it needs one. These nodes are few and written, so that their size decides
    whether the shared shingles are shuffled for them."""
    need = F.ceil(THRESHOLD * F.col("m") - 1e-9)
    can = saved(shared.groupBy("node").agg(F.count("*").alias("s")).join(sizes, "node").filter(F.col("s") >= need).select("node", "m", need.alias("need"), (F.col("s") - need + 1).alias("reach")))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("c", "v"))
    return shared.join(can, "node").withColumn("rank", rank).select("v", F.col("node").alias("x"), "m", "need", (F.col("rank") <= F.col("reach")).alias("probe"))


def exact_links(docs: DataFrame, text: DataFrame, nodes: DataFrame, links: DataFrame, several: DataFrame | None) -> DataFrame:
    """x, y: links that join the classes of links into the whole ones. What two nodes of different classes have in common is
    in the shared shingles, and in those of the smaller one: only these are counted, and no text is read again."""
    sizes = nodes.groupBy("node").agg(F.min("n").alias("m"), F.max("n").alias("k"))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    shared = saved(shared_shingles(text, total))
    own = saved(probes(shared, sizes.select("node", "m")))
    probe = own.filter("probe").select("v", "x", "m", "need")
    wanted = own.groupBy("v").agg(F.max("probe").alias("probe"))
    near = saved(shared.select("v", F.col("node").alias("y"), F.col("label").alias("q")).join(wanted, "v"))
    sets = saved(near.groupBy(F.col("y").alias("node")).agg(F.collect_list("v").alias("items")))
    at = saved(near.filter("probe").select("v", "y", "q"))
    large = sizes.select(F.col("node").alias("y"), "k")

    def fitting(one: DataFrame, other: DataFrame) -> DataFrame:
        """Pairs of one's x and other's y that have a shingle in common and are in different classes."""
        pairs = one.join(other, "v").filter("p != q").select("x", "m", "need", "y").distinct()
        return pairs.join(large, "y").filter("k >= m").select("x", "y", "need")

    def linked(pairs: DataFrame) -> DataFrame:
        found = common(pairs, sets).filter("both >= need").select("x", "y")
        if several is None:
            return found
        # The sets of a document of several texts have been counted as one, so its pairs are looked at again text by text.
        found = saved(found)
        doubt = saved(found.join(several.toDF("x"), "x", "left_semi").unionByName(found.join(several.toDF("y"), "y", "left_semi")).distinct())
        ends = saved(doubt.select(F.explode(F.array("x", "y")).alias("node")).distinct())
        return found.join(doubt, ["x", "y"], "left_anti").unionByName(check_pairs(doubt, sets_of(docs, ends)))

    # First from one node a shingle, which joins most of what shares it; then from all, where classes are still apart.
    hub = probe.groupBy("v").agg(F.min(F.struct("m", "x", "need")).alias("h")).select("v", "h.m", "h.x", "h.need")
    p = at.select("v", F.col("y").alias("x"), F.col("q").alias("p"))
    tested = saved(fitting(hub.join(p, ["v", "x"]), at))
    first = saved(linked(tested))
    label = components(links.unionByName(first)).withColumnsRenamed({"node": "y", "label": "r"})
    now = at.join(label, "y", "left").select("v", "y", F.coalesce("r", "y").alias("q"))
    split = now.groupBy("v").agg(F.min("q").alias("lo"), F.max("q").alias("hi")).filter("lo < hi").select("v")
    left = saved(now.join(split, "v", "left_semi"))
    p = left.select("v", F.col("y").alias("x"), F.col("q").alias("p"))
    rest = saved(fitting(probe.join(p, ["v", "x"]), left).join(tested, ["x", "y"], "left_anti"))
    return saved(first.unionByName(linked(rest)))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class) and n_shingles of every row.

    Words are runs of letters and digits with A-Z lowered; a text of fewer than five words is one shingle; texts without
    words (null as empty) have 0 shingles and share a class only if they are equal, and a null doc_id has a null class. Rows that repeat a doc_id are one
    document, so they share a class whatever their texts, with all that any of these is near to. An empty table gives no rows; other columns aren't read.
    Signatures, buckets, sets and links go through the shared folder; the driver sees none of them."""
    prints = saved(fingerprints(docs))
    nodes = saved(prints.groupBy("a", "b").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    members = saved(buckets(nodes.filter("n > 0")))
    hubs = members.groupBy("key", "w").agg(F.min(F.struct("node", "n")).alias("h"), F.count("*").alias("c")).filter("c > 1").select("key", "w", F.col("h.node").alias("x"), F.col("h.n").alias("m"))
    star = sized(members.join(hubs, ["key", "w"]).filter("node != x")).groupBy("x", F.col("node").alias("y")).agg(F.count("*").alias("c"))
    # Each node with the hub it meets most often, which joins most of a class at once.
    best = saved(star.groupBy("y").agg(F.max(F.struct("c", (-F.col("x")).alias("x"))).alias("s")).select((-F.col("s.x")).alias("x"), "y"))
    ends = saved(best.select(F.explode(F.array("x", "y")).alias("node")).distinct())
    links = check_pairs(best, saved(sets_of(docs, ends)))
    # Documents of several different texts tie the nodes of these.
    several = saved(prints.select("doc_id", "a", "b").distinct().groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if several.take(1):
        of = prints.join(several, "doc_id", "left_semi").join(nodes.select("a", "b", "node"), ["a", "b"]).groupBy("doc_id").agg(F.collect_set("node").alias("all"))
        links = links.unionByName(of.select(F.array_min("all").alias("x"), F.explode("all").alias("y")).filter("x != y").distinct())
    else:
        several = None
    links = saved(links)
    label = components(links)
    # Documents that are no node, and nodes that have another label; the text of the former isn't read again.
    known = nodes.filter("n > 0").select("node").distinct().join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    other = saved(prints.select("doc_id").distinct().join(known, F.col("doc_id") == F.col("node"), "left").filter("node is null or label != node").select(F.col("doc_id").alias("d"), "label"))
    text = docs.select("doc_id", "text").filter("doc_id is not null").join(other, F.col("doc_id") == F.col("d"), "left").filter("d is null or label is not null").select(F.col("doc_id").alias("node"), F.coalesce("label", "doc_id").alias("label"), "text")
    more = exact_links(docs, text, nodes.filter("n > 0").select("node", "n"), links, several)
    if more.take(1):
        label = components(links.unionByName(more))
    of_set = nodes.join(label, "node", "left").select("a", "b", F.coalesce("label", "node").alias("c"))
    found = prints.join(of_set, ["a", "b"]).groupBy("doc_id").agg(F.min("c").alias("class_id"), F.max("n").alias("n_shingles"))
    out = docs.select(F.col("doc_id").alias("d")).join(found, F.col("d") == F.col("doc_id"), "left")
    return out.select(F.col("d").alias("doc_id"), F.coalesce("class_id", "d").alias("class_id"), F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those whose class has a smaller doc_id; columns stay. Rows with a null doc_id stay."""
    name = f"{own_names(docs)}did"
    gone = classes(docs).filter("doc_id > class_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def brute_force(docs: list[tuple]) -> dict:
    """Class by doc_id, comparing all pairs; for tests."""
    sets = dict(zip([d for d, _ in docs], shingle_sets([t for _, t in docs], WIDTH)))
    text = {d: t or "" for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in sets:
        for y in sets:
            if x < y and (contained(sets[x].tobytes(), sets[y].tobytes()) or not len(sets[x]) + len(sets[y]) and text[x] == text[y]) and (p := find(x)) != (q := find(y)):
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in sets}

