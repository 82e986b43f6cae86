"""Benchmark decontamination with suffix arrays of the training text.

The training documents fall into shards, each built in one task's memory. A shard's suffix array holds every word position
of its documents in the order of the words that follow; it is built by prefix doubling over word numbers. The suffixes of
the test items are looked up in it by binary search. The items have a suffix array too, so for each place in a document the
item suffixes that are its neighbours in the common order share its longest verbatim match, and the places are read off.

A word that no item has can't be in a match, so all such words are one symbol (0) that equals nothing, and order matters only
up to the longest item. Items are sent to the tasks in blocks of bounded size, one pass over the documents a block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, lower_ascii, own_names, saved, small_batches

#: Words of a window, items that a document needs to be reported as contaminated, and items for which it is removed.
WINDOW, MIN_ITEMS, REMOVE_ITEMS = 8, 2, 1
#: Words of a shard, and bytes of item text that are sent to the tasks at once.
SHARD_WORDS, BLOCK_BYTES = 1_000_000, 8 << 20
_WORD = re.compile(WORD)


def words(text: str | None) -> list[str]:
    return _WORD.findall(lower_ascii(text)) if text else []


class SuffixArray:
    """The positions of all words but 0 in `ids`, in the order of what follows, up to `depth` words or the next 0."""

    def __init__(self, ids: np.ndarray, depth: int, top: int):
        """top: the largest word number that ids may hold."""
        n = len(ids)
        self.bits = max(1, int(top).bit_length())
        self.packed = max(1, min(62 // self.bits, depth))
        #: Zeros stand behind the last word, so that reading ahead needs no test.
        self.ids = np.concatenate([ids, np.zeros(16, ids.dtype)])
        self.zero = np.flatnonzero(self.ids == 0)
        at = np.flatnonzero(ids)
        key, live = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for j in range(self.packed):
            word = self.ids[np.minimum(at + j, n)]
            live &= word != 0
            key = (key << self.bits) | np.where(live, word, 0)
        order = np.argsort(key)
        self.at, self.keys = at[order], key[order]
        fresh = np.concatenate([[True], self.keys[1:] != self.keys[:-1]]) if len(at) else np.empty(0, bool)
        ahead, rank = self.packed, np.zeros(n + 1, np.int64)
        until = self.zero[np.searchsorted(self.zero, np.arange(n))] - np.arange(n) if n else np.empty(0, np.int64)
        while ahead < depth and len(at):
            rank[self.at] = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0)) + 1
            alone = fresh & np.concatenate([fresh[1:], [True]])
            rows = np.flatnonzero(~alone & (until[self.at] >= ahead))
            # Those that end before `ahead` words are equal to the end; they stay first in their group.
            rows = rows[np.argsort(rank[self.at[rows]], kind="stable")]
            if not len(rows):
                break
            p = self.at[rows]
            both = (rank[p] << 32) | rank[np.minimum(p + ahead, n)]
            by = np.argsort(both)
            self.at[rows], both = p[by], both[by]
            fresh[rows[1:]] |= both[1:] != both[:-1]
            fresh[rows[0]] = True
            ahead *= 2

    def common(self, p: np.ndarray, other: "SuffixArray", q: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """For pairs of places: how many words are equal, at most limit."""
        out, live = np.zeros(len(p), np.int64), np.flatnonzero(limit > 0)
        while len(live):
            done = out[live][:, None] + np.arange(8)
            a = self.ids[np.minimum(p[live][:, None] + done, len(self.ids) - 1)]
            b = other.ids[np.minimum(q[live][:, None] + done, len(other.ids) - 1)]
            same = np.logical_and.accumulate((a == b) & (a != 0) & (done < limit[live][:, None]), 1).sum(1)
            out[live] += same
            live = live[same == 8]
        return out

    def below(self, other: "SuffixArray", q: np.ndarray, limit: np.ndarray, lo: np.ndarray, hi: np.ndarray, equal: bool) -> np.ndarray:
        """For each place q of other: how many suffixes here come before its first `limit` words, those that begin with them
        included if `equal`. Binary search between lo and hi, all places at once."""
        lo, hi = lo.copy(), hi.copy()
        while len(live := np.flatnonzero(lo < hi)):
            mid = (lo[live] + hi[live]) // 2
            p, x, most = self.at[mid], q[live], limit[live]
            n = self.common(p, other, x, most)
            less = np.where(n == most, equal, self.ids[np.minimum(p + n, len(self.ids) - 1)] < other.ids[x + np.minimum(n, most - 1)])
            lo[live], hi[live] = np.where(less, mid + 1, lo[live]), np.where(less, hi[live], mid)
        return lo

    def start(self, other: "SuffixArray", q: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds for the search of each place, by the words that are packed into a number."""
        low, high, live = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.ones(len(q), bool)
        for j in range(self.packed):
            live &= j < limit
            word = np.where(live, other.ids[np.minimum(q + j, len(other.ids) - 1)], 0)
            low, high = (low << self.bits) | word, (high << self.bits) | np.where(live, word, (1 << self.bits) - 1)
        return np.searchsorted(self.keys, low, "left"), np.searchsorted(self.keys, high, "right")


class Items:
    """Test items as word numbers from 1, an array of all with a 0 after each. An item's windows are its runs of `window`
    words, or, if it has fewer, all of it."""

    def __init__(self, window: int):
        self.window, self.number, self.owner, self.ids = window, {}, [], []

    def add(self, item, text: str | None) -> None:
        if found := words(text):
            number = self.number
            self.owner.append(item)
            self.ids.append(np.array([number.setdefault(w, len(number) + 1) for w in found], np.int32))

    def freeze(self) -> "Items":
        """Builds the item suffix array and the groups of equal windows."""
        sizes = np.array([len(x) for x in self.ids], np.int64)
        self.flat = np.concatenate([np.append(x, 0) for x in self.ids]).astype(np.int64) if self.ids else np.empty(0, np.int64)
        self.array = SuffixArray(self.flat, int(sizes.max(initial=1)), len(self.number))
        at = self.array.at
        ends = np.cumsum(sizes + 1)
        item = np.searchsorted(ends, at, "right")
        self.starts = ends - sizes - 1
        self.left = (ends[item] - 1 - at) if len(at) else at  # words from here to the item's end
        need = np.minimum(self.window, sizes[item]) if len(at) else at
        ok = self.left >= need
        self.rows, self.item, self.need = np.flatnonzero(ok), item[ok], need[ok]
        # Windows are equal if they have the same words; neighbours in the array tell. Short items are windows of their own length.
        r = self.rows
        same = self.array.common(at[r[1:]], self.array, at[r[:-1]], self.need[1:]) if len(r) else r
        fresh = np.concatenate([[True], (same < self.need[1:]) | (self.need[1:] != self.need[:-1])]) if len(r) else np.empty(0, bool)
        self.group = np.cumsum(fresh) - 1
        self.first = np.flatnonzero(fresh)
        return self

    def owners(self, group: int) -> list:
        a = self.first[group]
        b = self.first[group + 1] if group + 1 < len(self.first) else len(self.rows)
        return [self.owner[k] for k in self.item[a:b].tolist()]


def matches(ids: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All places of a shard where a window of an item begins, with the window's group: (place, group); and for each
    distinct place its longest verbatim match: (length, item position)."""
    none = np.empty(0, np.int64)
    if not len(items.rows) or not ids.any():
        return none, none, none, none
    its = items.array
    shard = SuffixArray(ids, int(items.left.max()), len(items.number))
    q, need = its.at[items.rows[items.first]], items.need[items.first]
    lo, hi = shard.start(its, q, need)
    open_ = np.flatnonzero(lo < hi)
    lo[open_], hi[open_] = shard.below(its, q[open_], need[open_], lo[open_], hi[open_], False), shard.below(its, q[open_], need[open_], lo[open_], hi[open_], True)
    size = np.maximum(hi - lo, 0)
    hit = np.flatnonzero(size)
    if not len(hit):
        return none, none, none, none
    lo, size = lo[hit], size[hit]
    rows = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    group = np.repeat(hit, size)
    # The longest match of each place: that with one of the two item suffixes it lies between in the common order.
    seen = np.unique(rows)
    place = shard.at[seen]
    mine = np.flatnonzero(np.isin(items.group, hit))
    of, left = its.at[items.rows[mine]], items.left[items.rows[mine]]
    a, b = shard.start(its, of, left)
    into = np.maximum.accumulate(shard.below(its, of, left, a, b, False))
    after = np.searchsorted(into, seen, "right")
    best, source = np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64)
    for k in (after - 1, after):
        ok = np.flatnonzero((k >= 0) & (k < len(mine)))
        n = shard.common(place[ok], its, of[k[ok]], left[k[ok]])
        n[n < items.need[mine[k[ok]]]] = 0
        better = n > best[ok]
        best[ok[better]], source[ok[better]] = n[better], of[k[ok[better]]]
    # Short items lie apart from longer ones in that order, and match whole or not at all.
    w = np.searchsorted(seen, rows)
    alt = items.need[items.first[group]]
    order = np.lexsort((-group, alt))
    top, from_ = np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64)
    top[w[order]], from_[w[order]] = alt[order], its.at[items.rows[items.first[group[order]]]]
    short = top > best
    best[short], source[short] = top[short], from_[short]
    by = np.argsort(place)
    return shard.at[rows], group, place[by], np.stack([best[by], source[by]])


def flatten(ids: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(ids) if ids else np.empty(0, np.int64)


def maximal(place: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """Which of the sorted places begin a match that doesn't lie within the one before it."""
    if not len(place):
        return np.empty(0, bool)
    end = place + longest[0]
    reach = np.maximum.accumulate(end)
    return np.concatenate([[True], end[1:] > reach[:-1]])


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list]:
    """The items in blocks of about block_bytes of text; only one block is in the driver at a time."""
    b = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        yield (b if n == 1 else b.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).collect()


SPANS = "array<struct<item_id:long,item_word:long,word:long,length:long>>"


def scan(docs: DataFrame, items: Items, narrow: bool = False) -> DataFrame:
    """doc_id, n_words, hits (n_hit or, for several blocks, the hit places), the found items and the spans of every row."""
    sc = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    sent = sc.broadcast(items.freeze())
    kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("item_id", "item_word", "word", "length")]))

    def flush(ids: list, keys: list, sizes: list[int]) -> pa.RecordBatch:
        items: Items = sent.value
        flat = flatten(ids)
        at, group, place, longest = matches(flat, items)
        ends = np.cumsum(np.array(sizes, np.int64) + 1)
        starts = ends - np.array(sizes, np.int64) - 1
        edge = np.zeros(len(flat) + 1, np.int64)
        if len(place):
            np.add.at(edge, place, 1)
            np.add.at(edge, place + longest[0], -1)
        hit = np.cumsum(edge[:-1]) > 0
        sums = np.concatenate([[0], np.cumsum(hit)])
        items_of: dict[int, set] = {}
        if len(at):
            for d, g in np.unique(np.stack([np.searchsorted(ends, at, "right"), group], 1), axis=0).tolist():
                items_of.setdefault(d, set()).update(items.owners(g))
        spans: list[list[dict]] = [[] for _ in keys]
        if len(place):
            keep = maximal(place, longest)
            for p, n, q in zip(place[keep].tolist(), longest[0][keep].tolist(), longest[1][keep].tolist()):
                d, k = int(np.searchsorted(ends, p, "right")), int(np.searchsorted(items.starts, q, "right")) - 1
                spans[d].append({"item_id": items.owner[k], "item_word": q - int(items.starts[k]), "word": p - int(starts[d]), "length": n})
        out = {"doc_id": pa.array(keys, pa.int64()), "n_words": pa.array(sizes, pa.int64()), "found": pa.array([sorted(items_of.get(d, ()), key=str) for d in range(len(keys))], pa.list_(pa.int64())), "spans": pa.array(spans, kind)}
        if narrow:
            out["n_hit"] = pa.array(sums[ends] - sums[starts], pa.int64())
        else:
            out["places"] = pa.array([np.flatnonzero(hit[a:b]) for a, b in zip(starts, ends)], pa.list_(pa.int64()))
        return pa.RecordBatch.from_pydict(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.number.get
        ids, keys, sizes, total = [], [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(text)
                ids.append(np.fromiter(chain(map(get, found, repeat(0)), (0,)), np.int64, len(found) + 1))
                keys.append(key)
                sizes.append(len(found))
                total += len(found)
                if total >= SHARD_WORDS:
                    yield flush(ids, keys, sizes)
                    ids, keys, sizes, total = [], [], [], 0
        if keys:
            yield flush(ids, keys, sizes)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_words long, found array<long>, spans {SPANS}, " + ("n_hit long" if narrow else "places array<long>"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs, with the words of its longest
    verbatim match (0 if none), found (the item ids) and spans: the longest matches, each with an item that has it, the word
    it begins at there and in the document, and its words. A match that lies within another one of its document isn't
    among the spans (of those of one block of items).

    Words are taken from text with A-Z lowered. Items of fewer than `window` words are one window; null, empty or wordless
    items have none, and a null document has no words. Equal items are found together, each under its id; items with the
    same id count once. Repeated rows are reported one by one; an empty benchmark hits nothing; an empty table gives no
    rows. A benchmark beyond block_bytes is taken in blocks, each a pass over the documents, whose hit places are
    united by row."""

    def make(rows: list) -> Items:
        out = Items(window)
        for r in rows:
            out.add(r.item_id, r.text)
        return out

    blocks = item_blocks(benchmark, block_bytes)
    first = make(next(blocks, []))
    second = next(blocks, None)
    if second is None:
        out = scan(docs, first, narrow=True)
    else:
        # Rows get a number of their own, so that repeated ids stay apart; it is written, so it can't change.
        numbered = saved(docs.select(F.monotonically_increasing_id().alias("doc_id"), F.col("doc_id").alias("own"), "text"))
        some = [saved(scan(numbered, first)), saved(scan(numbered, make(second))), *(saved(scan(numbered, make(b))) for b in blocks)]
        every = some[0]
        for x in some[1:]:
            every = every.unionByName(x)
        every = every.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.collect_list("found").alias("f"), F.collect_list("places").alias("p"), F.flatten(F.collect_list("spans")).alias("spans"))
        every = every.join(numbered.select("doc_id", "own"), "doc_id").select(F.col("own").alias("doc_id"), "n_words", F.array_distinct(F.flatten("f")).alias("found"), "spans", F.size(F.array_distinct(F.flatten("p"))).cast("long").alias("n_hit"))
        out = every
    names = F.array_join(F.array_sort(F.transform("found", lambda x: x.cast("string"))), ",")
    n = F.size("found").cast("long")
    return out.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.encode(names, "UTF-8"), 256).alias("items_sha256"), (n >= min_items).alias("contaminated"), F.coalesce(F.array_max(F.transform("spans", lambda x: x["length"])), F.lit(0)).alias("longest_match"), "found", "spans")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, min_items: int = REMOVE_ITEMS) -> DataFrame:
    """The documents without those in which at least min_items items have a window: one is enough, whatever the report
    calls contaminated. Columns stay, and clashing names do no harm. Rows that repeat a doc_id go together, if one of them
    is hit. A row whose doc_id is null stays, since it can't be named. Null, empty and wordless texts stay. An empty
    benchmark removes nothing; an empty table stays empty."""
    name = f"{own_names(docs)}did"
    bad = contamination(docs.select("doc_id", "text"), benchmark).filter(F.col("n_items") >= min_items).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col("doc_id") == F.col(name), "left_anti")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).drop("found", "spans")


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW, min_items: int = MIN_ITEMS) -> list[tuple]:
    """The same rows, by comparing every window with every place; for tests."""
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for item, other in items:
            x = words(other)
            n = min(window, len(x))
            for i in range(len(x) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p] == x[i] and w[p : p + n] == x[i : i + n]:
                        hit.update(range(p, p + n))
                        found.add(item)
        names = ",".join(sorted(map(str, found)))
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(found) >= min_items))
    return out
