"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of each distinct word. A sequence of tokens is what byte-pair merging gives if
and only if every adjacent pair of it is: merging the two tokens' text gives these two again. So all pairs of all new words
are tested at once in numpy, and only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pieces
from .common import map_arrow

CACHE = 400_000


def byte_letters() -> list[str]:
    """The printable character for each byte, as byte-level tokenizers number them."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(other)) for b in range(256)]


class Codec:
    """Encodes with a tokenizer file whose words end in a marked symbol; anything outside what is proven equal (see
    pieces) goes through the tokenizers library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        model = spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.end = model.get("end_of_word_suffix") or ""
        self.id: dict[str, int] = model["vocab"]
        size = max([*self.id.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.token = [""] * size
        for k, v in self.id.items():
            self.token[v] = k
        for t in spec["added_tokens"]:
            self.token[t["id"]] = t["content"]
        self.size = size
        self.letters = str.maketrans({chr(i): c for i, c in enumerate(byte_letters())})
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        odd = set()  # tokens that two merges make
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y, z = self.id[a], self.id[b], self.id[a + b]
            self.merge.setdefault((x, y), (r, z))
            if self.rank[z] >= 0:
                odd.add(z)
                continue
            self.rank[z], self.left[z], self.right[z] = r, x, y
        keys = np.array([x * size + y for x, y in self.merge], np.int64)
        order = np.argsort(keys)
        self.keys, self.times = keys[order], np.array([r for r, _ in self.merge.values()], np.int64)[order]
        # A token may be proposed if merging its own text gives it; that is its halves' own test, up to its merge.
        usable = np.ones(size, bool)
        made = np.flatnonzero(self.rank >= 0)
        usable[made] = self.compatible(self.left[made], self.right[made], 2 * self.rank[made])
        usable[list(odd)] = False
        for t in made[np.argsort(self.rank[made])].tolist():
            usable[t] &= usable[self.left[t]] and usable[self.right[t]]
        self.propose = {s: t for s, t in self.id.items() if usable[t]}
        self.longest = max(map(len, self.propose), default=1)
        self.known: dict[int, bool] = {}
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.quick = kinds == ["NFC", "Replace", "Lowercase"] and spec.get("decoder") is None and spec.get("post_processor") is None and bool(self.end)

    def merge_time(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Twice the rank of the merge of each pair; a large number where there is none."""
        key = x * self.size + y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, 2 * self.times[at], np.iinfo(np.int64).max)

    def compatible(self, x: np.ndarray, y: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the text of tokens x and y keeps the border between them (up to a time). Unwinds both tokens
        backwards from the border, always the half made last; the two symbols at the border stood side by side until
        `limit`, so a merge of theirs before that would have crossed it. Of equal merges the left one comes first, which
        is why times are twice the rank and one more on the right."""
        x, y = x.astype(np.int64).copy(), y.astype(np.int64).copy()
        limit = np.full(len(x), np.iinfo(np.int64).max) if until is None else until.astype(np.int64).copy()
        good, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            a, b = x[live], y[live]
            crossed = self.merge_time(a, b) < limit[live]
            good[live[crossed]] = False
            live, a, b = live[~crossed], a[~crossed], b[~crossed]
            ta = np.where(self.rank[a] >= 0, 2 * self.rank[a], -1)
            tb = np.where(self.rank[b] >= 0, 2 * self.rank[b] + 1, -1)
            on = np.maximum(ta, tb) >= 0
            live, a, b, ta, tb = live[on], a[on], b[on], ta[on], tb[on]
            lefts = ta > tb
            limit[live] = np.minimum(limit[live], np.where(lefts, ta, tb))
            x[live] = np.where(lefts, self.right[a], a)
            y[live] = np.where(lefts, b, self.left[b])
        return good

    def symbols(self, word: str) -> list[str]:
        return [*word[:-1], word[-1] + self.end]

    def exact(self, word: str) -> list[int]:
        """Byte-pair merging itself, in n log n steps."""
        ids = [self.id[s] for s in self.symbols(word)]
        n = len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], k = self.merge[a, b][1], -1, after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                if m := self.merge.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := self.merge.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def greedy(self, word: str) -> list[int] | None:
        out, i, n, get, longest, end = [], 0, len(word), self.propose.get, self.longest, self.end
        while i < n:
            if n - i <= longest and (t := get(word[i:] + end)) is not None:
                out.append(t)
                return out
            for j in range(min(n - 1, i + longest), i, -1):
                if (t := get(word[i:j])) is not None:
                    break
            else:
                return None
            out.append(t)
            i = j
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Words in byte letters."""
        out = [self.greedy(w) for w in words]
        long = [g if g and len(g) > 1 else [] for g in out]
        flat = np.fromiter((t for g in long for t in g), np.int64)
        sizes = np.fromiter(map(len, long), np.int64, len(long))
        bad = np.fromiter((g is None for g in out), bool, len(out))
        if len(flat):
            owner = np.repeat(np.arange(len(long)), sizes)
            pair = np.flatnonzero(owner[:-1] == owner[1:])
            keys, back = np.unique(flat[pair] * self.size + flat[pair + 1], return_inverse=True)
            fine = self.compatible(keys // self.size, keys % self.size)
            bad[owner[pair[~fine[back]]]] = True
        for i in np.flatnonzero(bad).tolist():
            out[i] = self.exact(words[i])
        return out

    def provable(self, text: str) -> bool:
        return self.quick and not pieces.unsafe().search(text) and not any(s in text for s in self.special) and "Σ" not in text and "İ" not in text and unicodedata.is_normalized("NFC", text)

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text the decimal ids and the decoded text in UTF-8. Decoding joins the tokens by one space."""
        found = [pieces.bare().findall(x.lower()) if self.provable(x) else None for x in texts]
        got = [f and list(map(self.cache.get, f)) for f in found]
        missing: set[str] = set()
        for f, g in zip(found, got):
            if f and None in g:
                missing.update(x for x, v in zip(f, g) if v is None)
        words = list(missing)
        ids = self.encode_words([w.encode().decode("latin-1").translate(self.letters) for w in words])
        new = {w: (" ".join(map(str, g)).encode(), " ".join([self.token[t] for t in g]).encode()) for w, g in zip(words, ids)}
        if len(self.cache) < CACHE:
            self.cache.update(new)
        out = []
        for x, f, g in zip(texts, found, got):
            if f is None:
                e = self.tok.encode(x, add_special_tokens=False).ids
                out.append((" ".join(map(str, e)).encode(), self.tok.decode(e, skip_special_tokens=False).encode()))
            else:
                if g and None in g:
                    g = [new[x] if v is None else v for x, v in zip(f, g)]
                out.append((b" ".join([v[0] for v in g]), b" ".join([v[1] for v in g])))
        return out


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, vocabulary: str, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256 (of the decoded text in
    UTF-8) of every row; with keep also token_ids and decoded themselves. Null and empty texts have no ids and decode to
    the empty text. Repeated rows stay; an empty table gives no rows; other columns aren't read. Whatever a text holds
    goes through one of two ways with equal results, so there is no error case."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = codec(vocabulary).encode_all([x or "" for x in batch.column(1).to_pylist()])
        sha = lambda x: hashlib.sha256(x).hexdigest()
        out = {"doc_id": batch.column(0), "n_tokens": pa.array([a.count(b" ") + bool(a) for a, _ in both], pa.int64()), "ids_sha256": [sha(a) for a, _ in both], "decoded_sha256": [sha(b) for _, b in both]}
        if keep:
            out |= {"token_ids": pa.array([[int(i) for i in a.split()] for a, _ in both], pa.list_(pa.int32())), "decoded": [b.decode() for _, b in both]}
        return pa.RecordBatch.from_pydict(out)

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>, decoded string" * keep)
