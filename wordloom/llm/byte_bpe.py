"""Whole texts through a byte-level BPE tokenizer file: token counts of texts of any length, and token ids.

Counts of huge texts are made by overlap resynchronisation. Overlapping chunks are encoded, with offsets, apart from each
other; two neighbours are spliced at a position where both have a token boundary and where the characters alone prove
that every left-to-right scan ends a piece. Merges never cross pieces, so both sides are what the whole text would give.
If the overlap has no such position, it is widened, in the end over the whole neighbour.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache
from itertools import compress, repeat
from operator import is_

import numpy as np

from . import pieces

#: Characters of a chunk, of the overlap at first, and the length beyond which a text is cut into chunks at all.
CHUNK, OVERLAP, HUGE = 1 << 15, 256, 1 << 16
#: Entries of a worker's piece cache.
CACHE = 800_000


class Encoder:
    """encode() gives ids as little-endian bytes of the narrowest unsigned integer type."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        pre = spec.get("pre_tokenizer") or {}
        self.quick = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec.get("post_processor") is None
        feed = self.tok.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if self.quick and len(feed) == 1 else None
        self.cache: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def provable(self, text: str) -> bool:
        return bool(self.quick) and not pieces.unsafe().search(text) and not any(s in text for s in self.special)

    def learn(self, missing: list[str]) -> dict[str, bytes]:
        """Encodes pieces. Those of a space and letters are encoded in long runs with a line feed between any two: they
        are again these pieces, and the line feed's id, which letters never have, tells them apart."""
        words = [x for x in missing if len(x) > 1 and x[0] == " " and x[1].isalpha() and x.isprintable()] if self.feed is not None else []
        rest = list({*missing}.difference(words))
        out = dict(zip(rest, self.whole(rest)))
        size = self.dtype.itemsize
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            raw = self.whole(["\n".join(part)])[0]
            ends = (np.flatnonzero(np.frombuffer(raw, self.dtype) == self.feed) * size).tolist()
            out.update(zip(part, map(raw.__getitem__, map(slice, [0, *(x + size for x in ends)], [*ends, len(raw)]))))
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Equal to the tokenizer on each whole text. The first CACHE different pieces that a worker meets stay known to
        it; others are encoded once a batch. Each text is looked through once for pieces that aren't known, and only these
        are filled in."""
        found = [pieces.spaced().findall(x) if self.provable(x) else None for x in texts]
        got = [list(map(self.cache.get, f or ())) for f in found]
        gaps = [list(compress(range(len(g)), map(is_, g, repeat(None)))) for g in got]
        missing: set[str] = set()
        for f, gap in zip(found, gaps):
            if gap:
                missing.update(map(f.__getitem__, gap))
        new = self.learn(list(missing))
        if len(self.cache) < CACHE:
            self.cache.update(new)
        out = []
        for x, f, g, gap in zip(texts, found, got, gaps):
            for j in gap:
                g[j] = new[f[j]]
            out.append(self.whole([x])[0] if f is None else b"".join(g))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def boundary(self, text: str, p: int) -> bool:
        """Whether every scan of the text, wherever it began, ends a piece just before p. A piece holds characters of one
        class only, but for a leading space and an apostrophe before letters."""
        a, b = pieces.kind(text[p - 1]), pieces.kind(text[p])
        if a in "SU" or b == "U" or a == b or (text[p - 1] == "'" and b == "L"):
            return False
        return not any(s in text[max(0, p - len(s) + 1) : p + len(s) - 1] for s in self.special)

    def starts(self, text: str, lo: int, hi: int) -> np.ndarray:
        """Where the tokens of text[lo:hi] start in text."""
        offsets = self.tok.encode(text[lo:hi], add_special_tokens=False).offsets
        return np.fromiter((o[0] for o in offsets), np.int64, len(offsets)) + lo

    def count_huge(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of a text by overlap resynchronisation."""
        if not self.quick:
            return len(self.whole([text])[0]) // self.dtype.itemsize
        n, total, begin, at = len(text), 0, 0, 0  # begin: proven start of what isn't counted; at: start of the left chunk
        left = self.starts(text, 0, min(n, chunk + overlap))
        end = min(n, chunk + overlap)
        while end < n:
            wide = end - (at + chunk)
            lo = at + chunk
            hi = min(n, max(lo + chunk, end) + overlap)
            right = self.starts(text, lo, hi)
            common = np.intersect1d(left[left > max(lo, begin)], right[right < end])
            p = next((int(p) for p in common[::-1] if self.boundary(text, int(p))), None)
            if p is None:  # nothing can be proven in this overlap: widen it
                end = min(n, end + 2 * max(wide, overlap))
                left = self.starts(text, begin, end)
                at = max(at, end - chunk - 2 * max(wide, overlap))
                continue
            total += int(((left >= begin) & (left < p)).sum())
            begin, at, left, end = p, lo, right, hi
        return total + int((left >= begin).sum())

    def count_all(self, texts: list[str]) -> list[int]:
        short = [x if len(x) <= HUGE else "" for x in texts]
        return [len(ids) // self.dtype.itemsize if len(x) <= HUGE else self.count_huge(x) for x, ids in zip(texts, self.encode_all(short))]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def crc32_u32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
