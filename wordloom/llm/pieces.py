"""Pre-tokenisation in the standard library's re, proven equal to the tokenizers' own where it is used at all.

A text takes the quick way only if each of its characters is in the basic plane, was assigned in Unicode 3.2 and has
kept its general category since; then letters, digits and white space are the same in every Unicode version that a
tokenizer may have been compiled with. Any other text goes through the tokenizer whole.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache


def _ranges(codes: list[int]) -> str:
    out, start = [], None
    for i, c in enumerate(codes):
        if start is None:
            start = c
        if i + 1 == len(codes) or codes[i + 1] != c + 1:
            out.append(f"\\u{start:04x}-\\u{c:04x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=1)
def classes() -> dict[str, str]:
    """Character classes: L letters, N numbers, S white space (as plain ranges, which re turns into one bitmap), U not
    safe for the quick way."""
    old, by = unicodedata.ucd_3_2_0, {"L": [], "N": [], "S": [], "U": []}
    for c in range(0x10000):
        kind = unicodedata.category(chr(c))
        if kind in ("Cn", "Cs", "Co") or kind != old.category(chr(c)) or 0x1C <= c <= 0x1F:
            by["U"].append(c)
        if kind[0] in "LN":
            by[kind[0]].append(c)
        elif chr(c).isspace():
            by["S"].append(c)
    out = {k: _ranges(v) for k, v in by.items()}
    out["U"] += f"\\U00010000-\\U{sys.maxunicode:08x}"
    return out


@lru_cache(maxsize=1)
def unsafe() -> re.Pattern:
    return re.compile(f"[{classes()['U']}]")


@lru_cache(maxsize=1)
def spaced() -> re.Pattern:
    """Pieces that keep their leading space. The alternatives start with different characters, so the order in which
    words come before contractions changes nothing."""
    l, n, s = (classes()[k] for k in "LNS")
    return re.compile(rf" ?[{l}]+| ?[{n}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+")


@lru_cache(maxsize=1)
def bare() -> re.Pattern:
    """Pieces without white space, of lower-cased text; digits are single."""
    l, n, s = (classes()[k] for k in "LNS")
    return re.compile(rf"[{l}]+|'(?:s|t|re|ve|m|ll|d)|[{n}]|[^{s}{l}{n}]+")


@lru_cache(maxsize=65536)
def kind(ch: str) -> str:
    """S white space, L, N, O other; U where nothing can be proven."""
    if unsafe().match(ch):
        return "U"
    return "S" if ch.isspace() else k if (k := unicodedata.category(ch)[0]) in "LN" else "O"
