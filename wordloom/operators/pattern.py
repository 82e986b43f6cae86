"""A query language over word sequences.

    query  = cond { "&" ["!"] cond }        records need every condition, and none of the negated ones
    cond   = seq { "|" seq }
    seq    = item { item }
    item   = ["!"] atom [ "?" | "*" | "+" | "{n}" | "{n,}" | "{n,m}" ]   the sign follows without a blank
    atom   = "exact" | prefix* | *suffix | word | _ | ( cond ) | [ cond ] | ^ | $

A word without quotes is exact too unless a metric is given. Matches are leftmost, greedy and don't overlap, within a sentence. Every token
becomes one character that stands for the set of atoms it satisfies; the sequence is then a regular expression over these, which the
JVM evaluates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MAX_LENGTH, MAX_ATOMS, MAX_REPEAT = 256, 12, 30
SENTENCE_END = r"[。！？!?.]+"
_TOKEN = re.compile(r"""(?P<blank>\s+)|(?P<exact>"(?:[^"\\]|\\.)*")|(?P<repeat>\{\d+(?:,\d*)?\})|(?P<sign>[()\[\]|&!?+^$])|(?P<word>[^\s"{}()\[\]|&!?+^$]+)""")


class PatternError(ValueError):
    def __init__(self, code: str, at: int):
        super().__init__(f"{code} at {at}")
        self.code, self.at = code, at


@dataclass
class Query:
    """conditions: (negated, expression over atoms ⟨k⟩); atoms: (kind, text)."""

    conditions: list[tuple[bool, str]] = field(default_factory=list)
    atoms: list[tuple[str, str]] = field(default_factory=list)


def lex(query: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    if len(query) > MAX_LENGTH:
        raise PatternError("too-long", MAX_LENGTH)
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m:
            raise PatternError("unclosed-quote" if query[at] == '"' else "bad-character", at)
        out.append((m.lastgroup, m[0], at))
        at = m.end()
    return out


class Parser:
    def __init__(self, query: str):
        self.tokens, self.at, self.query = lex(query), 0, Query()

    def peek(self, blanks: bool = True) -> tuple[str, str, int] | None:
        while blanks and self.at < len(self.tokens) and self.tokens[self.at][0] == "blank":
            self.at += 1
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, text: str) -> bool:
        if (t := self.peek()) and t[0] == "sign" and t[1] == text:
            self.at += 1
            return True
        return False

    def place(self) -> int:
        return self.tokens[self.at][2] if self.at < len(self.tokens) else (self.tokens[-1][2] + len(self.tokens[-1][1]) if self.tokens else 0)

    def parse(self) -> Query:
        while True:
            negated = bool(self.query.conditions) and self.take("!")
            start = self.place()
            body, least = self.alternatives()
            if least == 0:
                raise PatternError("may-be-empty", start)
            self.query.conditions.append((negated, body))
            if not self.take("&"):
                break
        if self.peek():
            raise PatternError("unexpected", self.place())
        if all(n for n, _ in self.query.conditions):
            raise PatternError("only-negated", 0)
        return self.query

    def alternatives(self) -> tuple[str, int]:
        body, least = self.sequence()
        while self.take("|"):
            other, n = self.sequence()
            body, least = f"{body}|{other}", min(least, n)
        return f"(?:{body})", least

    def sequence(self) -> tuple[str, int]:
        out, least, any_item = "", 0, False
        while (t := self.peek()) and not (t[0] == "sign" and t[1] in ")]|&"):
            body, n = self.item()
            out, least, any_item = out + body, least + n, True
        if not any_item:
            raise PatternError("empty", self.place())
        return out, least

    def atom(self, kind: str, text: str) -> int:
        if (kind, text) not in self.query.atoms:
            if len(self.query.atoms) == MAX_ATOMS:
                raise PatternError("too-many-atoms", self.place())
            self.query.atoms.append((kind, text))
        return self.query.atoms.index((kind, text))

    def item(self) -> tuple[str, int]:
        start = self.place()
        if self.take("!"):
            t = self.peek()
            if not t or t[0] not in ("word", "exact") or t[1] == "_":
                raise PatternError("not-one-word", start)
            body, least = f"⟨!{self.one_word(*t[:2])}⟩", 1
            self.at += 1
        elif self.take("("):
            body, least = self.alternatives()
            if not self.take(")"):
                raise PatternError("unclosed-group", start)
        elif self.take("["):
            body, _ = self.alternatives()
            if not self.take("]"):
                raise PatternError("unclosed-group", start)
            body, least = f"(?:{body})?", 0
        elif self.take("^"):
            return "^", 0
        elif self.take("$"):
            return "$", 0
        else:
            t = self.peek()
            if not t or t[0] not in ("word", "exact"):
                raise PatternError("unexpected", start)
            body, least = (".", 1) if t[1] == "_" else (f"⟨{self.one_word(*t[:2])}⟩", 1)
            self.at += 1
        return self.repeated(body, least)

    def one_word(self, kind: str, text: str) -> int:
        if kind == "exact":
            return self.atom("exact", re.sub(r"\\(.)", r"\1", text[1:-1]))
        if text.startswith("*") and len(text) > 1 and "*" not in text[1:]:
            return self.atom("suffix", text[1:])
        if text.endswith("*") and len(text) > 1 and "*" not in text[:-1]:
            return self.atom("prefix", text[:-1])
        if "*" in text:
            raise PatternError("bad-glob", self.place())
        return self.atom("exact", text)

    def repeated(self, body: str, least: int) -> tuple[str, int]:
        t = self.peek(blanks=False)
        if not t or not (t[0] == "repeat" or t[1] in ("?", "+") or t[1] == "*"):
            return body, least
        self.at += 1
        if t[0] != "repeat":
            lo, hi = {"?": (0, 1), "+": (1, None), "*": (0, None)}[t[1]]
        else:
            a, comma, b = t[1][1:-1].partition(",")
            lo, hi = int(a), int(b) if b else None if comma else int(a)
            if max(lo, hi or 0) > MAX_REPEAT or hi is not None and (lo > hi or hi == 0):
                raise PatternError("bad-repeat", t[2])
        return f"(?:{body}){{{lo},{'' if hi is None else hi}}}", least * lo


def parse(query: str) -> Query:
    if not query.strip():
        raise PatternError("empty", 0)
    return Parser(query).parse()


#: Tokens are written as one character from here on, by the set of atoms that they satisfy.
FIRST = 0xE000


def expression(body: str, n: int) -> str:
    """The regular expression over token characters."""

    def cls(m: re.Match) -> str:
        k, no = int(m[1].lstrip("!")), m[1].startswith("!")
        return "[" + "".join(chr(FIRST + s) for s in range(1 << n) if bool(s >> k & 1) != no) + "]"

    return re.sub(r"⟨(!?\d+)⟩", cls, body)


def holds(word: Column, kind: str, text: str) -> Column:
    key = F.lit(text.lower())
    return word == key if kind == "exact" else word.startswith(key) if kind == "prefix" else word.endswith(key)


def encode(words: Column, atoms: list[tuple[str, str]]) -> Column:
    """One character a word."""
    code = lambda w: sum((F.when(holds(w, *a), 1 << k).otherwise(0) for k, a in enumerate(atoms)), F.lit(0))
    letters = F.lit("".join(chr(FIRST + s) for s in range(1 << len(atoms))))
    return F.array_join(F.transform(words, lambda w: F.substring(letters, code(w) + 1, 1)), "")


def sentences(docs: DataFrame) -> DataFrame:
    """doc, sentence, ws: words of each sentence that has any."""
    s = docs.select("doc", F.posexplode(F.split(F.coalesce("text", F.lit("")), SENTENCE_END)).alias("sentence", "text"))
    return s.select("doc", "sentence", T.split_words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)


def search(docs: DataFrame, query: str) -> DataFrame:
    """doc, sentence, cond, start, n, words: all matches in records that fulfil the query. docs: doc, text."""
    q = parse(query)
    n = len(q.atoms)
    rows = sentences(docs).withColumn("code", encode(F.col("ws"), q.atoms))
    out = None
    for k, (negated, body) in enumerate(q.conditions):
        hit = rows.filter(F.col("code").rlike(expression(body, n)))
        if negated:
            docs_out = hit.select("doc").distinct()
            rows = rows.join(docs_out, "doc", "left_anti")
            out = None if out is None else out.join(docs_out, "doc", "left_anti")
            continue
        # Each match in turn: what stands before it, and the match, from the end of the one before on.
        found = F.regexp_extract_all("code", F.lit(f"({expression(body, n)})"), F.lit(1))
        one = hit.withColumn("found", found).select("doc", "sentence", "ws", "code", F.posexplode("found").alias("i", "m"), "found")
        gaps = F.split("code", expression(body, n), -1)
        before = F.aggregate(F.slice(gaps, 1, F.col("i") + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice("found", 1, F.col("i")), F.lit(0), lambda a, x: a + F.length(x))
        one = one.select("doc", "sentence", F.lit(k).alias("cond"), before.alias("start"), F.length("m").alias("n"), F.array_join(F.slice("ws", before + 1, F.length("m")), " ").alias("words"))
        both = hit.select("doc").distinct()
        rows = rows.join(both, "doc", "left_semi")
        out = one if out is None else out.join(both, "doc", "left_semi").unionByName(one.join(out.select("doc").distinct(), "doc", "left_semi"))
    return out


def frequency(matches: DataFrame, top: int = 100) -> DataFrame:
    """words, count, docs: the most frequent matches."""
    return matches.groupBy("words").agg(F.count("*").alias("count"), F.count_distinct("doc").alias("docs")).orderBy(F.desc("count"), F.desc("docs"), "words").limit(top)


def with_words(docs: DataFrame, required: list[str], forbidden: list[str] = ()) -> DataFrame:
    """Records whose words (ws) hold all required atoms and none of the forbidden: what can match at all, before any matching."""
    for w in required:
        docs = docs.filter(F.array_contains("ws", w))
    for w in forbidden:
        docs = docs.filter(~F.array_contains("ws", w))
    return docs


def group_top(rows: DataFrame, group: str, keys: list, limit: int) -> DataFrame:
    """The first rows of each group, with their place."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*keys))
    return rows.withColumn("place", place).filter(F.col("place") <= limit)
