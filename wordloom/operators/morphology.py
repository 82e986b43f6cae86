"""Morphology: grammars, templates, generation, and joint search of roots by its definition."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import EPSILON, Costs, Metric, Rule, round_cost

VOWELS = "aeiouéə"
#: Shapes of reduplicated parts, over consonants, glides and vowels; a is the vowel a, whatever the stem has.
TEMPLATES = {"Ca": "Ca", "CV": "CV", "CVV": "CVV", "CGV": "CGV", "CVG": "CVG", "CVCV": "CVCV", "CVCVC": "CVCVC", "full": None}


@dataclass(frozen=True)
class Grammar:
    """affixes: (kind, form, cost), kinds prefix, suffix, infix and reduplication (form: a template); circumfixes: (prefix,
    suffix, cost); rules hold within words, `junction` rules only at the edges of morphemes."""

    affixes: list[tuple[str, str, float]] = field(default_factory=list)
    circumfixes: list[tuple[str, str, float]] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    junction: list[Rule] = field(default_factory=list)
    costs: Costs = field(default_factory=Costs)
    vowels: str = VOWELS
    glides: str = "wy"
    max_steps: int = 3
    min_stem: int = 3
    spread: float = 0.6
    syllables: tuple[float, ...] = (0.0,)


def validate(g: Grammar) -> list[str]:
    """What is wrong with a grammar; empty if nothing is."""
    out = []
    for kind, form, cost in g.affixes:
        if kind not in ("prefix", "suffix", "infix", "reduplication"):
            out.append(f"unknown kind {kind}")
        if not form or " " in form or kind == "reduplication" and form not in TEMPLATES:
            out.append(f"{kind}: form {form!r}")
        if not cost >= 0:
            out.append(f"{kind} {form}: cost {cost}")
    for a, b, cost in g.circumfixes:
        if not a or not b or not cost >= 0:
            out.append(f"circumfix {a!r} {b!r} {cost}")
    if set(g.glides) & set(g.vowels):
        out.append("a glide is a vowel")
    for name in ("max_steps", "min_stem"):
        if not 1 <= getattr(g, name) <= 9:
            out.append(name)
    return out


def expand(pattern: list[list[str]], most: int = 5000) -> list[str]:
    """All strings of a construction, one allomorph a slot; more than `most` is an error."""
    n = 1
    for slot in pattern:
        n *= len(slot)
    if n > most:
        raise ValueError(f"{n} forms, at most {most}")
    return sorted({"".join(x) for x in itertools.product(*pattern)})


def junction_rules(alternations: list[tuple[str, str, float]]) -> list[Rule]:
    """Alternations (underlying, surface, weight) as one-way rules from what is written to what it stands for."""
    return [Rule(surface, under, w, "any", "alternation") for under, surface, w in alternations if under != surface]


def onset(stem: str, g: Grammar) -> str:
    return re.match(f"[^{re.escape(g.vowels)}]*", stem)[0]


def reduplicant(stem: str, template: str, g: Grammar) -> str | None:
    """What is put before a stem, or None where the stem doesn't have the template's shape."""
    shape = TEMPLATES[template]
    if shape is None:
        return stem
    first, out, i = onset(stem, g), "", 0
    if shape.startswith("C"):
        out, i, shape = first[:1], len(first), shape[1:]
        if not first:
            return None
    for k, x in enumerate(shape):
        if x == "a":
            out += "a"
            continue
        ch = stem[i : i + 1]
        fits = ch and (ch in g.vowels if x == "V" else ch in g.glides if x == "G" else ch not in g.vowels)
        if not fits and x == "G" and k == 0 and len(first) > 1 and first[1] in g.glides:
            out += first[1]
            continue
        if not fits:
            return None
        out, i = out + ch, i + 1
    return out


def apply(stem: str, kind: str, form: str, g: Grammar) -> str | None:
    """A stem with one step, or None where it doesn't take it."""
    if kind == "prefix":
        return form + stem
    if kind == "suffix":
        return stem + form
    if kind == "infix":
        first = onset(stem, g)
        return first + form + stem[len(first) :] if len(stem) > len(first) else None
    red = reduplicant(stem, form, g)
    return None if red is None else red + stem


def generate(stem: str, steps: list[tuple[str, str]], g: Grammar) -> str | None:
    for kind, form in steps:
        if stem is None:
            return None
        stem = apply(stem, kind, form, g)
    return stem


def root_cost(root: str, g: Grammar) -> float:
    n = sum(ch in g.vowels for ch in root)
    return g.syllables[min(n, len(g.syllables) - 1)]


def chains(g: Grammar) -> list[tuple[tuple[str, ...], tuple[str, ...], tuple[str, str] | None, float]]:
    """(prefixes, outermost first; suffixes, innermost first; wrapping unit or None; cost) of all analyses with a step: at most
    max_steps prefixes and suffixes, and one unit that wraps the root: an infix, a reduplication or a circumfix."""
    side = lambda kind: [(f, c) for k, f, c in g.affixes if k == kind]
    runs = lambda xs: [x for n in range(g.max_steps + 1) for x in itertools.product(xs, repeat=n)]
    wraps: list[tuple[tuple[str, str] | None, float]] = [(None, 0.0), *(((k, f), c) for k, f, c in g.affixes if k in ("infix", "reduplication")), *((("circumfix", f"{a}…{b}"), c) for a, b, c in g.circumfixes)]
    out = []
    for p in runs(side("prefix")):
        for s in runs(side("suffix")):
            for w, c in wraps:
                if p or s or w:
                    out.append((tuple(x for x, _ in p), tuple(x for x, _ in s), w, sum(y for _, y in (*p, *s)) + c))
    return out


def wrapped(root: str, wrap: tuple[str, str] | None, g: Grammar) -> str | None:
    if wrap is None:
        return root
    if wrap[0] == "circumfix":
        a, b = wrap[1].split("…")
        return a + root + b
    return apply(root, *wrap, g)


class Joint:
    """Distance of a query to an underlying string with junctions: rules apply within and across, their word positions are waived at
    a junction, and junction rules only apply where source and target touch one."""

    def __init__(self, g: Grammar):
        self.plain, self.at_edges = Metric(g.rules, g.costs), g.junction

    def distance(self, x: str, y: str, cuts: set[int], bound: float) -> float:
        inf, c = float("inf"), self.plain.costs
        ex = ([True, *(ch in c.boundary for ch in x)], [*(ch in c.boundary for ch in x), True])
        starts, ends = {0, *cuts}, {len(y), *cuts}
        d = [[inf] * (len(y) + 1) for _ in range(len(x) + 1)]
        d[0][0] = 0.0
        for i in range(len(x) + 1):
            least = inf
            for j in range(len(y) + 1):
                here = d[i][j]
                least = min(least, here)
                if here > bound + EPSILON:
                    continue
                if i < len(x) and j < len(y):
                    d[i + 1][j + 1] = min(d[i + 1][j + 1], here + c.sub(x[i], y[j]))
                if i < len(x):
                    d[i + 1][j] = min(d[i + 1][j], here + c.dele(x[i]))
                if j < len(y):
                    d[i][j + 1] = min(d[i][j + 1], here + c.ins(y[j]))
                for rules, edge in ((self.plain.rules, False), (self.at_edges, True)):
                    for r in rules:
                        a, b = i + len(r.source), j + len(r.target)
                        if a > len(x) or b > len(y) or x[i:a] != r.source or y[j:b] != r.target:
                            continue
                        if edge and not cuts & {j, b}:
                            continue
                        if any(j < k < b for k in cuts) and r.position != "any":
                            continue
                        if r.position == "initial" and not (j in starts and (ex[0][i] or j in cuts)) or r.position == "final" and not (b in ends and (ex[1][a] or b in cuts)):
                            continue
                        d[a][b] = min(d[a][b], here + r.weight)
        return d[-1][-1]


def analyses(q: str, roots: list[str], g: Grammar, most: float, every: list | None = None) -> list[tuple[str, float, str]]:
    """(root, cost with the root's own, chain) of all roots within `most` (without it), at most spread beyond the best. By the
    definition: every chain of steps around every root against the query. Of equal costs the fewest steps, then the first."""
    joint, best = Joint(g), {}
    if len(q) < g.min_stem + 1:
        return []
    for prefixes, suffixes, wrap, cost in every if every is not None else chains(g):
        if cost > most + EPSILON:
            continue
        pre, suf = "".join(prefixes), "".join(suffixes)
        for root in roots:
            if root == q or len(root) < g.min_stem:
                continue
            core = wrapped(root, wrap, g)
            if core is None or (abs(len(pre) + len(core) + len(suf) - len(q)) * 0.1 > most and not g.rules):
                continue
            y = pre + core + suf
            cuts, at = set(), 0
            for p in prefixes:
                at += len(p)
                cuts.add(at)
            at = len(pre) + len(core)
            cuts.add(at) if suf else None
            for p in suffixes[:-1]:
                at += len(p)
                cuts.add(at)
            w = cost + joint.distance(q, y, cuts, most - cost)
            if w > most + EPSILON:
                continue
            steps = [*(f"{p}-" for p in prefixes), *([f"<{wrap[1]}>"] if wrap else []), *(f"-{x}" for x in suffixes)]
            key = (round_cost(w + root_cost(root, g)), len(steps), steps)
            if root not in best or key < best[root]:
                best[root] = key
    if not best:
        return []
    least = min(k[0] for k in best.values())
    return sorted((r, k[0], " ".join(k[2])) for r, k in best.items() if k[0] <= least + g.spread + EPSILON)


def bound_edits(g: Grammar, most: float) -> int:
    """How many plain edits `most` leaves room for."""
    plain = min(g.costs.substitute, g.costs.delete, g.costs.insert)
    return int((most + EPSILON) / plain)


def search(queries: DataFrame, lexicon: DataFrame, g: Grammar, most: float) -> DataFrame:
    """q, root, cost, chain: the analyses of each query over the whole lexicon, cheapest within the spread.

    Each chain of steps leaves room for few plain edits, and rules don't change folded texts (Metric.fold). So queries and
    all forms of the lexicon (root with chain) are joined on what is left of their folded texts when as many characters are
    taken out, an equi-join that finds every pair within the bound; the joint distance then decides. Grammars whose
    junction rules change the folded text are folded with these rules too."""
    from .relations import shortened

    every = [c for c in chains(g) if c[3] <= most + EPSILON]
    fold = Metric([*g.rules, *g.junction], g.costs).fold()
    gone, stays = "".join(c for c in fold if not fold[c]), {c: fold[c] for c in fold if fold[c]}
    key = lambda c: F.translate(c, "".join(stays) + gone, "".join(stays.values()))

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for root in b["term"]:
                if len(root) < g.min_stem:
                    continue
                for k, (pre, suf, wrap, cost) in enumerate(every):
                    if (core := wrapped(root, wrap, g)) is not None:
                        rows.append((root, k, cost, "".join(pre) + core + "".join(suf)))
            yield pd.DataFrame(rows, columns=["root", "k", "step_cost", "form"])

    edits = bound_edits(g, most)
    f = lexicon.select("term").distinct().mapInPandas(forms, "root string, k int, step_cost double, form string")
    plain = min(g.costs.substitute, g.costs.delete, g.costs.insert)
    room = F.floor((F.lit(most + EPSILON) - F.col("step_cost")) / plain).cast("int")
    a = shortened(queries.select("q", key(F.col("q")).alias("key")).distinct(), edits)
    b = shortened(f.select("root", "k", key(F.col("form")).alias("key"), room.alias("room")).distinct(), edits).filter("left <= room")
    pairs = a.alias("a").join(b.alias("b"), F.col("a.gram") == F.col("b.gram")).filter(F.col("a.left") <= F.col("room")).select("q", "root", "k").distinct()

    def cost(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for q, group in b.groupby("q", sort=False):
                for root, ks in group.groupby("root", sort=False)["k"]:
                    # One root at a time, so no spread cuts here.
                    for r, c, chain in analyses(q, [root], g, most, [every[k] for k in ks]):
                        rows.append((q, r, c, len(chain.split(" ")), chain))
            yield pd.DataFrame(rows, columns=["q", "root", "cost", "steps", "chain"])

    found = pairs.repartition("q").mapInPandas(cost, "q string, root string, cost double, steps int, chain string")
    best = found.groupBy("q", "root").agg(F.min(F.struct("cost", "steps", F.split("chain", " ").alias("chain"))).alias("b")).select("q", "root", "b.cost", F.array_join("b.chain", " ").alias("chain"))
    least = best.groupBy("q").agg(F.min("cost").alias("least"))
    return best.join(least, "q").filter(F.col("cost") <= F.col("least") + g.spread + EPSILON).select("q", "root", "cost", "chain")
