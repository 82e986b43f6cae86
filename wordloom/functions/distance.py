"""Weighted, rule-driven edit distance: a Column expression without rules, Arrow functions with them."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def round_cost(x: float) -> float:
    return x if math.isinf(x) else round(x * 1e9) / 1e9


@dataclass(frozen=True)
class Rule:
    """source may become target for weight; position: any, initial or final (of a word)."""

    source: str
    target: str
    weight: float
    position: str = "any"
    category: str = ""

    def __post_init__(self):
        if self.position not in ("any", "initial", "final"):
            raise ValueError(f"position {self.position!r}")
        if not (self.weight >= 0) or self.source == self.target:
            raise ValueError(f"rule {self.source!r} to {self.target!r} at {self.weight}")


@dataclass(frozen=True)
class Costs:
    """What plain edits cost; a boundary character is cheaper to drop or add and never becomes a letter."""

    substitute: float = 1.2
    delete: float = 1.0
    insert: float = 1.0
    boundary: str = " "
    boundary_edit: float = 0.1

    def dele(self, ch: str) -> float:
        return self.boundary_edit if ch in self.boundary else self.delete

    def ins(self, ch: str) -> float:
        return self.boundary_edit if ch in self.boundary else self.insert

    def sub(self, a: str, b: str) -> float:
        if a == b:
            return 0.0
        return math.inf if (a in self.boundary) != (b in self.boundary) else self.substitute


def expand(rules: list[Rule], both_ways: bool = True) -> list[Rule]:
    """Rules with their reverses; of equal (position, source, target) the cheapest stays."""
    best: dict[tuple, Rule] = {}
    for r in rules:
        for x in (r, Rule(r.target, r.source, r.weight, r.position, r.category))[: 1 + both_ways]:
            k = (x.position, x.source, x.target)
            if k not in best or x.weight < best[k].weight:
                best[k] = x
    return list(best.values())


@dataclass
class Metric:
    """Directed distance from a query to a candidate."""

    rules: list[Rule] = field(default_factory=list)
    costs: Costs = field(default_factory=Costs)

    def __post_init__(self):
        self.by_target: dict[str, list[Rule]] = {}
        for r in self.rules:
            self.by_target.setdefault(r.target[-1:], []).append(r)

    def edges(self, x: str) -> tuple[list[bool], list[bool]]:
        b = self.costs.boundary
        start = [i == 0 or x[i - 1] in b for i in range(len(x) + 1)]
        end = [i == len(x) or x[i] in b for i in range(len(x) + 1)]
        return start, end

    def applicable(self, x: str, y: str, i: int, j: int, ex: tuple, ey: tuple):
        """Rules whose source ends at i and whose target ends at j."""
        for key in {y[j - 1 : j] if j else "", ""}:
            for r in self.by_target.get(key, ()):
                a, b = i - len(r.source), j - len(r.target)
                if a < 0 or b < 0 or x[a:i] != r.source or y[b:j] != r.target:
                    continue
                if r.position == "initial" and not (ex[0][a] and ey[0][b]) or r.position == "final" and not (ex[1][i] and ey[1][j]):
                    continue
                yield r, a, b

    def matrix(self, x: str, y: str) -> tuple[list[list[float]], list[list[tuple]]]:
        """Costs, and for each cell the step that reaches it best: (order, name, back i, back j, cost, category)."""
        c, ex, ey = self.costs, self.edges(x), self.edges(y)
        d = [[math.inf] * (len(y) + 1) for _ in range(len(x) + 1)]
        step: list[list[tuple]] = [[()] * (len(y) + 1) for _ in range(len(x) + 1)]
        d[0][0] = 0.0
        for i in range(len(x) + 1):
            for j in range(len(y) + 1):
                if not i and not j:
                    continue
                ways = []
                if i and j:
                    w = c.sub(x[i - 1], y[j - 1])
                    ways.append((d[i - 1][j - 1] + w, 0 if w == 0 else 2, "match" if w == 0 else "substitute", i - 1, j - 1, w, ""))
                if i:
                    ways.append((d[i - 1][j] + c.dele(x[i - 1]), 3, "delete", i - 1, j, c.dele(x[i - 1]), ""))
                if j:
                    ways.append((d[i][j - 1] + c.ins(y[j - 1]), 4, "insert", i, j - 1, c.ins(y[j - 1]), ""))
                for r, a, b in self.applicable(x, y, i, j, ex, ey):
                    ways.append((d[a][b] + r.weight, 1, "rule", a, b, r.weight, r.category))
                least = min(w[0] for w in ways)
                best = min((w for w in ways if w[0] <= least + EPSILON), key=lambda w: w[1])
                d[i][j], step[i][j] = least, best[1:]
        return d, step

    def distance(self, x: str, y: str) -> float:
        return round_cost(self.matrix(x, y)[0][-1][-1])

    def align(self, x: str, y: str) -> list[dict]:
        """Steps of a best alignment; on ties a match before a rule, before a substitution, a deletion, an insertion."""
        _, step = self.matrix(x, y)
        i, j, out = len(x), len(y), []
        while i or j:
            _, name, a, b, cost, category = step[i][j]
            out.append({"op": name, "source": x[a:i], "target": y[b:j], "cost": round_cost(cost), "category": category})
            i, j = a, b
        return out[::-1]

    def fold(self) -> dict[str, str]:
        """What becomes of each character that rules or boundaries touch, a character or nothing, so that both sides of any
        rule become the same text. Other characters stay, so a plain edit is one edit of folded texts at most."""
        up: dict[str, str] = {}

        def root(c: str) -> str:
            while c in up:
                c = up[c]
            return c

        def same(a: str, b: str) -> None:
            a, b = sorted((root(a), root(b)), reverse=True)  # nothing sorts first, so it stays a root
            if a != b:
                up[a] = b

        for r in self.rules:
            s, t = r.source, r.target
            while s and t and s[0] == t[0]:
                s, t = s[1:], t[1:]
            while s and t and s[-1] == t[-1]:
                s, t = s[:-1], t[:-1]
            for a, b in zip(s, t) if len(s) == len(t) else ((c, "") for c in s + t):
                same(a, b)
        for c in self.costs.boundary:
            same(c, "")
        return {c: root(c) for c in up}

    def mirror(self) -> "Metric":
        """The metric on reversed strings."""
        turn = {"initial": "final", "final": "initial", "any": "any"}
        return Metric([Rule(r.source[::-1], r.target[::-1], r.weight, turn[r.position], r.category) for r in self.rules], self.costs)


def normalized(d: Column, q: Column, c: Column, how: str) -> Column:
    """none, max, sum or query: by which length a distance is divided."""
    a, b = F.length(q), F.length(c)
    by = {"none": F.lit(1), "max": F.greatest(a, b, F.lit(1)), "sum": F.greatest(a + b, F.lit(1)), "query": F.greatest(a, F.lit(1))}[how]
    return F.round(d / by, 9)


def plain_distance(q: Column, c: Column, costs: Costs = Costs()) -> Column:
    """Without rules: nested aggregates over code points, inside the JVM."""
    chars = lambda s: F.filter(F.split(s, ""), lambda x: x != "")
    cost = lambda ch, w: F.when(F.lit(costs.boundary).contains(ch), F.lit(costs.boundary_edit)).otherwise(F.lit(w))
    edge = lambda ch: F.lit(costs.boundary).contains(ch)

    def of(ys: Column) -> Column:
        zero = F.array(F.lit(0.0))
        first = F.aggregate(ys, zero, lambda acc, y: F.concat(acc, F.array(F.element_at(acc, -1) + cost(y, costs.insert))))

        def next_row(row: Column, x: Column) -> Column:
            start = F.array(F.element_at(row, 1) + cost(x, costs.delete))

            def cell(acc: Column, y: Column) -> Column:
                j = F.size(acc)
                sub = F.when(x == y, F.lit(0.0)).when(edge(x) != edge(y), F.lit(float("inf"))).otherwise(F.lit(costs.substitute))
                return F.concat(acc, F.array(F.least(F.element_at(acc, -1) + cost(y, costs.insert), F.element_at(row, j + 1) + cost(x, costs.delete), F.element_at(row, j) + sub)))

            return F.aggregate(ys, start, cell)

        return F.element_at(F.aggregate(chars(q), first, next_row), -1)

    return F.round(F.element_at(F.transform(F.array(chars(c)), of), 1), 9)


def weighted_distance(metric: Metric):
    """A Column function (query, candidate) for a metric with rules."""
    @F.pandas_udf("double")
    def f(q: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else metric.distance(a, b) for a, b in zip(q, c)], dtype="float64")

    return f


def alignment(metric: Metric):
    @F.pandas_udf("array<struct<op:string,source:string,target:string,cost:double,category:string>>")
    def f(q: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else metric.align(a, b) for a, b in zip(q, c)])

    return f
