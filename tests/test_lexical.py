"""Families, records, segmentations, correspondences and morphology against plain Python."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wordloom.functions import distance as D
from wordloom.operators import correspond as O
from wordloom.operators import family as Y
from wordloom.operators import morphology as M
from wordloom.operators import pattern as P
from wordloom.operators import records as C
from wordloom.operators import search as S
from wordloom.operators import segmentation as G
from wordloom.plans import catalog

ITEM = "id string, source string, key string, text string, grp string, head boolean, seq int, up string, links array<string>, derived array<struct<key:string,text:string>>"


def item(i, text="", grp=None, head=False, seq=0, up=None, links=(), derived=(), source="s"):
    return (i, source, text.lower(), text, grp, head, seq, up, list(links), [(x.lower(), x) for x in derived])


def test_parents_by_every_rule(spark):
    rows = [
        item("h1", "Ka", "g1", True), item("m1", "kana", "g1", seq=2), item("m2", "kanu", "g1", up="m1"), item("m3", "x", "g1", up="nowhere"),
        item("h2", "maka", "g2", True, derived=["none", "ka"]), item("h3", "l", "g3", True, links=["gone", "m1"], derived=["ka"]),
        item("d1", "same", "g4", True), item("d2", "Same", "g5", True), item("h4", "u", "g6", True, derived=["same"]), item("h5", "v", "g7", True, derived=["SAME"]),
        item("free", "f", links=["h2"]), item("alone", "a", derived=["ka"]), item("a", "", links=["b"]), item("b", "", links=["a"]), item("other", "ka", "g8", True, source="t"),
    ]
    out = {r.id: r.parent for r in Y.parents(spark.createDataFrame(rows, ITEM)).collect()}
    assert out == {"h1": None, "m1": "h1", "m2": "m1", "m3": "h1", "h2": "h1", "h3": "m1", "d1": None, "d2": None, "h4": "d1", "h5": None, "free": "h2", "alone": None, "a": None, "b": None, "other": None}


def test_long_ways_up_are_cut(spark):
    rows = [(f"n{i:02}", f"n{i - 1:02}" if i else None) for i in range(40)]
    out = {r.id: r.parent for r in Y.cut(spark.createDataFrame(rows, "id string, parent string")).collect()}
    assert all((out[f"n{i:02}"] is None) == (i == 0 or i >= 32) for i in range(40))


def test_short_ways_up_end_the_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(Y, "kept", lambda df: (rounds.append(1), df.localCheckpoint())[1])
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "x")], "id string, parent string")
    assert {r.id: r.parent for r in Y.cut(tree.filter("id <> 'x'")).collect()} == {"a": None, "b": "a", "c": "b"}
    assert len(rounds) == 3
    assert {r.id: r.parent for r in Y.cut(tree).collect()} == {"a": None, "b": "a", "c": "b", "x": None}


def test_families_and_relations(spark):
    tree = spark.createDataFrame([("r", None), ("a", "r"), ("b", "r"), ("c", "a"), ("z", None)], "id string, parent string")
    hits = spark.createDataFrame([("c", 0.5), ("b", 0.2)], "id string, score double")
    assert [tuple(r) for r in Y.families(tree, hits).collect()] == [("r", 4, 2, 0.2, "b")]
    rel = {(r.id, r.kind, r.depth) for r in Y.relations(tree, spark.createDataFrame([("q", "a")], "q string, id string")).collect()}
    assert rel == {("c", "root", 1), ("r", "parent", 1), ("b", "sibling", 2)}
    assert {r.parent: r.children for r in Y.children(tree).collect()} == {"r": ["a", "b"], "a": ["c"]}


@pytest.mark.parametrize("text, yes", [("a _ b", True), ("snake_case", False), ("pa…", True), ('"x"', True), ("a|b", True), ("kita!", False), ("!kita", True), ("a{2}", True), ("(a)?", True), ("kita?", False), ("@ka", True), ("漢|字", False), ("x$", True), ("", False)])
def test_pattern_signs(spark, text, yes):
    df = spark.createDataFrame([(text,)], "t string").select(C.is_pattern(F.col("t")), C.is_pattern(F.col("t"), "plain"), C.is_pattern(F.col("t"), "pattern"))
    assert tuple(df.first()) == (yes, False, bool(text))


def test_dialect_cells(spark):
    v = spark.createDataFrame([("north", ["North Side", "N"]), ("south", ["S"])], "code string, labels array<string>")
    cells = spark.createDataFrame([(1, "s; NORTH、x ,n/ X"), (2, None), (3, " ")], "row int, cell string")
    assert {r.row: (r.codes, r.unknown) for r in C.dialect_cells(cells, v).collect()} == {1: (["south", "north"], ["x", "X"]), 2: ([], []), 3: ([], [])}


def test_next_ids_fill_gaps(spark):
    used = spark.createDataFrame([("w1",), ("w2",), ("w5",), ("v3",), ("w04",), (None,)], "id string")
    rows = spark.createDataFrame([(i,) for i in (10, 20, 30, 40)], "k int")
    assert {r.k: r.new_id for r in C.next_ids(rows, "k", used, "w").collect()} == {10: "w3", 20: "w4", 30: "w6", 40: "w7"}
    assert {r.new_id for r in C.next_ids(rows, "k", used.limit(0), "w").collect()} == {"w1", "w2", "w3", "w4"}


def test_next_ids_of_large_tables(spark, duck, tmp_path):
    spark.range(25_000).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/c")
    spark.createDataFrame([(3,), (21_000,), (21_001,)], "o_orderkey long").coalesce(1).write.parquet(f"{tmp_path}/o")
    for short, name in (("c", "customer"), ("o", "orders")):
        next((tmp_path / short).glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    rows = sorted(map(tuple, catalog.QUERIES["next_ids"](spark, str(tmp_path)).collect()))
    assert rows == list(enumerate(f"w{i}" for i in range(1, 25_003) if i not in (3, 21_000)))
    assert rows == sorted(duck(str(tmp_path)).sql(catalog.ORACLES["next_ids"]).fetchall())


def test_projection_of_records(spark):
    rows = [(1, [(" a ", "x", None), ("", "y", "n"), (None, None, None)], [("audio", "no", False), ("audio", "yes", None)], 7), (2, [], [], None)]
    r = spark.createDataFrame(rows, "id int, senses array<struct<zh:string,en:string,nan:string>>, media array<struct<type:string,src:string,available:boolean>>, grp int")
    out = {x.id: tuple(x)[1:] for x in C.projected(r, spark.createDataFrame([(7, "t")], "gid int, title string")).collect()}
    assert out == {1: ("a", "n", "x; y", "yes", "t"), 2: (None, None, None, None, None)}


@pytest.mark.parametrize("text, want", [("pa-kita", ("pa", None, [], "kita")), ("k<um>ita=an", (None, "an", ["um"], "kita")), ("ka~kata", (None, None, [], "kata")), ("ma-pa-kita-en-ay", ("ma", "ay", [], "kita")), ("(a)bc", (None, None, [], "abc")), ("-", (None, None, [], None))])
def test_segmentations(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(G.parsed(F.col("t")).alias("p")).first().p
    assert tuple(r) == want


def test_segmentation_scores(spark):
    r = spark.createDataFrame([(1, "pakita", "pa-kita"), (2, "kitaan", "kita-an")], "doc int, word string, segmentation string")
    found = spark.createDataFrame([("pakita", "prefix", "pa"), ("kitaan", "prefix", "pa"), ("kitaan", "prefix", "ki"), ("other", "prefix", "pa")], "word string, type string, form string")
    rows = G.compared(r, found)
    assert Counter(x.status for x in rows.collect()) == {"tp": 1, "fp": 1, "fn": 1}
    assert tuple(G.scored(rows).first()) == (1, 1, 1, 0.5, 0.5)


def test_occurrence_scores_against_loops(spark):
    rnd = random.Random(3)
    docs = {i: [rnd.choice("ab ba abc bc ca cab".split()) for _ in range(rnd.randint(1, 5))] for i in range(40)}
    queries = {1: "a b a", 2: "ab", 3: "zz ab", 4: "c ca"}
    matches = [(q, t, "fuzzy" if q == t else "prefix" if t.startswith(q) else "suffix" if t.endswith(q) else "substring", 0.0 if q == t else 0.4 if t.startswith(q) else 0.95) for q in ("a", "b", "ab", "c", "ca") for t in {w for d in docs.values() for w in d} if q in t]
    tokens = spark.createDataFrame([(w, i) for i, d in docs.items() for w in set(d)], "term string, doc int")
    q = spark.createDataFrame([*queries.items()], "qid int, text string")
    out = {(r.qid, r.doc): (r.score, r.match_type, r.n_terms) for r in S.scored_occurrences(q, spark.createDataFrame(matches, "q string, term string, match_type string, score double"), tokens).collect()}
    want = {}
    for k, text in queries.items():
        for i, d in docs.items():
            best = []
            for w, n in Counter(text.split()).items():
                hits = [(s, S.TYPE_RANK[m]) for a, t, m, s in matches if a == w and t in d]
                best.append((min(hits), n, len(hits)) if hits else None)
            if None not in best:
                want[k, i] = (round(sum(b[0][0] * b[1] for b in best), 9), list(S.TYPE_RANK)[max(b[0][1] for b in best)], sum(b[2] for b in best))
    assert out == want


def test_occurrences_of_whole_queries_with_all_matches(spark, duck, tmp_path):
    rnd = random.Random(5)
    texts = [(i, " ".join(rnd.choice("ab ba abc bc ca cab zz".split()) for _ in range(rnd.randint(1, 7)))) for i in range(40)]
    texts += [(50, "xx " + " ".join(f"xx{i:03}" for i in range(400)) + " ayy zz"), (51, "xx1 yy"), (52, "xx1 y"), (52, "y-y zz"), (53, None)]
    asked = [(1, "xx yy zz"), (2, "a b a"), (3, "zz ab ca"), (3, "zz"), (4, "."), (5, "none")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame(asked, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/b")
    for short, name in (("d", "documents"), ("b", "benchmark")):
        next((tmp_path / short).glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    for name in ("occurrence_scores", "occurrence_order"):
        want = duck(str(tmp_path)).sql(catalog.ORACLES[name])
        rows = sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()))
        assert rows == sorted(want.fetchall())
        assert [r[:5] for r in rows if r[0] == 1 and r[1] == 50] == [(1, 50, 0.95, "suffix", 403)]
        assert {r[1] for r in rows if r[0] == 1} == {50, 52}


def test_sound_classes_and_vowels(spark):
    t = spark.createDataFrame([("a", "b", 0.1), ("b", "c", 0.1), ("d", "e", 9.0)], "s string, w string, cost double")
    assert {r["segment"]: r["class"] for r in O.sound_classes(t, 0.5).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    words = spark.createDataFrame([(list(w),) for w in ("banana", "tapa", "kata", "moto", "sana")], "letters array<string>")
    assert O.vowels(O.adjacency(words))[:2] == ["a", "o"]
    assert [tuple(r) for r in spark.createDataFrame([("shengan",)], "t string").select(O.segments(F.col("t"), ["ng", "sh", "a"])).collect()] == [(["sh", "e", "ng", "a", "n"],)]


def test_aligned_costs():
    costs = {("a", "o"): 0.5, ("th", "t"): 0.2, ("a", "a"): 0.1}
    assert O.aligned("tha", "to", costs, longest=2) == pytest.approx(0.7)
    assert O.aligned("a", "a", costs) == pytest.approx(0.1) and O.aligned("b", "b", costs) == 0.0
    assert O.aligned("abc", "xyz", costs, bound=3.0) == math.inf


def test_models_are_checked():
    good = {"dialects": ["a", "b"], "patterns": [{"reflexes": {"a": "x", "b": "-"}, "sites": 3, "position": None}]}
    assert O.validate(good) == []
    assert len(O.validate({"dialects": ["a"], "patterns": [{"reflexes": {"c": "-", "a": ""}, "sites": 0, "position": "mid"}]})) == 5


def test_learner_takes_what_gains(spark):
    rows = [(a + "th" + b, a + "sk" + b) for a, b in itertools.product("abcdefgh", "ijklmnop")] + [(x + y + "aa", x + y + "aa") for x, y in itertools.product("abcdefth", repeat=2)]
    out = O.learned(spark.createDataFrame(rows, "x string, y string"), spark).collect()
    assert out and all(r.gain > 0 for r in out) and len({(r.s, r.w) for r in out}) == len(out)


def test_templates_and_generation():
    g = M.Grammar(vowels="aeiou")
    assert [M.reduplicant("kawas", t, g) for t in ("Ca", "CV", "CVCV", "full")] == ["ka", "ka", "kawa", "kawas"]
    assert M.reduplicant("alim", "CV", g) is None and M.reduplicant("kwali", "CGV", g) == "kwa"
    assert M.generate("kita", [("infix", "um"), ("prefix", "pa"), ("suffix", "en")], g) == "pakumitaen"
    assert M.expand([["a", "b"], ["c"], ["", "d"]]) == ["ac", "acd", "bc", "bcd"]
    with pytest.raises(ValueError):
        M.expand([["a"] * 100, ["b"] * 100])


def test_grammars_are_checked():
    assert M.validate(M.Grammar(affixes=[("prefix", "pa", 0.3)])) == []
    bad = M.Grammar(affixes=[("tail", "x", 0.1), ("prefix", "", 0.1), ("suffix", "a b", -1), ("reduplication", "XX", 0.1)], circumfixes=[("", "a", 1)], glides="a", max_steps=0)
    assert len(M.validate(bad)) == 8


def some_grammar(rnd):
    part = lambda: "".join(rnd.choice("abn") for _ in range(rnd.randint(1, 2)))
    rules = []
    while len(rules) < 2:
        s, t = part(), rnd.choice([part(), ""])
        if s != t:
            rules.append(D.Rule(s, t, rnd.choice([0.1, 0.3]), rnd.choice(["any", "initial", "final"])))
    affixes = [(rnd.choice(["prefix", "suffix", "infix"]), part(), rnd.choice([0.1, 0.3])) for _ in range(3)] + [("reduplication", "CV", 0.3)]
    return M.Grammar(affixes=affixes, circumfixes=[(part(), part(), 0.4)], rules=D.expand(rules), junction=M.junction_rules([(part(), part() + "a", 0.2)]), vowels="a", max_steps=2, syllables=(0.2, 0.0))


def test_joint_search_is_its_definition(spark):
    """Every analysis of every query, over the whole lexicon, against enumeration."""
    rnd = random.Random(11)
    word = lambda a, b: "".join(rnd.choice("abn") for _ in range(rnd.randint(a, b)))
    for _ in range(3):
        g = some_grammar(rnd)
        roots, queries = sorted({word(3, 4) for _ in range(12)}), sorted({word(4, 6) for _ in range(8)})
        out = {}
        for r in M.search(spark.createDataFrame([(q,) for q in queries], "q string"), spark.createDataFrame([(t,) for t in roots], "term string"), g, 1.0).collect():
            out.setdefault(r.q, set()).add((r.root, r.cost))
        want = {q: {(r, c) for r, c, _ in found} for q in queries if (found := M.analyses(q, roots, g, 1.0))}
        assert out == want


def test_joint_distance_without_junctions_is_the_distance():
    rnd = random.Random(5)
    for _ in range(300):
        g = some_grammar(rnd)
        x, y = ("".join(rnd.choice("abn") for _ in range(rnd.randint(0, 6))) for _ in range(2))
        assert abs(M.Joint(g).distance(x, y, set(), math.inf) - D.Metric(g.rules, g.costs).distance(x, y)) < 1e-9


def test_words_that_must_be_there(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["a", "b", "c"])], "doc int, ws array<string>")
    assert {r.doc for r in P.with_words(df, ["a", "b"], ["c"]).collect()} == {1}
