"""Catalog queries against DuckDB, and the functions behind them against plain Python."""

import itertools
import random
import re
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wordloom.functions import distance as D
from wordloom.functions import text as T
from wordloom.operators import index as I
from wordloom.operators import pattern as P
from wordloom.operators import relations as R
from wordloom.operators import search as S
from wordloom.plans import catalog

SF = Path("/root/testdata/sf0.001")


def norm(v):
    assert not isinstance(v, Decimal), "the SQL gives a decimal where the query gives a double"
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(SF))
    rows = df.collect()
    if name not in catalog.ORACLES:
        assert rows
        return
    rel = duck(str(SF)).sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    want = sorted((tuple(norm(r[k]) for k in order) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(map(norm, r)) for r in rows), key=repr) == want


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "f, value, want",
    [
        (T.tokenize, "imini ka kaidi tshay=a akhéhan?", ["imini", "ka", "kaidi", "tshaya", "tshay", "akhéhan"]),
        (T.split_words, "A-b, c  A-b「d」", ["ab", "c", "ab", "d"]),
        (T.tokenize, None, []),
        (T.gloss_tokens, "The dog's 'bone'; the 2", ["the", "dog's", "bone", "2"]),
        (T.search_key, "  Ma-Ruza’ ", "maruza'"),
        (T.derivation_candidates, "foo 'gloss; x' = ba (r)?", ["foo 'gloss; x' = ba (r)?", "foo", "ba"]),
        (T.zh_key, "中 　文", "中文"),
        (T.query_mode, "abc 漢", "zh"),
        (T.parse_timecode, "1:02:03.5", 3723.5),
        (T.parse_timecode, "02:03", None),
        (T.without_marks, "éñ", "en"),
        (T.composed, "é", "é"),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


def test_words_are_split_at_plain_blanks(spark):
    """As the regular expression does it, at every character, but without one."""
    df = spark.createDataFrame([(f"x{chr(c)}-Y" + 3 * chr(c),) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000], "t string").coalesce(4)
    c = F.col("t")
    old = F.filter(F.split(F.translate(F.translate(F.lower(c), T.FOLD_FROM, T.FOLD_TO), T.NOTATION, ""), T.SEPARATORS), lambda w: w != "")
    assert df.filter(T.split_words(c) != old).collect() == []
    plan = df.select(T.split_words(c).alias("w"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split" in plan and "(?U)" not in plan and plan.count("translate(") == 1


@pytest.mark.parametrize("seconds, want", [(0.0, "00:00.00"), (61.5, "01:01.50"), (3723.25, "1:02:03.25")])
def test_format_timecode(spark, seconds, want):
    assert one(spark, seconds, T.format_timecode, "double") == want


@pytest.mark.parametrize("text, role, form, want", [("-an", None, None, "affix"), ("<um>", None, "", "affix"), ("a b", None, "bound", "affix"), ("a b c", "segment", None, "sentence"), ("Go!", "example", None, "sentence"), ("a b", "segment", None, "phrase"), ("a b c", "head", None, "phrase"), (" a ", None, None, "word")])
def test_unit_class(spark, text, role, form, want):
    df = spark.createDataFrame([(text, role, form)], "t string, r string, f string")
    assert df.select(T.unit_class(F.col("t"), F.col("r"), F.col("f"))).first()[0] == want


def brute(metric, x, y):
    """The distance by its definition, top down and without tables."""
    ex, ey = metric.edges(x), metric.edges(y)
    memo = {}

    def d(i, j):
        if (i, j) == (0, 0):
            return 0.0
        if (i, j) not in memo:
            c, out = metric.costs, []
            if i:
                out.append(d(i - 1, j) + c.dele(x[i - 1]))
            if j:
                out.append(d(i, j - 1) + c.ins(y[j - 1]))
            if i and j:
                out.append(d(i - 1, j - 1) + c.sub(x[i - 1], y[j - 1]))
            for r in metric.rules:
                a, b = i - len(r.source), j - len(r.target)
                if a >= 0 and b >= 0 and x[a:i] == r.source and y[b:j] == r.target:
                    if (r.position != "initial" or ex[0][a] and ey[0][b]) and (r.position != "final" or ex[1][i] and ey[1][j]):
                        out.append(d(a, b) + r.weight)
            memo[i, j] = min(out)
        return memo[i, j]

    return D.round_cost(d(len(x), len(y)))


def some_rules(rnd):
    out = []
    while len(out) < 5:
        s, t = ("".join(rnd.choice("abn ") for _ in range(rnd.randint(0, 2))).strip() for _ in range(2))
        if s != t:
            out.append(D.Rule(s, t, rnd.choice([0.1, 0.3, 0.6]), rnd.choice(["any", "initial", "final"])))
    return D.expand(out)


def test_distance_is_its_definition_and_its_mirror():
    rnd = random.Random(4)
    for _ in range(300):
        m = D.Metric(some_rules(rnd))
        x, y = ("".join(rnd.choice("abn ") for _ in range(rnd.randint(0, 6))) for _ in range(2))
        want = brute(m, x, y)
        assert abs(m.distance(x, y) - want) < 1e-9
        assert abs(m.mirror().distance(x[::-1], y[::-1]) - want) < 1e-9
        steps = m.align(x, y)
        assert abs(sum(s["cost"] for s in steps) - want) < 1e-6
        assert "".join(s["source"] for s in steps) == x and "".join(s["target"] for s in steps) == y


def test_known_distances():
    m = D.Metric(D.expand([D.Rule("l", "n", 0.1, "final"), D.Rule("r", "e", 0.1, "final")]))
    assert m.distance("bintul", "bintun") == 0.1 and m.distance("semer", "semee") == 0.1 and m.distance("lal", "nal") == 1.2


def test_plain_distance_in_the_jvm(spark):
    rnd = random.Random(6)
    rows = [("".join(rnd.choice("ab é") for _ in range(rnd.randint(0, 5))), "".join(rnd.choice("ab é") for _ in range(rnd.randint(0, 5)))) for _ in range(60)] + [("kitten", "sitting"), ("", "abc"), ("a b", "ab")]
    m = D.Metric()
    df = spark.createDataFrame(rows, "q string, c string").withColumn("d", D.plain_distance(F.col("q"), F.col("c")))
    assert all(abs(r.d - m.distance(r.q, r.c)) < 1e-9 for r in df.collect())


def test_contexts_of_every_word(spark, tmp_path):
    text = "the cat saw the cat near a big elephant".split()
    spark.createDataFrame([(1, "cat the elephant")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, " ".join(text))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.pos, r.word, r.left, r.right) for r in catalog.QUERIES["kwic"](spark, str(tmp_path)).collect())
    assert got == [(i, w, " ".join(text[max(0, i - 3) : i][::-1]), " ".join(text[i + 1 : i + 4])) for i, w in enumerate(text) if w in ("cat", "the", "elephant")]


def test_fuzzy_search_finds_all_pairs(spark, tmp_path):
    rnd = random.Random(9)
    some = lambda n: sorted({"".join(rnd.choice(["th", "t", "ti", "te", "ou", "o", "en", "in", "ng", "h", "a"]) for _ in range(rnd.randint(1, 5))) for _ in range(n)})
    queries, lexicon = ["ththin", "tionen", "elaborated", *some(60)], ["ththen", "tionin", "elaboratad", *some(140)]
    spark.createDataFrame([(1, " ".join(queries))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, w) for i, w in enumerate(lexicon)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.q, r.term): r.distance for r in catalog.fuzzy_search(spark, str(tmp_path)).collect()}
    m = D.Metric(catalog.RULES)
    every = {(q, t): m.distance(q, t) for q in set(queries) for t in {*queries, *lexicon}}
    assert got == {(q, t): x for (q, t), x in every.items() if x <= min(max(0.2 + 0.15 * len(q), 0.3), 1.6) + 1e-9 and x / max(len(q), len(t)) <= 0.3 + 1e-9}
    assert all(r.q != r.term for r in catalog.neighbors(spark, str(tmp_path)).collect())


def test_folding_makes_rules_free():
    rnd = random.Random(5)
    for _ in range(100):
        m = D.Metric(some_rules(rnd))
        fold = m.fold()
        for r in m.rules:
            assert "".join(fold.get(c, c) for c in r.source) == "".join(fold.get(c, c) for c in r.target)


def test_rules_are_checked():
    for bad in (("a", "a", 0.1, "any"), ("a", "b", -1, "any"), ("a", "b", 0.1, "middle")):
        with pytest.raises(ValueError):
            D.Rule(*bad)


def test_merging_hits(spark):
    rows = [("q", "a", "fuzzy", 0.3), ("q", "a", "lemma", 0.5), ("q", "b", "prefix", 0.4), ("q", "b", "derived", 0.6), ("q", "c", "sibling", 0.1), ("q", "c", "substring", 1.0), ("q", "d", "sibling", 0.1), ("q", "e", "fuzzy", 0.9), ("q", "e", "lemma", 0.5)]
    out = {r.term: (r.match_type, r.score) for r in S.merged(spark.createDataFrame(rows, "q string, term string, match_type string, score double")).collect()}
    assert out == {"a": ("fuzzy", 0.3), "b": ("derived", 0.4), "c": ("substring", 1.0), "d": ("sibling", 0.1), "e": ("lemma", 0.5)}


def test_cap_spares_siblings(spark):
    rows = [("q", f"t{i}", "fuzzy", i / 10, i) for i in range(5)] + [("q", f"s{i}", "sibling", 0.4, 10 + i) for i in range(4)]
    out = S.capped(spark.createDataFrame(rows, "q string, term string, match_type string, score double, doc int"), 2).collect()
    assert sorted(r.term for r in out) == ["s0", "s1", "s2", "s3", "t0", "t1"]


def test_gloss_ranks(spark):
    glosses = spark.createDataFrame([(1, "to run; go"), (2, "run fast"), (3, "a fast run"), (4, "running of runners; fast"), (5, "walk")], "doc int, gloss string")
    out = {(r.qid, r.doc): r["rank"] for r in S.gloss_hits(spark.createDataFrame([(1, "the run"), (2, "of"), (3, "fast run")], "qid int, text string"), glosses).collect()}
    assert out == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 1, (3, 2): 3, (3, 3): 2, (3, 4): 3}


def test_gloss_hits_look_at_equal_glosses_once(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(S, "kept", lambda df: (sizes.append(df.count()), df)[1])
    glosses = [(i, ("fast run; to go", "a runner", "fast; runway")[i % 3]) for i in range(300)] + [(500, "fast"), (500, "to run")]
    queries = [(1, "the run"), (2, "fast run"), (3, "fast none"), (4, "go"), (4, "run"), (5, "of")]
    df = S.gloss_hits(spark.createDataFrame(queries, "qid int, text string"), spark.createDataFrame(glosses, "doc int, gloss string"))
    rank = {1: (2, 3, 1), 2: (0, None, 3)}
    want = sorted((q, i, r[i % 3]) for q, r in rank.items() for i in range(300) if r[i % 3] is not None)
    rows = sorted(map(tuple, df.collect()))
    assert [r for r in rows if r[0] < 3 and r[1] < 500] == want
    assert [r for r in rows if r[1] == 500] == [(1, 500, 0), (1, 500, 3), (2, 500, 3), (2, 500, 3), (4, 500, 0), (4, 500, 3)]
    assert sorted(r for r in rows if r[0] == 4 and r[1] < 3) == [(4, 0, 0), (4, 0, 2), (4, 1, 3), (4, 2, 1)]
    assert sizes[0] == 5 and not [r for r in rows if r[0] in (3, 5)]


def test_postings_of_every_kind(spark):
    t = lambda *rows: spark.createDataFrame(rows, "doc int, text string")
    out = {(r.term, r.doc, r.kind, r.code) for r in I.postings(t((1, "Ka-na")), t((1, "kano")), None, t((1, "ka = na?")), t((2, "ka na"), (2, "na"))).collect()}
    assert out == {("kana", 1, "head", 5), ("kano", 1, "alt", 6), ("ka na?", 1, "root", 8), ("ka", 1, "root", 8), ("na", 1, "root", 8), ("ka", 2, "token", 14), ("na", 2, "token", 14)}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_postings_of_distinct_documents_need_no_shuffle(spark):
    docs = [(1, "a-b c a"), (2, "c c d")]
    for more in ([], [(2, "d e")]):
        df = spark.createDataFrame(docs + more, "doc_id long, text string")
        got = I.postings(texts=df.withColumnRenamed("doc_id", "doc"))
        want = {("ab", 1), ("c", 1), ("a", 1), ("c", 2), ("d", 2)} | {("e", 2) for _ in more}
        assert sorted((r.term, r.doc) for r in got.collect()) == sorted(want)
        assert ("Aggregate" in plan(got)) == bool(more)
        assert {r.term: r.n for r in R.treated(I.token_postings(df)).collect()}["d"] == 1


def test_runs_are_counted_without_their_documents(spark):
    docs = [(1, "a b a b c"), (2, "a b"), (3, "a"), (4, None)]
    for more in ([], [(2, "a b c")]):
        df = S.ngram_frequency(spark.createDataFrame(docs + more, "doc_id long, text string"), 2)
        assert sorted(map(tuple, df.collect())) == sorted([("a b", 3 + len(more), 2), ("b a", 1, 1), ("b c", 1 + len(more), 1 + len(more))])
        assert plan(df).count("Aggregate") == 1 + len(more)


def test_shortened_words_are_not_grouped(spark):
    df = R.shortened(spark.createDataFrame([("aab",)], "key string"), 2)
    assert sorted(map(tuple, df.collect())) == sorted([("aab", "aab", 0), ("aab", "ab", 1), ("aab", "aa", 1), ("aab", "a", 2), ("aab", "b", 2)])
    assert "Aggregate" not in plan(df)


def test_closure_of_a_chain(spark):
    df = spark.createDataFrame([(str(i), str(i + 1)) for i in range(12)], "parent string, child string")
    assert R.closure(df).count() == 13 * 14 // 2
    with pytest.raises(ValueError):
        R.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string"))


def test_descendants_take_the_cheapest_way(spark):
    e = spark.createDataFrame([("a", "b", 0.3), ("b", "c", 0.3), ("a", "c", 0.9), ("c", "d", 0.6)], "root string, word string, cost double")
    s = spark.createDataFrame([("a", 0.1)], "word string, cost double")
    assert {(r.word, r.cost) for r in R.descendants(e, s, 1.0).collect()} == {("b", 0.4), ("c", 0.7)}
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 0.05) for i in range(15)], "root string, word string, cost double")
    out = R.descendants(chain, spark.createDataFrame([("n0", 0.0)], "word string, cost double"), 0.6).collect()
    assert {(r.word, r.steps, r.root) for r in out} == {(f"n{i}", i, "n0") for i in range(1, 13)}


def test_long_affixes_are_stripped(spark):
    a = spark.createDataFrame([("prefix", "counterintel"), ("suffix", "s")], "kind string, form string")
    w = spark.createDataFrame([("counterintelabcs",)], "word string")
    assert {(r.stem, r.n) for r in R.strip_affixes(w, a).collect()} == {("counterintelabcs", 0), ("abcs", 1), ("counterintelabc", 1), ("abc", 2)}


def test_blocking_against_counts(spark):
    rnd = random.Random(3)
    ws = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 6))) for _ in range(60)})
    df = spark.createDataFrame([(w,) for w in ws], "q string")
    pairs = {w: {f"^{w}$"[i : i + 2] for i in range(len(w) + 1)} for w in ws}
    want = set()
    for q in ws:
        near = sorted(((-len(pairs[q] & pairs[t]), t) for t in ws if t != q and pairs[q] & pairs[t]))[:7]
        want |= {(q, t, -n, k) for k, (n, t) in enumerate(near, 1)}
    assert {tuple(r) for r in R.blocked(df, df.withColumnRenamed("q", "term"), 7).collect()} == want


def test_open_repeats_have_no_end(spark):
    df = spark.createDataFrame([(1, "start " + "a " * 70 + "end")], "doc int, text string")
    assert [(r.start, r.n) for r in P.search(df, "start (a)* end").collect()] == [(0, 72)]


def test_issues(spark):
    r = spark.createDataFrame([("1", "g"), ("1", "g"), ("2", "h")], "id string, grp string")
    out = R.issues(r, "id", "grp", spark.createDataFrame([("g",)], "gid string"), "gid").collect()
    assert {tuple(x) for x in out} == {("duplicate id", "1", 2), ("missing parent", "h", 1)}


WORDS = ["the", "a", "going", "being", "dog", "ring"]


def python_matches(query, ws):
    """Each word becomes a letter, and the pattern plain re over these."""
    letter = {w: chr(97 + i) for i, w in enumerate(WORDS)}
    q = P.parse(query)
    test = {"exact": lambda w, t: w == t, "prefix": lambda w, t: w.startswith(t), "suffix": lambda w, t: w.endswith(t)}

    def cls(m):
        no = m[1].startswith("!")
        kind, text = q.atoms[int(m[1].lstrip("!"))]
        return "[" + ("".join(letter[w] for w in WORDS if test[kind](w, text) != no) or "0") + "]"

    (_, body), = q.conditions
    return [(m.start(), len(m[0])) for m in re.finditer(re.sub(r"⟨(!?\d+)⟩", cls, body), "".join(letter[w] for w in ws))]


@pytest.mark.parametrize("query", ['"the" _{0,2} *ing', "the | a+ dog", "!the *ing", "^ the [a] dog", "(the | a){1,2} _ $", "go* *ing?", "_{2}"])
def test_patterns_against_re(spark, query):
    rnd = random.Random(7)
    texts = [[rnd.choice(WORDS) for _ in range(rnd.randint(1, 9))] for _ in range(60)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc int, text string")
    got = sorted((r.doc, r.start, r.n) for r in P.search(df, query).collect())
    assert got == sorted((i, *m) for i, t in enumerate(texts) for m in python_matches(query, t))


def test_pattern_conditions(spark):
    df = spark.createDataFrame([(1, "the dog. A ring"), (2, "the dog"), (3, "the dog! being")], "doc int, text string")
    assert {r.doc for r in P.search(df, "the dog & ring").collect()} == {1}
    assert {r.doc for r in P.search(df, "the dog & !ring").collect()} == {2, 3}
    assert [tuple(r) for r in P.frequency(P.search(df, "the _")).collect()] == [("the dog", 3, 3)]


@pytest.mark.parametrize("query, code", [("", "empty"), ("a*?", "may-be-empty"), ("(a", "unclosed-group"), ('"a', "unclosed-quote"), ("a{0}", "bad-repeat"), ("a{3,2}", "bad-repeat"), ("a & ", "empty"), ("!(a)", "not-one-word"), ("a )", "unexpected"), ("x" * 300, "too-long"), ("[a]", "may-be-empty"), ("a*b", "bad-glob")])
def test_pattern_errors(query, code):
    with pytest.raises(P.PatternError) as e:
        P.parse(query)
    assert e.value.code == code


def test_partial_matches_are_all_there(spark):
    words = ["".join(x) for n in (1, 2, 3) for x in itertools.product("ab", repeat=n)]
    t, q = spark.createDataFrame([(w,) for w in words], "term string"), spark.createDataFrame([(w,) for w in words], "q string")
    got = {(r.q, r.term) for r in I.partial_matches(q, t).collect()}
    assert got == {(a, b) for a in words for b in words if a in b and a != b}


def test_the_rest_stands_without_the_optional_subpackage():
    """Nothing outside it imports the training-data subpackage."""
    root = Path(__file__).resolve().parent.parent / "wordloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p
