"""Every stage of the pipeline and the whole run against plain Python."""

import hashlib
import random
from collections import Counter

import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from test_operators import LINE, SCHEMA, brute_boilerplate, prose, table  # noqa: E402
from wordloom.llm import op2_near_dedup, op5_decontaminate  # noqa: E402

PLAIN = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def fixture_rows():
    rnd = random.Random(21)
    base = [prose(rnd, 90) for _ in range(14)]
    rows = [(i, t, "a") for i, t in enumerate(base)]
    rows += [(20, base[0], "b"), (21, base[1] + " more", "a"), (22, base[2].replace("alpha", "alfa", 1), None)]
    rows += [(30 + i, f"{LINE}\n{prose(rnd, 80)}\nA line that two documents share.", "h") for i in range(9)]
    rows += [(50, base[3] + "\n" + prose(rnd, 60), "a"), (60, None, "a"), (61, "", None), (62, "too short", "a"), (None, prose(rnd, 70), "a"), (70, prose(rnd, 12_000), "b")]
    rows += [(30, rows[17][1], "h"), (5, base[5], "a")]  # repeated rows
    items = [(1, " ".join(base[4].split()[10:30])), (2, " ".join(base[6].split()[:9])), (3, None), (4, ""), (5, "words that occur nowhere at all in any of these documents")]
    return rows, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = fixture_rows()
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], PLAIN).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def quality(rows):
    return [(i, t if not gone else text, s) for (i, t, s), (_, _, gone, good, text) in zip(rows, brute_boilerplate(rows)) if good]


def lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    holders = {}
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            if i is not None:
                holders.setdefault(key(x), set()).add(i)
    stays = lambda i, x: i is None or len(key(x)) < 10 or len(holders[key(x)]) < 2 or i == min(holders[key(x)])
    return [(i, t if t is None else "\n".join(x for x in t.split("\n") if stays(i, x)), s) for i, t, s in rows]


def near(rows):
    found = op2_near_dedup.brute_force([(i, t) for i, t, _ in {r[0]: r for r in rows if r[0] is not None}.values()])
    return [r for r in rows if r[0] is None or found[r[0]] == r[0]]


def clean(rows, items):
    hit = {r[0] for r in op5_decontaminate.brute_force([(i, t) for i, t, _ in rows], items) if r[3]}
    return [r for r in rows if r[0] is None or r[0] not in hit]


def encoded(rows):
    tok = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = []
    for i, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    return out


def test_the_whole_run(spark, folder):
    rows, items = fixture_rows()
    want = encoded(clean(near(lines(quality(rows))), items))
    out = corpus_pipeline.run(spark, folder)
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()]
    assert Counter(got) == Counter(want)
    kept = {r[0] for r in got}
    assert not {4, 6, 60, 61, 62} & kept and {0, 1, 2, 3, 7, 70, None} <= kept


def triples(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_a_stage_by_itself(spark, folder, name):
    """Nulls, empty and very long texts, repeated rows and clashing names; each stage on its own input."""
    rows, items = fixture_rows()
    docs = table(spark, rows)
    by_hand = {"quality_rules": quality, "line_dedup": lines, "near_dedup": near, "decontamination": lambda r: clean(r, items)}[name]
    out = STAGES[name](spark, docs, folder)
    assert out.columns == docs.columns
    assert triples(out) == Counter(by_hand(rows))
    assert all(r.n_chars == len(r.text or "") and r["lm_did"] == 7 and r["did"] == "x" and r["end"] is None for r in out.collect())


def test_stages_of_an_empty_table(spark, folder):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_near_dedup_sees_a_part_of_a_much_longer_text(spark, folder):
    """Four fifths of a text's five-word shingles are enough, whatever the other's length; less are not."""
    words = [f"w{i}" for i in range(600)]
    text = lambda a, n, own=0: " ".join(words[a : a + n] + [f"own{a}x{i}" for i in range(own)])
    rows = [(0, text(0, 300), "a"), (1, text(20, 30), "a"), (2, text(100, 84, 20), "b"), (3, text(200, 83, 20), "b"), (4, text(300, 20), "a"), (5, text(300, 300), "a"), (None, text(0, 300), "a")]
    out = STAGES["near_dedup"](spark, table(spark, rows), folder)
    assert {r.doc_id for r in out.collect()} == {0, 3, 4, None}


def test_near_dedup_keeps_one_of_what_a_document_of_two_texts_ties(spark, folder):
    """Copies of either text are in the class of the document that has both."""
    rnd = random.Random(8)
    a, b, c = (prose(rnd, n) for n in (60, 90, 70))
    rows = [(3, a, "a"), (4, b, "a"), (5, a, "a"), (5, b, "b"), (6, " ".join(b.split()[10:40]), "a"), (7, c, "a"), (7, c + " more", "a")]
    out = STAGES["near_dedup"](spark, table(spark, rows), folder)
    assert sorted(r.doc_id for r in out.collect()) == [3, 7, 7]


def test_near_dedup_hands_no_pairs_of_sets_to_python(spark):
    """Batches of pairs with both sets would take a worker's memory; they are counted where they are joined."""
    sets = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [9, 2, 3, 4, 5, 6, 7]), (3, [1, 2, 3, 6, 7]), (4, [])], "node long, items array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 4)], "x long, y long")
    found = op2_near_dedup.check_pairs(pairs, sets)
    assert sorted(found.collect()) == [(1, 2), (2, 3)]
    assert "InArrow" not in found._jdf.queryExecution().toString()


def test_decontamination_removes_each_document_with_a_passage(spark, folder):
    """One passage of one item is enough, whatever the operator before has kept."""
    rows, _ = fixture_rows()
    left = {r.doc_id for r in STAGES["decontamination"](spark, table(spark, rows), folder).collect()}
    assert not {4, 6} & left and {0, 1, 2, 3, 5} <= left
