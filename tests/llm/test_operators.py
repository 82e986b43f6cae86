"""The training-data operators against brute force, on small tables with every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from wordloom.llm import byte_bpe, gru, op1_tokens, op2_near_dedup, op3_binary, op4_score, op5_decontaminate, op6_lines, op7_licenses, op8_bpe, op9_html, op10_quality, pieces, shingles  # noqa: E402
from wordloom.llm.common import shared_dir  # noqa: E402

BYTE, WORD = public.path("byte_bpe_50k.json"), public.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lm_did long, did string, `end` string"
LINE = "A line that every page of this host has."


def prose(rnd, n):
    return " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "rho", "tau", "phi"]) + str(rnd.randrange(40)) for _ in range(n))


def table(spark, rows):
    """Extra columns with clashing names come along."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "x", None) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    base = [prose(rnd, 80) for _ in range(12)]
    out = [(i, t, "a") for i, t in enumerate(base)]
    out += [(20, base[0], "a"), (21, base[0] + " tail end", "b"), (22, base[1].replace("alpha", "alfa", 1), "b"), (23, base[0], None)]
    out += [(30, None, "a"), (31, "", "a"), (32, "   \n\t ", None), (33, "one two", "b"), (34, "ONE  two", "b"), (None, base[2], "a"), (None, None, None)]
    out += [(40, "Licensed under the MIT License.\nmit license\n" + base[3], "b"), (41, f"{LINE}\n  {LINE.upper()} \nshort\nshort\n" + base[4], "c"), (42, f"{LINE}\nshort\n" + base[5], "c"), (42, f"{LINE}\nshort\n" + base[5], "c")]
    out += [(50, "word " * 30_000, "a"), (51, ("x" * 70_000) + " é 漢字 😀 <|endoftext|> don't " + base[6], "a"), (52, "\n".join([base[7]] * 4), "a")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_token_counts(docs, rows, empty):
    tok = tokenizers.Tokenizer.from_file(BYTE)
    want = []
    for i, t, _ in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert got(op1_tokens.count_tokens(docs, BYTE), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert op1_tokens.count_tokens(empty, BYTE).count() == 0


def test_overlap_resynchronisation():
    e, rnd = byte_bpe.Encoder(BYTE), random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "'s", "'", "1", "23", "é", "<|endoftext|>", "<|", "，", "漢", "😀", "...", "_", "́", "\x1c"]
    for _ in range(600):
        x = "".join(rnd.choice(parts) * rnd.choice([1, 1, 1, 2, 30]) for _ in range(rnd.randint(1, 60)))
        want = e.whole([x])[0]
        assert e.encode(x) == want
        assert e.count_huge(x, rnd.randint(2, 40), rnd.randint(1, 8)) == len(want) // 2


def test_new_pieces_are_encoded_without_offsets():
    """Offsets of every token cost time; a line feed tells words in a run apart as well."""
    e, rnd = byte_bpe.Encoder(BYTE), random.Random(4)

    class Fast:
        encode_batch_fast = e.tok.encode_batch_fast

    e.tok = Fast()
    letters = "abcdefgeinrstABé漢ñßж'"
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 12)))
    texts = ["".join(rnd.choice([" ", " ", " ", "\n", "  ", "\n ", ", ", " 12"]) + word() for _ in range(400)) for _ in range(20)] + ["", "\n", " a"]
    want = e.whole(texts)
    assert e.encode_all(texts) == want and e.encode_all(texts) == want
    assert e.encode_all(texts[::-1] + ["zq " + word()])[:-1] == want[::-1]


def test_token_files(spark, docs, rows, empty):
    tok = tokenizers.Tokenizer.from_file(BYTE)
    folder = shared_dir(spark)
    out = op3_binary.token_file_round_trip(docs, BYTE, folder).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted([i for i, _, _ in rows], key=lambda i: (i is not None, i or 0))
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens
    by = Counter()
    for i, t, _ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        by[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == by
    path = folder.removeprefix("file://")
    import json

    manifest = json.load(open(f"{path}/manifest.json"))
    assert manifest["n_docs"] == len(rows) and op3_binary.document(path, manifest, len(rows) - 1)[-1] == 2
    assert op3_binary.token_file_round_trip(empty, BYTE, shared_dir(spark)).count() == 0


def test_near_dedup(spark, docs, rows, empty):
    out = {r.doc_id: r.class_id for r in op2_near_dedup.classes(docs).collect() if r.doc_id is not None}
    known = {i: t for i, t, _ in rows if i is not None}
    assert out == {k: v for k, v in op2_near_dedup.brute_force(list(known.items())).items()}
    assert out[20] == out[21] == out[23] == 0 and out[22] == 1 and out[34] == 33 and out[30] == out[31] == 30 and out[32] == 32
    kept = op2_near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*(k for k, v in out.items() if k == v), None}
    assert op2_near_dedup.classes(empty).count() == 0


def test_near_dedup_chain_of_edits(spark):
    rnd = random.Random(9)
    rows, words = [], prose(rnd, 120).split()
    for i in range(60):
        words[rnd.randrange(120)] = f"w{i}"
        rows.append((i, " ".join(words), "a"))
    rows += [(100 + i, prose(rnd, 60) + " the same closing words in all of these texts", "a") for i in range(40)]
    out = {r.doc_id: r.class_id for r in op2_near_dedup.classes(table(spark, rows)).collect()}
    assert out == op2_near_dedup.brute_force([(i, t) for i, t, _ in rows])


def test_near_dedup_links_any_sizes(spark, monkeypatch):
    """Against sets of five words in plain Python: parts of much longer texts, at and just below the threshold, short ones
    in many texts, and texts that share most lines but no link."""
    rnd = random.Random(21)
    long = [prose(rnd, n) for n in (40, 90, 300, 700, 2000)]
    rows = [(10 * i, t) for i, t in enumerate(long)]
    part = lambda t, a, n: " ".join(t.split()[a : a + n])
    rows += [(1, part(long[4], 900, 60)), (2, part(long[3], 5, 500)), (11, part(long[2], 0, 60)), (12, part(long[1], 80, 5)), (13, part(long[0], 3, 4))]
    for k, (own, shared) in enumerate([(4, 16), (5, 15), (5, 20), (8, 40), (20, 80), (21, 80), (60, 240)]):  # own of own + shared shingles are apart
        rows.append((100 + k, part(long[4], 200 * k, shared + 4) + " " + prose(rnd, own)))
    notice = prose(rnd, 30)
    rows += [(200 + k, f"{notice} {prose(rnd, 40 + 30 * k)}") for k in range(12)] + [(230 + k, f"{notice} {prose(rnd, k)}") for k in range(9)]
    lines = [prose(rnd, 25) for _ in range(8)]
    rows += [(300 + k, " ".join(rnd.sample(lines, 4)) + " " + prose(rnd, rnd.choice([10, 30, 200]))) for k in range(30)]
    rows += [(301, rows[-29][1]), (400, long[3]), (-5, part(long[4], 300, 1500))]

    def shingle_set(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: shingle_set(t) for i, t in rows}
    want = {i: i for i in sets}
    linked = [(x, y) for x in sets for y in sets if x < y and 5 * len(sets[x] & sets[y]) >= 4 * min(len(sets[x]), len(sets[y]))]
    assert any(max(len(sets[x]), len(sets[y])) > 20 * min(len(sets[x]), len(sets[y])) for x, y in linked)
    while new := [(x, y) for x, y in linked if want[x] != want[y]]:
        for x, y in new:
            want[x] = want[y] = min(want[x], want[y])
    docs = table(spark, [(i, t, "a") for i, t in rows])
    assert {r.doc_id: r.class_id for r in op2_near_dedup.classes(docs).collect()} == want
    # All of it without the bands too, and with groups of a few shingles.
    monkeypatch.setattr(op2_near_dedup, "buckets", lambda nodes: nodes.select(nodes.a.alias("key"), "node", "n", nodes.n.alias("w")).limit(0))
    monkeypatch.setattr(op2_near_dedup, "GROUP", 8)
    assert {r.doc_id: r.class_id for r in op2_near_dedup.classes(docs).collect()} == want


def classes_by_text(rows):
    """Class of each document: texts are linked one by one, and a document ties all of its texts."""
    sets = [(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set(), t or "") for i, t in rows]
    linked = lambda a, b, s, t: 5 * len(a & b) >= 4 * min(len(a), len(b)) if a and b else not a and not b and s == t
    pairs = [(i, j) for i, a, s in sets for j, b, t in sets if i < j and linked(a, b, s, t)]
    out = {i: i for i, _ in rows}
    while new := [(x, y) for x, y in pairs if out[x] != out[y]]:
        for x, y in new:
            out[x] = out[y] = min(out[x], out[y])
    return out


def test_near_dedup_ties_the_texts_of_one_document(spark):
    """Rows that repeat a doc_id link all that any of them is near to, and only that: not what their texts hold together."""
    rnd = random.Random(33)
    a, b, c, d, e = (prose(rnd, n) for n in (60, 90, 40, 200, 30))
    half = lambda t, k: " ".join(t.split()[k : k + 16])
    rows = [(3, a), (4, b), (5, a), (5, b), (9, None), (10, c), (11, c), (11, ""), (12, "!"), (13, d)]
    rows += [(20, half(c, 0) + " " + prose(rnd, 30)), (20, half(d, 9) + " " + prose(rnd, 9)), (21, half(d, 9) + " " + half(e, 0) + " " + prose(rnd, 40))]
    rows += [(22, half(e, 0) + " " + prose(rnd, 18)), (22, half(d, 9) + " " + prose(rnd, 60)), (23, half(e, 2)), (23, prose(rnd, 9)), (24, e)]
    lines = [prose(rnd, 14) for _ in range(9)]
    rows += [(30 + rnd.randrange(40), " ".join(rnd.sample(lines, rnd.choice([1, 2, 3]))) + " " + prose(rnd, rnd.choice([2, 30, 90]))) for _ in range(60)]
    want = classes_by_text(rows)
    assert want[3] == want[4] == want[5] == 3 and want[9] == want[10] == want[11] == 9 and len({*want.values()}) > 8
    out = op2_near_dedup.classes(table(spark, [(i, t, "a") for i, t in rows]))
    assert {(r.doc_id, r.class_id) for r in out.collect()} == {*want.items()} and out.count() == len(rows)


def test_near_dedup_sends_little(spark, monkeypatch):
    """A shingle takes 9 bytes with its node and label, whatever the ids; the exact step reads no text a second time."""
    rnd = random.Random(3)
    rows = [(10**12 + 1000 * i - 7 * (i % 3), f"{prose(rnd, 300)} {'a line in all of these texts ' * (i % 2)}") for i in range(40)]
    text = spark.createDataFrame([(i, i, t) for i, t in rows[::-1]], "node long, label long, text string").coalesce(1)
    blocks = op2_near_dedup.shingle_blocks(text, 2).collect()
    n = sum(len(r.rest) // 7 for r in blocks)
    assert n == sum(map(len, shingles.shingle_sets([t for _, t in rows], 5)))
    assert sum(len(r.rest) + len(r.node) + len(r.label) for r in blocks) <= 10 * n
    calls = []
    sets_of = op2_near_dedup.sets_of
    monkeypatch.setattr(op2_near_dedup, "sets_of", lambda *a: calls.append(a) or sets_of(*a))
    rows = [(2, rows[0][1]), (3, " ".join(rows[0][1].split()[20:60])), (4, rows[1][1])]
    assert got(op2_near_dedup.classes(table(spark, [(i, t, "a") for i, t in rows])), "doc_id", "class_id") == [(2, 2), (3, 2), (4, 4)]
    assert len(calls) == 1


def test_banding_reaches_its_recall():
    for k in range(20):
        bands, r = op2_near_dedup.banding(k)
        assert bands * r <= op2_near_dedup.HASHES
        assert 1 - (1 - op2_near_dedup.jaccard_floor(k) ** r) ** bands >= 0.998


def test_shingles():
    a, b, c, d, e = shingles.shingle_sets(["The QUICK brown fox jumps. éa", "the quick, brown fox jumps éa", "a b", None, "A  b!"], 5)
    assert len(a) == 2 and (a == b).all() and (c == e).all() and len(c) == 1 and len(d) == 0


def test_score(spark, rows, empty, monkeypatch):
    monkeypatch.setattr(op4_score, "KNOWN", 60)
    monkeypatch.setattr(op4_score, "FREQUENT", 40)
    docs = table(spark, rows)
    out = op4_score.score_documents(docs).collect()
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})), "\n"]
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10
    count = Counter(w for i, t, _ in rows if fold(i) for w in words(t))
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t, _ in rows:
        w = words(t)
        want[i, fold(i) == 0, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out) == want
    assert all(r.score < 0 for r in out)
    assert op4_score.score_documents(empty).count() == 0


def test_score_of_untrained_corpus(spark):
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = op4_score.score_documents(table(spark, [(i, "a b", "s")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


def test_score_beats_counts_on_held_out_documents(spark):
    rnd = random.Random(2)
    tongues = [[f"{p}{i}" for i in range(60)] for p in ("un", "der", "qa", "zo")]
    rows = [(i, " ".join(rnd.choice(tongues[i % 4]) for _ in range(120)), "s") for i in range(300)]
    out = [r for r in op4_score.score_documents(table(spark, rows)).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def scores_step_by_step(rows, v, vector):
    """log10 probability of each row's text under the model of op4_score, one document and one token at a time, in 64 bits."""
    m = v.model().load(vector)
    p = {k: x.astype(np.float64) for k, x in m.p.items()}
    h = m.hidden
    sig = lambda x: 1 / (1 + np.exp(-x))
    soft = lambda x: x - x.max() - math.log(np.exp(x - x.max()).sum())
    out = []
    for t in rows:
        state, total, before = np.zeros(h), 0.0, None
        for w in op4_score.tokens(t):
            a = p["b"] + (p["emb"][before] @ p["w"] if before is not None else 0)
            g = state @ p["u"]
            z, r = sig(a[:h] + g[:h]), sig(a[h : 2 * h] + g[h : 2 * h])
            c = np.tanh(a[2 * h :] + r * g[2 * h :])
            state = state + z * (c - state)
            y = v.frequent.get(w)
            if y is None:
                y = int(v.of_suffix[op4_score.suffix(w)])
                n = v.index.get(w)
                total += math.log10((0 if n is None else v.every[w]) + 0.1) - v.inside[op4_score.suffix(w)]
            k = m.of[y]
            lo, hi = m.first[k], m.last[k]
            log = soft(state @ p["oc"] + p["bc"])[k]
            if hi - lo > 1:
                log += soft(p["ow"][lo:hi] @ state + p["bw"][lo:hi])[y - lo]
            total += log / math.log(10)
            before = y
        out.append(total)
    return out


def test_scores_are_the_models_step_by_step(spark, rows, monkeypatch):
    kept = {}
    score = op4_score.score

    def spy(encoded, sent, vector):
        kept.update(v=sent.value, vector=vector)
        return score(encoded, sent, vector)

    monkeypatch.setattr(op4_score, "score", spy)
    short = [(i, t, s) for i, t, s in rows if i != 50] + [(70, prose(random.Random(7), 3000), "a")]
    out = got(op4_score.score_documents(table(spark, short)), "doc_id", "score")
    v = kept["v"]
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10
    v.every = Counter(w for i, t, _ in short if fold(i) for w in op4_score.tokens(t))
    assert {*v.every} == {*v.index}
    want = sorted(zip([i for i, _, _ in short], scores_step_by_step([t for _, t, _ in short], v, kept["vector"])), key=repr)
    for (i, a), (j, b) in zip(sorted(out, key=lambda x: (repr(x[0]), x[1])), sorted(want, key=lambda x: (repr(x[0]), x[1]))):
        assert i == j and abs(a - b) < 1e-4 * (1 + abs(b))


def test_scores_dont_depend_on_partitions(spark):
    rnd = random.Random(12)
    docs = table(spark, [(i, prose(rnd, 150), "s") for i in range(200)])
    one, eight = (dict(got(op4_score.score_documents(docs.repartition(k)), "doc_id", "score")) for k in (1, 8))
    assert all(abs(one[i] - eight[i]) <= 1e-6 * abs(one[i]) for i in one)


def test_known_words_of_equal_counts(spark, monkeypatch):
    monkeypatch.setattr(op4_score, "KNOWN", 50)
    counts = spark.createDataFrame([(f"w{i}".encode(), 7 if i < 20 else 3) for i in range(500)], "word binary, c long")
    v = op4_score.learn(counts)
    assert {f"w{i}".encode() for i in range(20)} < {*v.index} and 30 <= v.known <= 70
    monkeypatch.setattr(op4_score, "KNOWN", 10)
    assert 0 < op4_score.learn(counts).known <= 20


def test_training_carries_the_state_over_whole_documents(spark, monkeypatch):
    docs = table(spark, [(3, "a b c d e " * 1000, "s")])
    v = op4_score.learn(op4_score.count_words(docs))
    (row,) = op4_score.encode(docs, spark.sparkContext.broadcast(v)).collect()
    seen, whole, gradient = [], gru.lanes, gru.Model.gradient
    monkeypatch.setattr(op4_score, "lanes", lambda docs, *a: (seen.append([len(d) for d in docs]), whole(docs, *a))[1])
    states = []
    monkeypatch.setattr(gru.Model, "gradient", lambda m, x, y, live, state: (states.append(state.copy()), gradient(m, x, y, live, state))[1])
    assert op4_score.fit(v.model(), [op4_score.numbers(row.ids)], 0.05) == 5001 and seen == [[5001]]
    assert len(states) == -(-5001 // op4_score.STEPS) and not states[0].any() and all(s.any() for s in states[1:])
    assert (op4_score.FREQUENT, op4_score.HIDDEN, op4_score.CLASSES) == (1023, 12, 32)


def test_model_is_a_distribution_and_gradient_is_right(monkeypatch):
    rng = np.random.default_rng(0)
    m = gru.Model(np.array([50, 30, 20, 10, 9, 5, 3, 2.0]), 6, 3)
    m.vector += rng.normal(0, 0.2, m.vector.shape).astype(np.float32)
    s = rng.normal(0, 0.5, (1, 6)).astype(np.float32)
    assert abs(sum(math.exp(m.logits(s, np.array([y]), False)[0][0]) for y in range(8)) - 1) < 1e-4
    monkeypatch.setattr(gru, "F4", np.float64)
    docs = [rng.integers(0, 8, k) for k in (5, 9, 3, 7)]
    for x, y, live, _, w in gru.lanes(docs, 3, 40):
        st = np.zeros((w, 6))
        g, _, _ = m.gradient(x, y, live, st)
        for i in rng.integers(0, len(m.vector), 60):
            v = m.vector[i]
            m.vector[i] = v + 1e-2
            a = m.window(x, y, live, st)[0].sum()
            m.vector[i] = v - 1e-2
            b = m.window(x, y, live, st)[0].sum()
            m.vector[i] = v
            assert abs((a - b) / 2e-2 / live.sum() - g[i]) < 3e-3


def test_lanes_carry_whole_documents():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 9, int(k)) for k in rng.integers(1, 90, 50)]
    seen = {k: [] for k in range(50)}
    for x, y, live, own, w in gru.lanes(docs, 8, 7):
        for t in range(len(y)):
            for j in range(w):
                if live[t, j]:
                    k = int(own[t, j])
                    assert x[t, j] == (seen[k][-1] if seen[k] else -1)
                    seen[k].append(int(y[t, j]))
    assert all(seen[k] == docs[k].tolist() for k in seen)


def test_decontamination(spark, docs, rows, empty):
    rnd = random.Random(3)
    by = dict((i, t) for i, t, _ in rows)
    items = [(1, by[0][10:220]), (10, " ".join(by[0].split()[30:75])), (2, "one TWO"), (3, None), (4, ""), (5, "..."), (6, prose(rnd, 20)), (7, "one two"), (8, "word " * 9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(op5_decontaminate.brute_force([(i, t) for i, t, _ in rows], items), key=repr)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    out = op5_decontaminate.contamination(docs, bench)
    assert got(out, *names) == want
    assert got(op5_decontaminate.contamination(docs, bench, block_bytes=60), *names) == want
    spans = {r.doc_id: r.spans for r in out.collect()}
    texts = {i: op5_decontaminate.words(t) for i, t in items}
    for i, found in spans.items():
        w = op5_decontaminate.words(by[i])
        for x in found:
            assert w[x.word : x.word + x.length] == texts[x.item_id][x.item_word : x.item_word + x.length]
    assert max(x.length for x in spans[0]) == 45 and not spans[30] and {r.doc_id: r.longest_match for r in out.collect()}[0] == 45
    left = op5_decontaminate.remove_contaminated(docs, bench)
    hit = {r[0] for r in want if r[3] and r[0] is not None}
    assert left.columns == docs.columns and hit >= {0, 20, 21, 23, 33, 34, 50}
    assert Counter(r.doc_id for r in left.collect()) == Counter(i for i, _, _ in rows if i not in hit)
    assert op5_decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert op5_decontaminate.contamination(empty, bench).count() == 0
    assert op5_decontaminate.remove_contaminated(empty, bench).count() == 0


def longest_by_hand(texts, docs, window):
    """(document, word) -> words of the longest match that begins there."""
    out = {}
    for d, doc in enumerate(docs):
        w = op5_decontaminate.words(doc)
        for p in range(len(w)):
            for x in map(op5_decontaminate.words, texts):
                need = min(window, len(x))
                for i in range(len(x) if len(x) >= window else min(1, len(x))):
                    m = 0
                    while i + m < len(x) and p + m < len(w) and x[i + m] == w[p + m]:
                        m += 1
                    if m >= need:
                        out[d, p] = max(m, out.get((d, p), 0))
    return out


def test_longest_matches_of_a_suffix_array():
    rnd = random.Random(3)
    for _ in range(120):
        v = [chr(97 + i) for i in range(rnd.choice([2, 3, 6]))] + ["zz"]
        mk = lambda n: " ".join(rnd.choice(v) for _ in range(n))
        items = op5_decontaminate.Items(rnd.choice([3, 8]))
        texts = [mk(rnd.choice([0, 1, 2, 8, 9, 12, 50])) for _ in range(4)]
        for k, t in enumerate(texts):
            items.add(k, t)
        items.freeze()
        docs = [mk(60) + " " + rnd.choice(texts) + " new " + rnd.choice(texts), mk(5), None, rnd.choice(texts)]
        flat, starts = [], []
        for t in docs:
            starts.append(len(flat))
            flat += [*(items.number.get(w, 0) for w in op5_decontaminate.words(t)), 0]
        flat = np.array(flat, np.int64)
        _, _, place, longest = op5_decontaminate.matches(flat, items)
        out = {}
        for p, n, q in zip(place.tolist(), *(longest.tolist() if len(place) else ([], []))):
            assert (items.flat[q : q + n] == flat[p : p + n]).all()
            d = max(k for k, a in enumerate(starts) if a <= p)
            out[d, p - starts[d]] = n
        assert out == longest_by_hand(texts, docs, items.window)


def test_suffix_array_is_sorted():
    rnd = np.random.default_rng(4)
    for top, n in ((1, 300), (3, 2000), (3000, 2000)):
        ids = rnd.integers(0, top + 1, n)
        ids[100:200] = ids[:100]
        a = op5_decontaminate.SuffixArray(ids, 256, top)
        tail = lambda p: ids[p : p + int(np.flatnonzero(np.append(ids[p:], 0) == 0)[0])].tolist()[:256]
        assert sorted(a.at.tolist()) == np.flatnonzero(ids).tolist()
        found = [tail(p) for p in a.at.tolist()]
        assert found == sorted(found)


def test_line_dedup(docs, rows, empty):
    known = [(i, t) for i, t, _ in rows if i is not None]
    holders = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    for i, t in known:
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    want = []
    for i, t, _ in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if i is None or len(key(x)) < 10 or len(holders[key(x)]) < 2 or i == min(holders[key(x)])]
        want.append((i, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert got(op6_lines.line_report(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=repr)
    out = op6_lines.dedup_lines(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r for r in out.collect()}
    assert texts[30].text is None and texts[31].text == "" and texts[20].text == "" and texts[20].n_chars == 0
    assert texts[41].text.count("host") == 1 and LINE not in texts[42].text and texts[42].text.startswith("short")
    assert op6_lines.line_report(empty).count() == 0
    many = "\n".join(f"line number {k} of the text" for k in range(50_000))
    long = {r.doc_id: r for r in op6_lines.line_report(table(empty.sparkSession, [(1, many, "a"), (2, many + "\nmore", "a")])).collect()}
    assert long[1].n_dropped == 0 and (long[2].n_lines, long[2].n_dropped, long[2].kept_sha256) == (50_001, 50_000, hashlib.sha256(b"more").hexdigest())
    three = {r.doc_id: r.text for r in op6_lines.dedup_lines(docs, min_docs=3).collect()}
    assert LINE in three[42] and three[23] == ""


def test_licenses(spark, docs, rows, empty):
    out = got(op7_licenses.scan_licenses(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    want = []
    for i, t, _ in rows:
        w = op7_licenses.words(t)
        at = sorted((k, label) for phrase, label in op7_licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        want.append((i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    assert out == sorted(want, key=repr)
    assert op7_licenses.scan_licenses(empty).count() == 0


@pytest.mark.parametrize(
    "text, labels",
    [
        ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0"}),
        ("licensed under the terms of the gnu general public license version 2", {"gpl-2.0"}),
        ("licensed under some GNU General Public License version 3", set()),
        ("Released under the MIT License.", {"mit-notice"}),
        ("Licensed under a Creative Commons CC BY-SA 4.0 licence", {"cc-by-sa-4.0"}),
        ("Neither the name of Acme, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", {"bsd-3-clause"}),
        ("Neither the name of " + "x " * 40 + "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", set()),
        ("all rights", set()),
    ],
)
def test_templates(text, labels):
    assert {h[0] for h in op7_licenses.Scanner(op7_licenses.TEMPLATES, op7_licenses.BASE).scan(text)[3]} == labels


def test_template_markup_errors():
    for bad in ("a [[ b", "a ]] b"):
        with pytest.raises(ValueError):
            op7_licenses.parse(bad)
    with pytest.raises(ValueError):
        op7_licenses.build("x", "[[a]] {{b}}", {})


def test_bpe_round_trip(docs, rows, empty):
    tok = tokenizers.Tokenizer.from_file(WORD)
    want = []
    for i, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got(op8_bpe.encode_decode(docs, WORD), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert op8_bpe.encode_decode(empty, WORD, keep=True).count() == 0


def test_speculation_equals_merging():
    c, rnd = op8_bpe.Codec(WORD), random.Random(1)
    words = ["".join(rnd.choice("aabeeilmnorst") for _ in range(rnd.randint(1, 14))) for _ in range(4000)]
    words += ["".join(rnd.choice(c.token[:20000]).replace("</w>", "") for _ in range(rnd.randint(1, 4))) for _ in range(8000)] + ["a" * k for k in range(1, 60)] + ["ha" * k for k in range(1, 40)]
    assert c.encode_words(words) == [c.exact(w) for w in words]


def test_every_character_that_takes_the_quick_way():
    c, e = op8_bpe.Codec(WORD), byte_bpe.Encoder(BYTE)
    quick = [ch for k in range(0x20, 0x10000) if not 0xD800 <= k < 0xE000 and not pieces.unsafe().match(ch := chr(k))]
    texts = [f"x{ch}Y{ch} {ch}1 '{ch}s" for ch in quick]
    assert e.encode_all(texts) == e.whole(texts)
    some = [t for t in texts[::3] if c.provable(t)]
    for t, (ids, text) in zip(some, c.encode_all(some)):
        want = c.tok.encode(t, add_special_tokens=False).ids
        assert ids.decode() == " ".join(map(str, want)) and text.decode() == c.tok.decode(want, skip_special_tokens=False)


PARA = "<p>" + "Long text of the real story goes on and on with many words. " * 4 + "</p>"
STORY = " ".join(["Long text of the real story goes on and on with many words."] * 4)


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<html><body><div id=nav><a href=1>x</a></div><div class='content'><h2>Title &amp; more</h2>{PARA}<div class='ad'>buy</div>{PARA}</div><div class=sidebar><ul><li>rel</ul></div><div id=comments><p>{'i think so ' * 30}</p></div><footer>f</footer></body></html>", f"Title & more\n\n{STORY}\n\n{STORY}"),
        (f"<body><div><div class=col>{PARA}</div><div class=col>{PARA}</div></div></body>", f"{STORY}\n\n{STORY}"),
        (f'<head><title>t</title><script>var t="</p>";</script></head><body><nav>menu</nav><article><h1>T</h1><p><b>one<br>two\n three<br><p>four</article><form>{PARA}</form>', "T\n\none two three\n\nfour"),
        ("plain  text &eacute;", "plain text é"),
        ("<p>a<script>if (a<b) { x('</p>') }</script>b", "ab"),
        ("<div class='cookie-notice'>we use</div><!-- <p>no</p> --><p>yes", "yes"),
        ("", ""),
        (None, ""),
        ("<a href='x>broken <p>text", "broken\n\ntext"),
        (f"<body><article>{PARA}<div class='social-science'><p>Kept.</p></div>{PARA}</article></body>", f"{STORY}\n\nKept.\n\n{STORY}"),
        (f"<body><div class=ad/>buy now</div><div class=x>{PARA}<p>see <a href=http://x.com/>this</a> too</p></div></body>", f"{STORY}\n\nsee this too"),
        (f"<body><div class=m><ul><li><a href=1>one</a><li><a href=2>two</a></ul></div><div class=x>{PARA}{PARA}<p>Short.</p></div></body>", f"{STORY}\n\n{STORY}\n\nShort."),
        (f"<body><div class=x>{PARA}<ul><li><a href=1>more</a><li><a href=2>links</a></ul>{PARA}</div></body>", f"{STORY}\n\n{STORY}"),
    ],
)
def test_main_text(html, text):
    assert op9_html.main_text(html).replace("unclosed", "broken") == text if "broken" not in (html or "") else op9_html.main_text(html).endswith("text")


def composite_by_hand(tree, k):
    """Density of node k by a plain walk of its subtree."""
    below = [j for j in range(len(tree.tag)) if j and tree.parent[j] == k and not tree.skip[j]]
    linked = lambda j: j > 0 and (tree.tag[j] == "a" or linked(tree.parent[j]))
    size = lambda j: sum(len("".join(t.split())) for i, t in tree.pieces if i == j and t is not None)

    def walk(j):
        c, t, lc, lt = size(j), 0, size(j) * linked(j), 0
        for i in range(1, len(tree.tag)):
            if tree.parent[i] == j and not tree.skip[i]:
                a, b, x, y = walk(i)
                c, t, lc, lt = c + a, t + b + 1, lc + x, lt + y + (tree.tag[i] == "a")
        return c, t, lc, lt

    every = sum(len("".join(t.split())) for _, t in tree.pieces if t is not None)
    links = sum(len("".join(t.split())) for i, t in tree.pieces if t is not None and linked(i))

    def dense(c, t, lc, lt):
        if not c:
            return 0.0
        t = max(1, t)
        base = math.log(c * lc / max(1, c - lc) + links / max(1, every) * c + math.e)
        inner = (c * t) / (max(1, lc) * max(1, lt))
        return c / t * math.log(inner, base) if base > 1 and inner > 1 else c / t - lc / t

    weigh = lambda j: op9_html.DOUBT if tree.doubt[j] else 1
    total = dense(size(k), 1, size(k) * (tree.tag[k] == "a"), 0) * weigh(k) + sum(dense(*walk(j)) * weigh(j) for j in below if tree.tag[j] != "a")
    return dense(*walk(k)) * weigh(k), total


def test_densities_against_a_plain_walk(spark):
    rnd = random.Random(6)

    def piece(d):
        if d > 3 or rnd.random() < 0.3:
            return "word " * rnd.randrange(6)
        t = rnd.choice(["div", "p", "a", "span", "section", "ul", "li", "div class=ad", "nav", "form"])
        return f"<{t}>{''.join(piece(d + 1) for _ in range(rnd.randrange(4)))}</{t.split()[0]}>"

    for _ in range(150):
        tree = op9_html.Tree("<body>" + "".join(piece(0) for _ in range(4)))
        found = tree.densities()
        by_hand = [composite_by_hand(tree, k) for k in range(len(tree.tag))]
        assert all(tree.skip[k] or abs(found[k] - by_hand[k][0]) < 1e-6 * (1 + found[k]) for k in range(len(found)))
        top, out = tree.article()
        core = max((k for k in range(len(found)) if not tree.skip[k]), key=lambda k: (round(by_hand[k][1], 6), -tree.depth[k], -k))
        up = {core}
        while core > 0:
            core = tree.parent[core]
            up.add(core)
        assert top in up and not out & {top}


def test_pages_table(spark):
    p = spark.createDataFrame([(1, "u", "<p>Tee &lt; x"), (None, None, None), (1, "u", "<p>Tee &lt; x"), (2, "v", "<p>" + "long " * 200_000)], "page_id long, url string, html string")
    out = got(op9_html.extract_pages(p), "page_id", "text", "n_chars")
    assert (1, "Tee < x", 7) in out and (None, "", 0) in out and out.count((1, "Tee < x", 7)) == 2 and (2, ("long " * 200_000).strip(), 999_999) in out
    assert op9_html.extract_pages(p.limit(0)).count() == 0


def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines, dup = set(), 0
    for x in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in lines
            lines.add(x)
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


def test_quality(spark, docs, rows, empty):
    rnd = random.Random(8)
    more = [*rows, *((200 + i, " ".join(rnd.choice("abc") for _ in range(60)), "z") for i in range(20)), (300, ("p q r s # * " * 40).strip(), "z"), (301, " ".join(rnd.choice("abcdefgh") for _ in range(900)), "z")]
    out = op10_quality.quality_report(table(spark, more))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got(out, *names) == sorted(((i, *brute_quality(t)) for i, t, _ in more), key=repr)
    assert all(not r.kept for r in out.collect() if r.base_failed)
    assert op10_quality.quality_report(empty).count() == 0


def brute_boilerplate(rows, share=op10_quality.SHARE, few=op10_quality.FEW):
    """For rows (doc_id, text, host): words and kept text (None if rejected), by plain loops."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    holders, hosts = {}, {}
    for _, t, h in rows:
        hosts.setdefault(h, set()).add(t or "")
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders.setdefault((h, key(x)), set()).add(t or "")
    out = []
    for i, t, h in rows:
        lines = (t or "").split("\n")
        gone = [i is not None and (n := len(holders.get((h, key(x)), ()))) > few and n > share * len(hosts[h]) for x in lines]
        w = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        less = sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x, g in zip(lines, gone) if g)
        good = not brute_quality(t)[-1] and 2 * less <= w and (not less or w - less >= 50)
        out.append((i, less, sum(gone), good, "\n".join(x for x, g in zip(lines, gone) if not g) if good else None))
    return out


def boilerplate_rows():
    rnd = random.Random(4)
    rows = [(i, "\n".join([LINE] * 9 + [prose(rnd, 20)]), "h") for i in range(30)]
    rows += [(100 + i, f"{LINE}\n{prose(rnd, 70)}\n\n  {LINE.upper()}\nend", "h") for i in range(40)]
    rows += [(200 + i, LINE + "\n" + prose(rnd, 49), "h") for i in range(3)]
    rows += [(300 + i, LINE + "\n" + prose(rnd, 70), "other") for i in range(5)] + [(400, LINE + "\n" + prose(rnd, 70), None), (None, LINE + "\n" + prose(rnd, 70), "h")]
    same = prose(rnd, 60) + "\nThese are copies of one text.\n" + prose(rnd, 60)
    return rows + [(500 + i, same, "h") for i in range(30)] + [(600, None, "h"), (601, "", None), (602, "\n".join(["a line of many words here"] * 30_000) + prose(rnd, 90_000), "h")]


def test_boilerplate_of_a_host(spark):
    rows = boilerplate_rows()
    docs = table(spark, rows)
    want = brute_boilerplate(rows)
    assert got(op10_quality.quality_report(docs), "doc_id", "n_boilerplate_words", "n_boilerplate_lines", "kept") == sorted((w[:4] for w in want), key=repr)
    kept = op10_quality.keep_good(docs)
    assert kept.columns == docs.columns
    out = kept.collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted(((w[0], w[4]) for w in want if w[3]), key=repr)
    assert all(r.n_chars == len(r.text) for r in out)
    assert {r.doc_id for r in out} == {*range(100, 140), *range(300, 305), 400, None, *range(500, 530)}


def test_repeated_rows_change_no_verdict(spark):
    rows = [r for r in boilerplate_rows() if r[0] != 602]
    once = {r.doc_id: r for r in op10_quality.quality_report(table(spark, rows)).collect()}
    thrice = op10_quality.quality_report(table(spark, rows * 3)).collect()
    assert len(thrice) == 3 * len(rows) and all(r == once[r.doc_id] for r in thrice)
    # One id with two texts: each row has its own words.
    two = rows + [(100, prose(random.Random(1), 90), "h")]
    assert sorted(r.n_boilerplate_lines for r in op10_quality.quality_report(table(spark, two)).collect() if r.doc_id == 100) == [0, 2]


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: Cluster.conf)})

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Cluster)


def test_native_operators_have_no_python(docs):
    for df in (op6_lines.line_report(docs), op10_quality.quality_report(docs)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())
