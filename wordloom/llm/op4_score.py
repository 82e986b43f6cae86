"""Log-likelihood of whole documents under a gated recurrent language model that is trained on the corpus.

Counts of all training words are made first. The FREQUENT most frequent words are tokens of the model; every other word is
one of SUFFIXES tokens by its last two bytes, within which its probability comes from the counts. So the model gives a
probability to every word there can be, known or not, and the score is a proper log probability.

Documents are turned into token numbers once, and these are written. Training documents fall into shards by a hash of
doc_id; how many there are depends on their tokens alone, and within a shard documents are in the order of their ids. So the model
doesn't depend on how files or partitions were cut, and a lost task repeats exactly what it did. Each shard is
trained on once, by truncated back-propagation with Adagrad, in two rounds: a tenth of the documents from the unigram model on,
then all others from the average of the first round's models. Averages weigh each shard's parameters by its tokens;
they are summed as integers, whose sum has no order.

Frequencies of the KNOWN most frequent words are sent to the tasks (a bounded table). Rarer words, a few per cent
of all, are counted by document and joined to the counts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small_batches
from .gru import Adagrad, Model, lanes

END = b"\n"
FREQUENT, SUFFIXES, KNOWN = 1023, 64, 150_000
HIDDEN, CLASSES, LANES, STEPS = 12, 32, 512, 32
#: Tokens of a training shard (about) and of the documents that are scored side by side, and distinct words that a task
#: counts before it hands them on.
SHARD, BLOCK, FLUSH = 1_000_000, 4_000_000, 400_000
#: Parameters are averaged to this precision.
UNIT = 1 << 24
LOG10 = math.log(10)


def tokens(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only: A-Z, and the six blanks."""
    words = text.encode().lower().split() if text else []
    words.append(END)
    return words


def suffix(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SUFFIXES


def fold() -> Column:
    """0 for held-out documents, 1 to 9 for training ones; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10


def count_words(docs: DataFrame) -> DataFrame:
    """word, c over all tokens of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.binary()), "c": pa.array(counts.values(), pa.int64())})

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(tokens(text))
            if len(counts) > FLUSH:
                yield rows()
                counts.clear()
        yield rows()

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What the tasks need: the known words in falling order of count, token numbers, and log probabilities."""

    def __init__(self, known: list[tuple[bytes, int]], total: int, distinct: int, by_suffix: dict[int, tuple[int, int]]):
        self.total, self.distinct = total, distinct
        self.index = {w: i for i, (w, _) in enumerate(known)}
        frequent = [w for w, _ in known[:FREQUENT]]
        counts = dict(known)
        if END not in frequent:
            frequent = [*frequent[: FREQUENT - 1], END]
        mass, kinds = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
        for s, (c, v) in by_suffix.items():
            mass[s], kinds[s] = c, v
        for w in frequent:
            if w in counts:
                mass[suffix(w)] -= counts[w]
                kinds[suffix(w)] -= 1
        every = sorted([*((counts.get(w, 0), 0, w) for w in frequent), *((int(mass[s]), 1, s) for s in range(SUFFIXES))], key=lambda x: (-x[0], x[1], x[2] if x[1] else 0, b"" if x[1] else x[2]))
        self.counts = np.array([c for c, _, _ in every], np.float64)
        self.frequent = {x: t for t, (_, kind, x) in enumerate(every) if not kind}
        self.of_suffix = np.zeros(SUFFIXES, np.int64)
        for t, (_, kind, x) in enumerate(every):
            if kind:
                self.of_suffix[x] = t
        self.inside = np.log10(mass + 0.1 * (kinds + 1))
        self.base = math.log10(total + 0.1 * (distinct + 1))
        n = len(known)
        self.token = np.empty(n + SUFFIXES, np.int32)
        self.log_base, self.log_inside = np.zeros(n + SUFFIXES), np.zeros(n + SUFFIXES)
        for i, (w, c) in enumerate(known):
            self.log_base[i] = math.log10(c + 0.1) - self.base
            if w in self.frequent:
                self.token[i] = self.frequent[w]
            else:
                self.token[i] = self.of_suffix[suffix(w)]
                self.log_inside[i] = math.log10(c + 0.1) - self.inside[suffix(w)]
        self.token[n:] = self.of_suffix
        self.known = n

    def numbers(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """A number for each word (its place among the known ones, or after these its suffix), and the words that aren't known."""
        got = list(map(self.index.get, words))
        if None not in got:
            return np.array(got, np.int64), []
        rare = [w for w, i in zip(words, got) if i is None]
        n = self.known
        return np.array([(n + suffix(w)) if i is None else i for w, i in zip(words, got)], np.int64), rare

    def model(self) -> Model:
        return Model(self.counts, HIDDEN, CLASSES)


def learn(counts: DataFrame) -> Vocabulary:
    """Reads the bounded tables off the counts: the KNOWN most frequent words or, where the last of them are as frequent as
    others, part of these by a hash."""
    total = counts.agg(F.sum("c"), F.count("*")).first()
    # From how often each count occurs: the least count all of whose words fit, and how many places are left for the next one.
    often = counts.groupBy("c").agg(F.count("*").alias("words")).withColumn("above", F.sum("words").over(Window.orderBy(F.desc("c"))))
    fit = often.filter(F.col("above") <= KNOWN).agg(F.min("c"), F.max("above")).first()
    least, taken = fit[0] if fit[0] is not None else float("inf"), fit[1] or 0
    wanted = F.col("c") >= least
    if after := often.filter(F.col("above") > KNOWN).orderBy(F.desc("c")).first():
        share = int((KNOWN - taken) / after.words * 0.9 * (1 << 20))
        wanted |= (F.col("c") == after.c) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < share)
    top = sorted(counts.filter(wanted).toLocalIterator(), key=lambda r: (-r.c, r.word))
    by = counts.groupBy((F.crc32(F.substring("word", -2, 2)) % SUFFIXES).alias("s")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    return Vocabulary([(bytes(r.word), r.c) for r in top], total[0] or 0, total[1], {r.s: (r.c, r.v) for r in by})


def encode(docs: DataFrame, sent) -> DataFrame:
    """Per row: doc_id, ids (token numbers as unsigned 16-bit integers), n_tokens, how many are known, the sums over known words
    of the base and of what the model leaves to counts, and the rarer words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = sent.value
        for batch in batches:
            part = []
            for text in batch.column(1).to_pylist():
                words = tokens(text)
                at, rare = v.numbers(words)
                ids = v.token[at].astype("<u2")
                if END not in v.index:
                    ids[-1] = v.frequent[END]
                part.append((ids.tobytes(), len(words), len(words) - len(rare), float(v.log_base[at].sum()), float(v.log_inside[at].sum()), [{"word": w, "k": k} for w, k in Counter(rare).items()]))
            ids, n, known, base, inside, rare = zip(*part) if part else [()] * 6
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "ids": pa.array(ids, pa.binary()),
                    "n_tokens": pa.array(n, pa.int64()),
                    "known": pa.array(known, pa.int64()),
                    "base": pa.array(base, pa.float64()),
                    "inside": pa.array(inside, pa.float64()),
                    "rare": pa.array(rare, pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())]))),
                }
            )

    assert FREQUENT + SUFFIXES < 1 << 16
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, n_tokens long, known long, base double, inside double, rare array<struct<word:binary,k:long>>")


def numbers(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2").astype(np.int32)


def fit(model: Model, docs: list[np.ndarray], rate: float) -> int:
    """Trains the model on whole documents, each from its first token to its last; how many tokens there were."""
    steps, state = Adagrad(model, rate), None
    for x, y, live, _, width in lanes(docs, LANES, STEPS):
        state = np.zeros((width, HIDDEN), np.float32) if state is None else state[:width]
        g, state, _ = model.gradient(x, y, live, state)
        steps.step(g)
    return sum(map(len, docs))


def train(encoded: DataFrame, tokens: int, sent, start: np.ndarray, rate: float) -> np.ndarray:
    """The average, by tokens, of the models that the shards of encoded documents (of about that many tokens) train from
    `start`; start itself where there are no documents."""
    shards = max(1, -(-tokens // SHARD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = sent.value
        model = v.model()
        total, done, now, docs = np.zeros(len(start), np.int64), 0, None, []

        def finish() -> None:
            nonlocal total, done
            if docs:
                n = fit(model.load(start), docs, rate)
                total += np.rint(model.vector.astype(np.float64) * UNIT).astype(np.int64) * n
                done += n

        for batch in batches:
            for shard, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard != now:
                    finish()
                    now, docs = shard, []
                docs.append(numbers(ids))
        finish()
        if done:  # in two halves, so that no sum of these gets too large
            yield pa.RecordBatch.from_pydict({"w": pa.array([done]), "v": pa.array([np.stack([total >> 24, total & (UNIT - 1)], 1).ravel()], pa.list_(pa.int64()))})

    of = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(shards))
    dealt = encoded.select(of.alias("shard"), "doc_id", "ids").repartition(min(shards, 4096), "shard").sortWithinPartitions("shard", "doc_id", "ids")
    each = dealt.select("shard", "ids").mapInArrow(run, "w long, v array<long>").select("w", F.posexplode("v").alias("i", "x"))
    rows = each.groupBy("i").agg(F.sum("x").alias("x"), F.sum("w").alias("w")).orderBy("i").collect()
    if not rows:
        return start
    return np.array([((a.x << 24) + b.x) / (a.w * UNIT) for a, b in zip(rows[::2], rows[1::2])], np.float32)


def score(encoded: DataFrame, sent, vector: np.ndarray) -> DataFrame:
    """row and score of every encoded row: the natural log probability of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value.model().load(vector)

        def rows(keys: list, docs: list) -> pa.RecordBatch:
            total, state = np.zeros(len(docs)), None
            for x, y, live, owner, width in lanes(docs, LANES, STEPS):
                state = np.zeros((width, HIDDEN), np.float32) if state is None else state[:width]
                log, state = model.window(x, y, live, state)
                total += np.bincount(owner[live], log[live].astype(np.float64), len(docs))
            return pa.RecordBatch.from_pydict({"row": pa.array(keys, pa.int64()), "score": pa.array(total)})

        keys, docs, n = [], [], 0
        for batch in batches:
            keys += batch.column(0).to_pylist()
            docs += [numbers(x) for x in batch.column(1).to_pylist()]
            n += sum(map(len, docs[len(docs) - batch.num_rows :]))
            if n >= BLOCK:
                yield rows(keys, docs)
                keys, docs, n = [], [], 0
        if keys:
            yield rows(keys, docs)

    return encoded.select("row", "ids").mapInArrow(run, "row long, score double")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10) of every row.

    Tokens are words between blanks, A-Z lowered, and one end. Documents whose crc32(doc_id as text) mod 10 is 0 are held
    out of all counts and training; a null doc_id counts as the empty text, which is held out. Null and empty texts have only the
    end. Repeated rows are counted, trained on and scored one by one. The scores don't depend on partitions or their order. Without training documents every base probability is
    one and the model stays as it starts. An empty table gives no rows; other columns aren't read."""
    spark = docs.sparkSession
    small_batches(spark)
    some = docs.select("doc_id", "text")
    counts = saved(count_words(some.filter(fold() != 0)))
    v = learn(counts)
    sent = spark.sparkContext.broadcast(v)
    main = saved(encode(some, sent).withColumn("row", F.monotonically_increasing_id()))
    vector = train(main.filter(fold() == 1), v.total // 9, sent, v.model().vector.copy(), 0.1)
    vector = train(main.filter(fold() > 1), v.total - v.total // 9, sent, vector, 0.05)
    scored = saved(score(main, sent, vector))
    words = main.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.k").alias("k"))
    inside = F.element_at(F.lit(v.inside.tolist()), (F.crc32(F.substring("word", -2, 2)) % SUFFIXES + 1).cast("int"))
    log = F.log10(F.coalesce("c", F.lit(0)) + 0.1)
    end = F.col("word") == F.lit(END)
    extra = words.join(counts, "word", "left").groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * (log - v.base)).alias("b"), F.sum(F.when(end, 0.0).otherwise(F.col("k") * (log - inside))).alias("s"))
    out = main.select("row", "doc_id", "n_tokens", "known", "base", "inside").join(scored, "row").join(extra, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("doc_id", (fold() == 0).alias("held_out"), "n_tokens", (F.col("known") + zero("more")).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"), (F.col("base") + zero("b")).alias("base_score"), (F.col("score") / LOG10 + F.col("inside") + zero("s")).alias("score"))
