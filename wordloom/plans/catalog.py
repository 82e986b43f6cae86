"""Queries over the driver's tables and the DuckDB SQL that gives the same rows.

documents are the corpus, benchmark items are queries and, as words, the lexicon's entries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import text as T
from ..operators import index as I
from ..operators import pattern as P
from ..operators import relations as R
from ..operators import search as S
from ..operators.rounds import kept

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Tables of fewer bytes than this are worth spreading over the cores.
SMALL = 256 << 20


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    """A table. A small one of fewer files than cores is spread over the cores, since its one row group would be one task; a
    large one is never shuffled for that."""
    df = s.read.parquet(f"{d}/{name}.parquet")
    cores = s.sparkContext.defaultParallelism
    if name != "documents" or len(df.inputFiles()) >= cores or int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > SMALL:
        return df
    return df.repartition(cores)


def words(s: SparkSession, d: str) -> DataFrame:
    """q: the distinct words of all benchmark items."""
    return table(s, d, "benchmark").select(F.explode(T.split_words(F.col("text"))).alias("q")).distinct()


def terms(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.explode(T.split_words(F.col("text"))).alias("term")).distinct()


def heads(s: SparkSession, d: str) -> DataFrame:
    """term, doc: the words of all conversations as entries, one record a conversation."""
    r = table(s, d, "conversations")
    return r.select(F.explode(T.split_words(F.col("text"))).alias("term"), F.col("conv_id").alias("doc")).distinct()


# The same building blocks in SQL. chr(…) keeps quotes and blanks readable.
SEP = T.SEPARATORS.removeprefix("(?U)")  # no-break and wide spaces are plain ones by then
FOLD = "translate(lower({0}), '`´‘’ʼǝ' || chr(12288) || chr(160), repeat(chr(39), 5) || 'ə  ')"
BASE = r"trim(regexp_replace(" + FOLD + r", '\s+', ' ', 'g'))"
KEY = r"trim(regexp_replace(translate({0}, '-=<>…~*', ''), '\s+', ' ', 'g'))"
RAW = f"string_split_regex({BASE.format('{0}')}, '{SEP}')"


def split_sql(c: str) -> str:
    return f"list_filter(list_transform({RAW.replace('{0}', c)}, lambda w: {KEY.format('w')}), lambda w: w <> '')"


def tokens_sql(c: str) -> str:
    parts = f"CASE WHEN regexp_matches(w, '[-=~<>]+') THEN list_filter(list_transform(string_split_regex(w, '[-=~<>]+'), lambda p: {KEY.format('p')}), lambda p: length(p) >= 2) ELSE [] END"
    return f"list_distinct(list_filter(flatten(list_transform({RAW.replace('{0}', c)}, lambda w: list_concat([{KEY.format('w')}], {parts}))), lambda w: w <> ''))"


WORDS = f"words AS (SELECT DISTINCT unnest({split_sql('text')}) AS q FROM benchmark)"
TERMS = f"terms AS (SELECT DISTINCT unnest({split_sql('text')}) AS term FROM documents)"
LINES = r"""records AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
classed AS (SELECT *, CASE WHEN regexp_matches(t, '^-|-$') OR regexp_matches(t, '^<[^>]+>$') THEN 'affix' WHEN regexp_matches(t, '[.!?。！？][”"’' || chr(39) || ')）]*$') OR n >= 3 THEN 'sentence' WHEN n >= 2 THEN 'phrase' ELSE 'word' END AS unit
  FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS n FROM records) WHERE trim(text) <> '')"""
HEADS = f"heads AS (SELECT DISTINCT unnest({split_sql('text')}) AS term, conv_id AS doc FROM conversations)"
PARTIAL = """hits AS (SELECT q, term, CASE WHEN starts_with(term, q) THEN 'prefix' WHEN ends_with(term, q) THEN 'suffix' ELSE 'substring' END AS match_type FROM words JOIN lex ON contains(term, q) AND term <> q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY CASE match_type WHEN 'prefix' THEN 0 ELSE 1 END, length(term), term) AS rank FROM hits),
partial AS (SELECT q, term, match_type, rank, round(least(length(term) - length(q), 12) * 0.05 + CASE match_type WHEN 'prefix' THEN 0.35 ELSE 0.9 END, 9)::DOUBLE AS score FROM ranked WHERE rank <= 300)"""
ENTRIES = f"""{WORDS}, {HEADS}, lex AS (SELECT DISTINCT term FROM heads WHERE term <> ''), {PARTIAL},
matches AS (SELECT q, term, match_type, score FROM partial UNION ALL SELECT q, q, 'fuzzy', 0.0::DOUBLE FROM words WHERE q IN (SELECT term FROM lex)),
placed AS (SELECT q, doc, heads.term, match_type, score, row_number() OVER (PARTITION BY q, doc ORDER BY score, CASE match_type WHEN 'fuzzy' THEN 0 WHEN 'prefix' THEN 1 WHEN 'suffix' THEN 5 ELSE 6 END, length(heads.term), heads.term) AS n FROM matches JOIN heads ON matches.term = heads.term),
entry AS (SELECT q, doc, term, match_type, score FROM placed WHERE n = 1)"""


@query(f"SELECT doc_id, len({split_sql('text')}) AS n_tokens, len({tokens_sql('text')}) AS n_distinct FROM documents")
def tokens_by_doc(s, d):
    return table(s, d, "documents").select("doc_id", F.size(T.split_words(F.col("text"))).cast("long").alias("n_tokens"), F.size(T.tokenize(F.col("text"))).cast("long").alias("n_distinct"))


@query(f"WITH t AS (SELECT DISTINCT unnest({tokens_sql('text')}) AS term FROM documents) SELECT row_number() OVER (ORDER BY term) - 1 AS term_id, term FROM t")
def lexicon_ranked(s, d):
    return I.lexicon(I.token_postings(table(s, d, "documents")))


@query(f"SELECT DISTINCT unnest({tokens_sql('text')}) AS term, doc_id AS doc, 'token' AS kind, doc_id * 5 + 4 AS code FROM documents")
def postings_token(s, d):
    return I.postings(texts=table(s, d, "documents").select("text", F.col("doc_id").alias("doc")))


@query(f"WITH {WORDS}, {TERMS}, lex AS (SELECT term FROM terms), {PARTIAL} SELECT q, term, match_type, rank::INTEGER AS rank, score FROM partial")
def partial_matches(s, d):
    return I.partial_matches(words(s, d), terms(s, d))


@query(f"WITH {WORDS} SELECT q, 0.0::DOUBLE AS max_exact, round(greatest(0.3, least(0.2 + 0.15 * length(q), 1.6)), 9)::DOUBLE AS max_normal, round(greatest(0.8, least(0.5 + 0.25 * length(q), 3.0)), 9)::DOUBLE AS max_loose, round(least(1.0, greatest(0.3, least(0.2 + 0.15 * length(q), 1.6)) + 0.6), 9)::DOUBLE AS max_lemma FROM words")
def fuzziness_levels(s, d):
    return words(s, d).withColumns(I.thresholds(F.col("q")))


@query(f"WITH {ENTRIES} SELECT q, doc, term, match_type, score FROM entry")
def entries_best(s, d):
    h = kept(heads(s, d))
    return S.entries(S.term_matches(words(s, d), h.select("term").distinct()), h).drop("distance")


@query(f"WITH {ENTRIES}, m AS (SELECT q, doc, CASE match_type WHEN 'fuzzy' THEN 'exact' ELSE match_type END AS method FROM entry), g AS (SELECT *, CASE method WHEN 'exact' THEN 'spelling' ELSE 'partial' END AS grp FROM m) SELECT q, 'method' AS grouping, method AS name, count(DISTINCT doc) AS docs FROM g GROUP BY q, method UNION ALL SELECT q, 'group', grp, count(DISTINCT doc) FROM g GROUP BY q, grp")
def method_counts(s, d):
    h = kept(heads(s, d))
    return S.tally(S.entries(S.term_matches(words(s, d), h.select("term").distinct()), h))


@query(f"WITH {ENTRIES}, c AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score, CASE match_type WHEN 'fuzzy' THEN 0 WHEN 'prefix' THEN 1 WHEN 'suffix' THEN 5 ELSE 6 END, length(term), term, doc) AS place FROM entry) SELECT q, doc, term, match_type, score, place::INTEGER AS place FROM c WHERE place <= 20")
def capped_results(s, d):
    h = kept(heads(s, d))
    return S.capped(S.entries(S.term_matches(words(s, d), h.select("term").distinct()), h).drop("distance"), 20)


@query(f"""WITH w AS (SELECT item_id AS qid, unnest({split_sql('text')}) AS term FROM benchmark), need AS (SELECT qid, count(*) AS n_words, count(DISTINCT term) AS n_distinct FROM w GROUP BY qid),
p AS (SELECT DISTINCT unnest({split_sql('text')}) AS term, doc_id AS doc FROM documents), f AS (SELECT qid, doc, count(*) AS k FROM (SELECT DISTINCT qid, term FROM w) w JOIN p ON w.term = p.term GROUP BY qid, doc)
SELECT f.qid, f.doc, n_words, n_distinct FROM f JOIN need ON f.qid = need.qid AND f.k = need.n_distinct""")
def occurrences_all_words(s, d):
    tokens = table(s, d, "documents").select(F.explode(F.array_distinct(T.split_words(F.col("text")))).alias("term"), F.col("doc_id").alias("doc"))
    return S.occurrences(table(s, d, "benchmark").select(F.col("item_id").alias("qid"), "text"), tokens)


@query("SELECT d.doc_id, d.source, d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.source IN ('src0', 'src1', 'src2') AND d.lang IN ('en', 'de') AND l.quality = 1")
def doc_filter(s, d):
    docs = table(s, d, "documents").select("doc_id", "source", "lang").join(table(s, d, "labels").select("doc_id", "quality", F.col("quality").cast("string").alias("status")), "doc_id")
    return S.doc_filter(docs, ["src0", "src1", "src2"], ["en", "de"], ["1"]).drop("status")


@query("WITH e AS (SELECT r_name AS parent, n_name AS child FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT parent AS code, parent AS member FROM e UNION SELECT child, child FROM e UNION SELECT parent, child FROM e")
def variety_closure(s, d):
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return R.closure(n.select(F.col("r_name").alias("parent"), F.col("n_name").alias("child")))


@query(f"SELECT p_partkey, {KEY.format(BASE.format('p_name'))} AS key, (SELECT count(*) FROM part) AS total FROM part ORDER BY key, p_partkey LIMIT 50 OFFSET 20")
def list_page(s, d):
    return S.page(table(s, d, "part").select("p_partkey", T.search_key(F.col("p_name")).alias("key")), ["key", "p_partkey"], 20, 50)


@query(f"WITH {LINES} SELECT unit, count(*) AS n, count(DISTINCT doc_id) AS docs FROM classed GROUP BY unit")
def unit_class(s, d):
    return I.line_records(table(s, d, "documents")).groupBy("unit").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(f"WITH {LINES} SELECT source, count(*) AS records, count(DISTINCT doc_id) AS groups, " + ", ".join(f"count(*) FILTER (WHERE unit = '{u}') AS {u}" for u in ("affix", "word", "phrase", "sentence")) + " FROM classed GROUP BY source")
def source_stats(s, d):
    return R.source_stats(I.line_records(table(s, d, "documents")))


@query("""SELECT 'duplicate id' AS issue, o_custkey AS id, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1
UNION ALL SELECT 'missing parent', o_custkey, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') GROUP BY o_custkey""")
def referential_issues(s, d):
    return R.issues(table(s, d, "orders"), "o_custkey", "o_custkey", table(s, d, "customer").filter("c_mktsegment <> 'BUILDING'"), "c_custkey")


UNTREATED = f"""{WORDS}, p AS (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents), u AS (SELECT term, count(DISTINCT doc_id) AS n FROM p WHERE regexp_matches(term, '[\\p{{L}}\\p{{N}}]') AND term NOT IN (SELECT q FROM words) GROUP BY term)"""


@query(f"WITH {UNTREATED} SELECT term, n FROM u")
def untreated_tokens(s, d):
    return R.treated(I.token_postings(table(s, d, "documents"))).join(words(s, d).withColumnRenamed("q", "term"), "term", "left_anti")


@query(f"WITH {UNTREATED} SELECT term, n, (SELECT count(*) FROM u) AS total FROM u ORDER BY n DESC, term LIMIT 30 OFFSET 30")
def untreated_page(s, d):
    return S.page(untreated_tokens(s, d), [F.desc("n"), "term"], 30, 30)


DUPLICATES = r"dup AS (SELECT text, count(*) AS n, count(DISTINCT source) AS sources FROM (SELECT trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, source FROM documents) WHERE text <> '' GROUP BY text HAVING count(*) > 1)"


@query(f"WITH {DUPLICATES} SELECT md5(text) AS text_md5, n, sources, sources < n AS same_source, sources > 1 AS cross_source FROM dup")
def duplicate_texts(s, d):
    return R.duplicates(table(s, d, "documents"), T.collapse(F.col("text"))).select(F.md5(F.encode("text", "UTF-8")).alias("text_md5"), "n", "sources", "same_source", "cross_source")


@query(f"WITH {UNTREATED}, {DUPLICATES} SELECT (SELECT count(*) FROM documents) AS records, (SELECT count(DISTINCT term) FROM p WHERE regexp_matches(term, '[\\p{{L}}\\p{{N}}]')) AS tokens, (SELECT count(*) FROM u) AS untreated, (SELECT count(*) FROM dup) AS duplicates")
def quality_summary(s, d):
    docs = table(s, d, "documents")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    tokens = kept(R.treated(I.token_postings(docs)))
    untreated = tokens.join(words(s, d).withColumnRenamed("q", "term"), "term", "left_anti")
    return one(docs, "records").crossJoin(one(tokens, "tokens")).crossJoin(one(untreated, "untreated")).crossJoin(one(duplicate_texts(s, d), "duplicates"))


@query(f"""WITH {WORDS}, l AS (SELECT doc_id, {split_sql('text')} AS ws FROM documents), e AS (SELECT doc_id AS doc, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM l),
c AS (SELECT *, concat_ws(' ', lag(word, 1) OVER o, lag(word, 2) OVER o, lag(word, 3) OVER o) AS left, concat_ws(' ', lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o) AS right FROM e WINDOW o AS (PARTITION BY doc ORDER BY pos))
SELECT doc, pos::INTEGER AS pos, word, left, right FROM c WHERE word IN (SELECT q FROM words)""".replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"').replace("word, left, right FROM", 'word, "left", "right" FROM'))
def kwic(s, d):
    """The contexts of every benchmark word."""
    return S.kwic(table(s, d, "documents"), words(s, d).withColumnRenamed("q", "word"))


@query(f"""WITH l AS (SELECT doc_id, {split_sql('text')} AS ws FROM documents), e AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM l), p AS (SELECT doc_id, w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS gram FROM e)
SELECT gram, count(*) AS count, count(DISTINCT doc_id) AS docs FROM p WHERE gram IS NOT NULL GROUP BY gram ORDER BY count DESC, docs DESC, gram LIMIT 100""")
def bigram_frequency(s, d):
    return S.ngram_frequency(table(s, d, "documents"), 2).orderBy(F.desc("count"), F.desc("docs"), "gram").limit(100)


SEQ = f"""x AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, {split_sql('text')} AS ws FROM documents)),
y AS (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT item_id, {split_sql('text')} AS ws FROM benchmark)),
dx AS (SELECT doc_id, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS gram FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
by AS (SELECT DISTINCT w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS gram FROM y WINDOW o AS (PARTITION BY item_id ORDER BY pos))"""


@query(f"WITH {SEQ} SELECT gram, count(*) AS count, count(DISTINCT doc_id) AS docs FROM dx WHERE gram IN (SELECT gram FROM by WHERE gram IS NOT NULL) GROUP BY gram".replace(" by AS", " bench AS").replace("\nby AS", "\nbench AS").replace("FROM by WHERE", "FROM bench WHERE"))
def exact_sequence(s, d):
    wanted = S.ngram_frequency(table(s, d, "benchmark").withColumnRenamed("item_id", "doc_id"), 3).select("gram")
    return S.ngram_frequency(table(s, d, "documents"), 3).join(wanted, "gram", "left_semi")


AFFIX = "aff(kind, form) AS (VALUES " + ", ".join(f"('{k}', '{f}')" for k, f in R.AFFIXES) + ")"
STRIP = """z AS (SELECT term AS word, term AS stem, 0 AS n, NULL::VARCHAR AS last FROM terms),
o AS (SELECT word, CASE kind WHEN 'prefix' THEN substr(stem, length(form) + 1) ELSE substr(stem, 1, length(stem) - length(form)) END AS stem, 1 AS n, kind AS last FROM z JOIN aff ON ((kind = 'prefix' AND starts_with(stem, form)) OR (kind = 'suffix' AND ends_with(stem, form))) AND length(stem) - length(form) >= 3),
t AS (SELECT word, CASE kind WHEN 'prefix' THEN substr(stem, length(form) + 1) ELSE substr(stem, 1, length(stem) - length(form)) END AS stem, 2 AS n, kind AS last FROM o JOIN aff ON ((kind = 'prefix' AND starts_with(stem, form)) OR (kind = 'suffix' AND ends_with(stem, form))) AND length(stem) - length(form) >= 3 AND kind <> last),
parses AS (SELECT word, stem, min(n) AS n FROM (SELECT * FROM z UNION ALL SELECT * FROM o UNION ALL SELECT * FROM t) GROUP BY word, stem)"""


def affixes(s):
    return s.createDataFrame(R.AFFIXES, "kind string, form string")


@query(f"WITH {AFFIX}, {TERMS}, {STRIP} SELECT word, stem, n::INTEGER AS n FROM parses")
def affix_strip(s, d):
    return R.strip_affixes(terms(s, d).withColumnRenamed("term", "word"), affixes(s))


COSTED = "costed AS (SELECT p.word, p.stem, round(p.n * 0.3 + least(length(regexp_replace(p.stem, '[^aeiou]', '', 'g')), 3) * 0.05, 9)::DOUBLE AS cost FROM parses p JOIN terms ON p.stem = terms.term WHERE p.n > 0)"


def parses(s, d):
    """word, stem, cost: analyses whose stem is in the lexicon."""
    p = affix_strip(s, d).filter("n > 0").join(terms(s, d).withColumnRenamed("term", "stem"), "stem", "left_semi")
    return p.select("word", "stem", F.round(F.col("n") * 0.3 + T.root_cost(F.col("stem"), "aeiou", [0.0, 0.05, 0.1, 0.15]), 9).alias("cost"))


@query(f"WITH {AFFIX}, {TERMS}, {STRIP}, {COSTED}, b AS (SELECT *, min(cost) OVER (PARTITION BY word) AS best FROM costed) SELECT word, stem, cost FROM b WHERE cost <= best + 0.2 + 1e-9 AND cost <= 0.6 + 1e-9")
def parse_selection(s, d):
    return R.select_parses(parses(s, d), 0.2, 0.6)


@query(f"""WITH RECURSIVE {AFFIX}, {TERMS}, {WORDS}, {STRIP}, {COSTED}, g(word, path, root, steps) AS (SELECT q, 0.0::DOUBLE, q, 0 FROM words UNION SELECT c.word, round(g.path + c.cost, 9), g.root, g.steps + 1 FROM g JOIN costed c ON g.word = c.stem WHERE g.path + c.cost <= 1.0 + 1e-9),
b AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY path, steps, root) AS n FROM g WHERE steps > 0 AND word NOT IN (SELECT q FROM words))
SELECT word, path::DOUBLE AS cost, root, steps::INTEGER AS steps FROM b WHERE n = 1""")
def descendants(s, d):
    return R.descendants(parses(s, d).withColumnRenamed("stem", "root"), words(s, d).select(F.col("q").alias("word"), F.lit(0.0).alias("cost")), 1.0)


PAIRS = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i: substr('^' || {0} || '$', i, 2)))"
BLOCK = f"""{WORDS}, a AS (SELECT q, unnest({PAIRS.format('q')}) AS pair FROM words), b AS (SELECT q AS term, unnest({PAIRS.format('q')}) AS pair FROM words), k AS (SELECT a.q, b.term, count(*) AS shared FROM a JOIN b ON a.pair = b.pair WHERE a.q <> b.term GROUP BY a.q, b.term),
top AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY shared DESC, term) AS place FROM k)"""


@query(f"WITH {BLOCK} SELECT q, term, shared, place::INTEGER AS place FROM top WHERE place <= 300")
def bigram_blocking(s, d):
    return R.blocked(words(s, d), words(s, d).withColumnRenamed("q", "term"))


# Within 1.6 at costs of 1 and 1.2 there is room for one edit.
NEAR = f"""{WORDS}, {TERMS}, lex AS (SELECT term FROM terms UNION SELECT q FROM words),
dq AS (SELECT q, unnest(range(1, length(q) + 1)) AS i, unnest(list_transform(range(1, length(q) + 1), lambda i: substr(q, 1, i - 1) || substr(q, i + 1))) AS less FROM words),
dt AS (SELECT term, unnest(range(1, length(term) + 1)) AS i, unnest(list_transform(range(1, length(term) + 1), lambda i: substr(term, 1, i - 1) || substr(term, i + 1))) AS less FROM lex),
pr AS (SELECT q, term, min(distance) AS distance FROM (SELECT q, q AS term, 0.0::DOUBLE AS distance FROM words UNION ALL SELECT q, term, 1.0 FROM dq JOIN lex ON less = term UNION ALL SELECT q, term, 1.0 FROM dt JOIN words ON less = q UNION ALL SELECT q, term, 1.2 FROM dq JOIN dt ON dq.less = dt.less AND dq.i = dt.i WHERE q <> term) GROUP BY q, term),
near AS (SELECT * FROM pr WHERE distance <= least(1.6, greatest(0.3, 0.2 + 0.15 * length(q))) + 1e-9 AND distance / greatest(length(q), length(term)) <= 0.3 + 1e-9)"""


def near(s, d) -> DataFrame:
    """q, term, distance: all terms within the normal threshold of each benchmark word by plain edits."""
    q = words(s, d)
    return R.within(q, terms(s, d).union(q).distinct(), D.Metric(), I.thresholds(F.col("q"))["max_normal"], 1.6, 0.3)


@query(f"""WITH {NEAR} SELECT q, term, distance, round(distance / greatest(length(q), length(term), 1), 9)::DOUBLE AS by_max, round(distance / greatest(length(q) + length(term), 1), 9)::DOUBLE AS by_sum, round(distance / greatest(length(q), 1), 9)::DOUBLE AS by_query FROM near""")
def fuzzy_plain(s, d):
    """The fuzzy range search without rules, with the distance normalised in every way."""
    return near(s, d).withColumns({f"by_{k}": D.normalized(F.col("distance"), F.col("q"), F.col("term"), k) for k in ("max", "sum", "query")})


@query(f"WITH {NEAR} SELECT q, term, distance FROM near")
def plain_edit_distance(s, d):
    """The distance expression of the JVM over the pairs that are near."""
    return near(s, d).select("q", "term", D.plain_distance(F.col("q"), F.col("term")).alias("distance"))


@query(f"""WITH {NEAR}, ch AS (SELECT unnest(string_split(q, '')) AS s, unnest(string_split(term, '')) AS w FROM near WHERE length(q) = length(term)), n AS (SELECT s, w, count(*) AS n FROM ch GROUP BY s, w)
SELECT s, w, round(-ln((n + CASE WHEN s = w THEN 1.0 ELSE 0.0 END) / (sum(n) OVER (PARTITION BY s) + 1.0)), 9)::DOUBLE AS cost FROM n""")
def cost_table(s, d):
    """What letters correspond to in all near pairs of equal length."""
    pr = near(s, d).filter(F.length("q") == F.length("term"))
    cells = pr.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("q")), lambda i: F.struct(F.substring("q", i, 1).alias("s"), F.substring("term", i, 1).alias("w")))).alias("x"))
    return R.cost_table(cells.select(F.lit("x").alias("a"), F.lit("y").alias("b"), "x.s", "x.w", F.lit(1).alias("n"))).drop("a", "b")


@query("SELECT c_custkey AS parent, count(*) AS n, min(o_orderkey) AS first_child, max(o_orderkey) AS last_child FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey")
def children_lookup(s, d):
    return R.children(table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi"), "o_custkey", "o_orderkey")


CS = "(round(abs(value) * 10000)::BIGINT)"


@query(f"""SELECT event_id, tc, round(CASE WHEN cs >= 360000 THEN cs / 100.0 END, 3)::DOUBLE AS parsed FROM (SELECT event_id, {CS} AS cs, CASE WHEN {CS} >= 360000 THEN ({CS} // 360000)::VARCHAR || ':' ELSE '' END || lpad(({CS} % 360000 // 6000)::VARCHAR, 2, '0') || ':' || lpad(({CS} % 6000 // 100)::VARCHAR, 2, '0') || '.' || lpad(({CS} % 100)::VARCHAR, 2, '0') AS tc FROM events)""")
def timecodes(s, d):
    tc = table(s, d, "events").select("event_id", T.format_timecode(F.abs("value") * 100).alias("tc"))
    return tc.withColumn("parsed", T.parse_timecode(F.col("tc")))


@query("SELECT source, list_reduce(list_transform(list_sort(list(DISTINCT lang)), lambda x: CASE x WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 4 ELSE 8 END), lambda a, b: a + b)::INTEGER AS mask, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY source")
def dialect_masks(s, d):
    codes = ["de", "en", "es", "fr"]
    m = table(s, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("langs")).select("source", T.encode_mask(F.col("langs"), codes).alias("mask"))
    return m.withColumn("langs", F.array_join(T.decode_mask(F.col("mask"), codes), ","))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '\\p{Han}') THEN 'zh' ELSE 'latin' END AS mode FROM documents")
def query_modes(s, d):
    return table(s, d, "documents").select("doc_id", T.query_mode(F.col("text")).alias("mode"))


RULES = D.expand([D.Rule("th", "t", 0.1), D.Rule("ou", "o", 0.2), D.Rule("n", "ng", 0.1, "final"), D.Rule("h", "", 0.1, "final"), D.Rule("e", "i", 0.2)])


@query()
def fuzzy_search(s, d):
    """All terms of documents and benchmark items within the normal threshold of each benchmark word, itself too, by distances with rules."""
    q = words(s, d)
    lexicon = terms(s, d).union(q).distinct()
    return R.within(q, lexicon, D.Metric(RULES), I.thresholds(F.col("q"))["max_normal"], 1.6, 0.3)


@query()
def neighbors(s, d):
    """The twenty nearest other terms of each word, with the steps that lead to them."""
    order = Window.partitionBy("q").orderBy("distance", "term")
    near = fuzzy_search(s, d).filter("q <> term").withColumn("place", F.row_number().over(order)).filter("place <= 20")
    return near.withColumn("steps", D.alignment(D.Metric(RULES))("q", "term"))


@query()
def pattern_search(s, d):
    """Matches of a word pattern: `the`, up to two words, then one ending in `ing`."""
    return P.search(table(s, d, "documents").select(F.col("doc_id").alias("doc"), "text"), '"the" _{0,2} *ing')


from . import lexical  # noqa: E402, F401  (adds its queries)
