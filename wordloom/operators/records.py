"""Records: defaults, projections, lookups, identifiers, dialect cells, reports and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .rounds import kept

LIST_SPLIT = "[,，;；/、|]+"
#: Ways of writing that only a word pattern has: a lone _, dots, quotes, |, &, ^ and $ at an edge, ! before a word, a count, a
#: group with a repeat, @word.
PATTERN_SIGNS = (
    r"(?:^|[\s(|&!])_(?:$|[\s)|&?*+{/])",
    r"…|\.\.\.",
    r'["“”]',
    r"\|",
    "&",
    r"(?:^|[\s(|&])\^",
    r"\$(?:$|[\s)|&])",
    r'(?:^|[\s(|&])![\p{L}"“(@_!^]',
    r"[^\s{]\{\s*\d+\s*(?:,\s*\d*\s*)?\}",
    r"\)[?*+{]",
    r"(?:^|[\s(|&!/])@\p{L}",
)


def is_pattern(c: Column, mode: str | None = None) -> Column:
    """Whether a query is a word pattern. mode plain or pattern decides alone; text with Han characters never is one."""
    if mode == "plain":
        return F.lit(False)
    text = F.trim(F.coalesce(c, F.lit("")))
    if mode == "pattern":
        return text != ""
    signs = F.lit(False)
    for sign in PATTERN_SIGNS:
        signs = signs | text.rlike(sign)
    return (text != "") & ~T.has_han(text) & signs


def or_null(c: Column) -> Column:
    """Null for null and blank cells."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def sense(zh: Column, en: Column, nan: Column) -> Column:
    return F.struct(or_null(zh).alias("zh"), or_null(en).alias("en"), or_null(nan).alias("nan"))


def with_defaults(df: DataFrame) -> DataFrame:
    """id (source:localId) and the fields that are missing: status unreviewed, no senses, no dialects. Blank cells become null."""
    out = df.withColumn("id", F.concat_ws(":", "source", "localId"))
    for name, value in {"status": F.lit("unreviewed"), "dialects": F.array().cast("array<string>"), "pos": F.lit(None).cast("string"), "attribution": F.lit(None).cast("string")}.items():
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    return out


def projected(records: DataFrame, groups: DataFrame) -> DataFrame:
    """id, zh, nan, en, audio, title: what a search shows of a record. Senses are joined (zh and nan by ；, en by ;), the first medium
    that is audio and available is its audio, and its group gives the title. groups: gid, title; one row each."""
    joined = lambda name, sep: or_null(F.array_join(F.filter(F.transform("senses", lambda s: F.trim(s[name])), lambda x: x.isNotNull() & (x != "")), sep))
    audio = F.get(F.filter("media", lambda m: (m["type"] == "audio") & F.coalesce(m["available"], F.lit(True))), F.lit(0))["src"]
    out = records.select("id", joined("zh", "；").alias("zh"), joined("nan", "；").alias("nan"), joined("en", "; ").alias("en"), audio.alias("audio"), F.col("grp"))
    return out.join(groups, F.col("grp") == F.col("gid"), "left").select("id", "zh", "nan", "en", "audio", "title")


def by_id(records: DataFrame, column: str, value) -> DataFrame:
    """One record; the filter reaches the scan."""
    return records.filter(F.col(column) == value)


def filtered(docs: DataFrame, inventory: list[str], below: dict[str, list[str]], sources=(), units=(), statuses=(), dialects=()) -> DataFrame:
    """docs (source, unit, status, mask) that pass every list that isn't empty. A dialect also takes those below it; `none` takes
    records without any."""
    for name, values in (("source", sources), ("unit", units), ("status", statuses)):
        if values:
            docs = docs.filter(F.col(name).isin(*values))
    if dialects:
        wanted = {m for x in dialects if x != "none" for m in below.get(x, [x])}
        bits = sum(1 << k for k, code in enumerate(inventory) if code in wanted)
        hit = F.col("mask").bitwiseAND(F.lit(bits)) != 0
        docs = docs.filter(hit | (F.col("mask") == 0) if "none" in dialects else hit)
    return docs


def dialect_cells(cells: DataFrame, varieties: DataFrame) -> DataFrame:
    """row, codes, unknown of cells (row, cell): the codes that its parts name by code or label, whatever their case, and the parts that name
    none; each once, in the order of the cell. varieties: code, labels; a short list, sent to the tasks."""
    names = varieties.select("code", F.explode(F.array_union(F.array("code"), F.transform("labels", lambda x: F.lower(F.trim(x))))).alias("name")).groupBy("name").agg(F.min("code").alias("code"))
    parts = cells.select("row", F.posexplode(F.split(F.coalesce("cell", F.lit("")), LIST_SPLIT)).alias("pos", "part")).withColumn("part", F.trim("part")).filter("part <> ''")
    found = parts.join(F.broadcast(names), F.lower("part") == F.col("name"), "left")
    first = found.groupBy("row", "code", F.when(F.col("code").isNull(), F.col("part")).alias("other")).agg(F.min("pos").alias("pos"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("pos", F.col(c).alias("x"))))), lambda s: s["x"])
    out = first.groupBy("row").agg(ordered("code").alias("codes"), ordered("other").alias("unknown"))
    none = F.array().cast("array<string>")
    return cells.select("row").join(out, "row", "left").select("row", F.coalesce("codes", none).alias("codes"), F.coalesce("unknown", none).alias("unknown"))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """key, i: places from 1 in the order of the key. Rows are parted by ranges of the key and numbered within a part; only the counts
    of parts are summed in one task."""
    parted = kept(rows.select(key).orderBy(key).withColumn("_part", F.spark_partition_id()))
    before = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return parted.withColumn("_place", place).join(F.broadcast(before), "_part").select(key, (F.col("_before") + F.col("_place")).alias("_i"))


def next_ids(rows: DataFrame, key: str, used: DataFrame, prefix: str) -> DataFrame:
    """key, new_id: prefix and the smallest numbers that no used id (id) has, in the order of the key.

    The i-th free number is i plus the count of used ones before it. The used number k in order, n, has n - k free ones
    before it, so the count for i is the last k with n - k < i. That is found within blocks of i, and what a block begins
    with comes from a table of one row a block."""
    n = F.regexp_extract("id", f"^{prefix}([1-9][0-9]{{0,17}})$", 1)
    taken = numbered(used.select(F.nullif(n, F.lit("")).cast("long").alias("_used")).filter("_used IS NOT NULL").distinct(), "_used")
    marks = taken.groupBy((F.col("_used") - F.col("_i") + 1).alias("_i0")).agg(F.max("_i").alias("_k"))
    block = lambda c: F.floor(F.col(c) / (1 << 16)).alias("_block")
    marks = kept(marks.select(F.col("_i0").alias("_i"), "_k", block("_i0")))
    wanted = numbered(rows, key).withColumn("_block", block("_i"))
    both = wanted.select("_i", F.lit(None).cast("long").alias("_k"), "_block", key, F.lit(1).alias("_what")).unionByName(marks.select("_i", "_k", "_block", F.lit(None).cast(dict(rows.dtypes)[key]).alias(key), F.lit(0).alias("_what")))
    blocks = both.select("_block").distinct().join(marks.groupBy("_block").agg(F.max("_k").alias("_m")), "_block", "left")
    begin = blocks.select("_block", F.max("_m").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_begin"))
    last = F.max("_k").over(Window.partitionBy("_block").orderBy("_i", "_what").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_shift", last).filter("_what = 1").join(begin, "_block")
    return out.select(key, F.concat(F.lit(prefix), (F.col("_i") + F.coalesce("_shift", "_begin", F.lit(0))).cast("string")).alias("new_id"))


def report(issues: DataFrame, most: int = 8) -> DataFrame:
    """source, place, level, message, n, errors: the first messages of each source (by level, then message), with all its counts."""
    w = Window.partitionBy("source")
    out = issues.withColumn("n", F.count("*").over(w)).withColumn("errors", F.count_if(F.col("level") == "error").over(w))
    return out.withColumn("place", F.row_number().over(w.orderBy("level", "message"))).filter(F.col("place") <= most).select("source", "place", "level", "message", "n", "errors")


def schema_issues(records: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """id, issue: each rule (a condition that must hold) that a record breaks. Null breaks a rule too."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return records.select("id", F.explode(broken).alias("issue"))


def content_hashes(rows: DataFrame, shard: Column) -> DataFrame:
    """shard, n, sha1 of each shard's rows as JSON in their order, for manifests: a shard of equal content has an equal hash. Rows are
    hashed first, so what comes together is one digest a row."""
    each = rows.select(shard.alias("shard"), F.sha1(F.to_json(F.struct(*rows.columns))).alias("h"))
    return each.groupBy("shard").agg(F.count("*").alias("n"), F.sha1(F.concat_ws("", F.sort_array(F.collect_list("h")))).alias("sha1"))


def localized(labels: Column, locale: str, fallback: str) -> Column:
    """A label in one language, else in another, else in the first there is."""
    return F.coalesce(F.try_element_at(labels, F.lit(locale)), F.try_element_at(labels, F.lit(fallback)), F.get(F.map_values(labels), F.lit(0)))


def coverage(messages: DataFrame, used: DataFrame) -> DataFrame:
    """key, state: missing (used without a message) or unused (a message that nothing uses). Both have a column key."""
    m, u = messages.select("key").distinct(), used.select("key").distinct()
    return u.join(m, "key", "left_anti").withColumn("state", F.lit("missing")).unionByName(m.join(u, "key", "left_anti").withColumn("state", F.lit("unused")))


def page_of_groups(groups: DataFrame, flag: str | None, keys: list, offset: int, limit: int) -> DataFrame:
    """A page of duplicate groups with how many there are of each kind: all, same_source, cross_source."""
    counts = groups.agg(F.count("*").alias("n_all"), F.count_if("same_source").alias("n_same"), F.count_if("cross_source").alias("n_cross"))
    some = groups.filter(flag) if flag else groups
    return some.orderBy(*keys).offset(offset).limit(limit).crossJoin(F.broadcast(counts))
