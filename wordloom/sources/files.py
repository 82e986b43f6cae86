"""Readers and writers: datasets of records, delimited text in unknown encodings, subtitle events."""

from __future__ import annotations

import csv
import io
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = """id string, source string, localId string, unit string, text string, altTexts array<struct<system:string,text:string>>, dialects array<string>, dialectRaw string,
senses array<struct<zh:string,en:string,nan:string,note:string>>, pos string, domain struct<code:string,label:string>,
morphology struct<formType:string,segmentation:string,gloss:string,grammaticalNote:string,derivedFrom:array<struct<relation:string,text:string,via:string,attribution:string>>>,
interlinear array<struct<form:string,gloss:string>>, variants array<struct<relation:string,text:string,attribution:string,dialects:array<string>,dialectRaw:string>>,
related array<struct<type:string,target:string,label:string>>, `group` struct<id:string,role:string,parent:string,seq:int>,
citation struct<label:string,page:int,pages:array<int>,row:int,code:string,file:string,timecode:struct<start:double,`end`:double>,scan:string>,
media array<struct<type:string,src:string,start:double,`end`:double,available:boolean,label:string>>, attribution string, speaker string, quality struct<status:string,flags:array<string>>, notes array<string>"""


def write_dataset(records: DataFrame, path: str) -> None:
    """Records by source and shard; what was there goes."""
    records.write.mode("overwrite").partitionBy("source", "shard").json(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Records with their source and shard. The schema is given, so nothing is inferred and unknown fields are dropped."""
    return spark.read.schema(f"{RECORD}, shard string").json(path)


def decode(raw: bytes) -> tuple[str, str]:
    """Text and encoding: a byte order mark decides, else UTF-8 if it is valid, else Big5."""
    if raw[:4] == b"PK\x03\x04":
        raise ValueError("a zip archive, not text")
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace"), name
    try:
        return raw.decode(), "utf-8"
    except UnicodeDecodeError:
        return raw.decode("big5", "replace"), "big5"


def delimiter(text: str) -> str:
    """The commonest of tab, comma and semicolon in the first record, outside quotes."""
    counts, quoted = dict.fromkeys("\t,;", 0), False
    for ch in text:
        if ch == '"':
            quoted = not quoted
        elif not quoted and ch in "\r\n":
            break
        elif not quoted and ch in counts:
            counts[ch] += 1
    best = max(counts, key=lambda c: counts[c])
    return best if counts[best] else ","


def rows(raw: bytes) -> Iterator[tuple[int, list[str]]]:
    """Row numbers from 1 and composed, trimmed cells; blank rows are left out but counted."""
    text, _ = decode(raw)
    for k, cells in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter(text)), 1):
        cells = [unicodedata.normalize("NFC", c).strip() for c in cells]
        if any(cells):
            yield k, cells


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """path, row, cells of delimited files of any of these kinds; each file is parsed by one task, since quotes may span lines."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"]):
                found = list(rows(bytes(raw)))
                yield pd.DataFrame({"path": name, "row": [k for k, _ in found], "cells": [c for _, c in found]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, row int, cells array<string>")


def to_words(table: DataFrame, roles: dict[int, str]) -> DataFrame:
    """Cells by role, from (row, cells): rows without text go, and of rows with the same cells the first stays."""
    named = table.select("row", *(F.nullif(F.trim(F.get("cells", F.lit(k))), F.lit("")).alias(role) for k, role in sorted(roles.items())))
    kept = named.filter(F.col("text").isNotNull())
    return kept.groupBy(*roles.values()).agg(F.min("row").alias("row"))


def roles(header: list[str]) -> dict[int, str]:
    """Column roles by header names."""
    names = {"text": {"text", "word", "form", "entry", "headword"}, "en": {"en", "english", "gloss", "meaning"}, "zh": {"zh", "chinese", "中文", "華語"}, "dialect": {"dialect", "variety"}, "note": {"note", "notes", "remark"}}
    out: dict[int, str] = {}
    for k, h in enumerate(header):
        key = re.sub(r"[\s_\-()（）]+", "", unicodedata.normalize("NFKC", h).lower())
        role = next((r for r, n in names.items() if key in n and r not in out.values()), None)
        if role:
            out[k] = role
    return out


def subtitle_events(files: DataFrame) -> DataFrame:
    """path, start, end, speaker, text of the dialogue lines of subtitle scripts, from (path, value) with each file whole."""
    from ..functions.text import parse_timecode

    line = files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line")).filter(F.col("line").startswith("Dialogue:"))
    cells = line.withColumn("c", F.split(F.regexp_replace("line", "^Dialogue:", ""), ",", 10)).filter(F.size("c") == 10)
    cell = lambda k: F.trim(F.get("c", F.lit(k)))
    bare = F.regexp_replace(F.regexp_replace(cell(9), r"\{[^}]*\}", ""), r"\\[Nn]", "\n")
    return cells.select("path", "pos", parse_timecode(cell(1)).alias("start"), parse_timecode(cell(2)).alias("end"), F.nullif(cell(4), F.lit("")).alias("speaker"), bare.alias("text"))
