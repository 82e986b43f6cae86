"""Sources, sinks and streams on small files."""

import datetime

import pytest

from wordloom.sources import files as S
from wordloom.streaming import index as X


@pytest.mark.parametrize("raw, text, name", [(b"\xef\xbb\xbfa", "a", "utf-8"), ("é".encode("utf-16-le").join([b"\xff\xfe", b""]), "é", "utf-16-le"), ("中文".encode("big5"), "中文", "big5"), (b"x", "x", "utf-8")])
def test_decoding(raw, text, name):
    assert S.decode(raw) == (text, name)


def test_zip_is_no_text():
    with pytest.raises(ValueError):
        S.decode(b"PK\x03\x04rest")


@pytest.mark.parametrize("text, want", [("a\tb,c\td", "\t"), ('"a;b;c",d', ","), ("a;b", ";"), ("abc", ","), ("", ",")])
def test_delimiter(text, want):
    assert S.delimiter(text) == want


def test_tables_to_words(spark, tmp_path):
    (tmp_path / "a.csv").write_text('word,en\n ka ,"to go, on"\n\n,none\nka,"to go, on"\nna\n', encoding="utf-8-sig")
    t = S.read_tables(spark, str(tmp_path / "a.csv"))
    got = {r.row: list(r.cells) for r in t.collect()}
    assert got == {1: ["word", "en"], 2: ["ka", "to go, on"], 4: ["", "none"], 5: ["ka", "to go, on"], 6: ["na"]}
    roles = S.roles(got[1])
    assert roles == {0: "text", 1: "en"}
    assert sorted((r.text, r.en, r.row) for r in S.to_words(t.filter("row > 1"), roles).collect()) == [("ka", "to go, on", 2), ("na", None, 6)]


def test_dataset_round_trip(spark, tmp_path):
    rows = [{"id": "s:1", "source": "s", "text": "ka", "unit": "word", "shard": "words"}, {"id": "t:1", "source": "t", "text": "na", "unit": "word", "shard": "more"}]
    df = spark.createDataFrame(rows, f"{S.RECORD}, shard string")
    S.write_dataset(df, str(tmp_path / "d"))
    out = S.read_dataset(spark, str(tmp_path / "d"))
    assert {(r.id, r.source, r.shard, r.text) for r in out.collect()} == {("s:1", "s", "words", "ka"), ("t:1", "t", "more", "na")}
    assert out.filter("source = 's'").count() == 1


def test_subtitles(spark):
    script = "[Events]\nDialogue: 0,0:00:01.50,0:00:02.00,Default,Ann,0,0,0,,Hi, {\\i1}you\\Nall\nComment: x\nDialogue: bad"
    (r,) = S.subtitle_events(spark.createDataFrame([("f", script)], "path string, value string")).collect()
    assert (r.start, r.end, r.speaker, r.text) == (1.5, 2.0, "Ann", "Hi, you\nall")


def test_stream_of_postings(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ka na ka"), (2, "na")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
        X.append_postings(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted((r.term, r.doc) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("ka", 1), ("na", 1), ("na", 2)]


def test_windowed_words(spark):
    at = datetime.datetime(2024, 1, 1, 0, 0)
    df = spark.createDataFrame([(at, "ka na"), (at + datetime.timedelta(seconds=30), "ka"), (at + datetime.timedelta(minutes=5), "ka")], "ts timestamp, text string")
    assert sorted((r.word, r.n) for r in X.word_counts(df, "ts", "1 minute", "1 minute").collect()) == [("ka", 1), ("ka", 2), ("na", 1)]
