import mimetypes

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from docwarden.functions.mime import guess_mime
from docwarden.operators.documents import (
    detect_mime,
    validate_batches,
    validate_documents,
    with_document_facts,
)
from docwarden.rules import InputLimits
from docwarden.sources.documents import from_bytes_table, from_text_table, from_url_table, read_files


def test_magic_bytes(spark):
    cases = [
        (b"%PDF-1.7", "application/pdf"), (b"\x89PNG\r\n", "image/png"), (b"\xff\xd8\xff\xe0", "image/jpeg"),
        (b"GIF87a..", "image/gif"), (b"GIF89a..", "image/gif"), (b"GIF88a..", "text/plain"),
        (b"RIFF1234WEBP", "audio/wav"), (b"\x00\x00\x00\x18ftyp", "video/mp4"), (b"ID3\x03", "audio/mpeg"),
        (b"\xff\xfb\x90", "audio/mpeg"), (b"", "text/plain"), (b"abc", "text/plain"), (b"\xff\xfe", "application/octet-stream"),
        (b"a" * 999 + "é".encode(), "application/octet-stream"), (b"a" * 998 + "é".encode(), "text/plain"),
        (b"a" * 1000 + b"\xff", "text/plain"),
    ]
    df = spark.createDataFrame([(bytearray(c), m) for c, m in cases], "c binary, m string")
    assert df.select("m", detect_mime(F.col("c")).alias("d")).where("m <> d").collect() == []


def test_name_guess(spark):
    names = ["a.pdf", "A.PDF", "x.tar.gz", "r.pdf.gz", "noext", ".pdf", "..pdf", "dir.d/file", "a.", "b.unknown",
             "x.tgz", "p.jpeg", "q.htm", "d.csv", "e.json", "f.mp3", "g.mp4", "h.txt", "i.md"]
    want = {n: mimetypes.MimeTypes(()).guess_type(n)[0] for n in names} | {"w.wav": "audio/wav", "k.webp": "image/webp"}
    got = spark.createDataFrame([(n,) for n in want], "n string").select("n", guess_mime(F.col("n")).alias("m")).collect()
    assert {r.n: r.m for r in got} == want


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "b.weird").write_bytes(b"hello")
    (tmp_path / "c.json").write_bytes(b"x" * 500)
    df = read_files(spark, str(tmp_path), max_bytes=100)
    rows = {r.filename: r for r in df.collect()}
    assert {n: r.content is None for n, r in rows.items()} == {"a.pdf": False, "b.weird": False, "c.json": True}
    assert rows["c.json"].size_bytes == 500
    assert rows["a.pdf"].doc_type == "application/pdf" and rows["a.pdf"].size_bytes == 6
    assert rows["b.weird"].doc_type == "text/plain" and rows["b.weird"].guessed_mime is None
    assert bytes(rows["b.weird"].content) == b"hello"
    assert read_files(spark, str(tmp_path), glob="*.json").count() == 1
    with pytest.raises(AnalysisException):
        read_files(spark, str(tmp_path / "missing")).count()
    plan = df.select("filename", "size_bytes")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,100)" in plan and "content" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_sources_and_facts(spark):
    df = spark.createDataFrame([(1, "héé", "http://x/é")], "id long, t string, u string")
    made = (
        from_text_table(df, ["id"], "t")
        .unionByName(from_url_table(df, ["id"], "u", F.lit("text/html")))
        .unionByName(from_bytes_table(df.withColumn("b", F.col("t").cast("binary")), ["id"], "b", F.lit("image/gif")))
    )
    text, url, raw = with_document_facts(made).collect()
    assert (text.size_chars, text.document_size, text.is_url, text.is_text_based) == (3, 5, False, True)
    assert (url.source, url.document_size, url.is_url, url.is_text_based) == ("http://x/é", 11, True, True)
    assert (raw.size_bytes, raw.document_size, raw.is_image, raw.is_audio, raw.is_video) == (5, 5, True, False, False)


def test_validation(spark):
    rows = [
        (1, b"%PDF-1", None, "application/pdf"), (2, b"PDF-1", "x.pdf", None), (3, b'{"a": 1}', "x.json", None),
        (4, b'{"a": 1} x', "x.json", None), (5, b"\xff", None, "application/json"), (6, b"\xff\xfe", None, None),
        (7, b"a" * 1048577, None, None), (8, b"a" * 1048576, None, None), (9, b"x", "song.wav", None),
        (10, b"NaN", "x.json", None), (11, "﻿1".encode(), "x.json", None),
    ]
    df = spark.createDataFrame([(i, bytearray(c), f, m) for i, c, f, m in rows], "id long, content binary, filename string, mime_type string")
    out = {r.id: r for r in validate_documents(df, limits=InputLimits(max_document_size_mb=1)).collect()}
    pdf, js = "File claims to be PDF but lacks PDF header", "File claims to be JSON but is not valid JSON"
    assert {i: r.warnings for i, r in out.items() if r.warnings} == {2: [pdf], 4: [js], 5: [js], 11: [js]}
    assert {i: r.errors for i, r in out.items() if r.errors} == {
        6: ["MIME type 'application/octet-stream' is not allowed"],
        7: ["Document size (1.00MB) exceeds limit (1MB)"],
    }
    assert not out[6].is_valid and out[9].is_valid


def test_batches(spark):
    rows = [(1, i, b"ok", None) for i in range(20)] + [(2, i, b"ok", None) for i in range(21)]
    rows += [(3, 7, b"ok", "text/plain"), (3, 9, b"x", "application/pdf"), (3, 8, b"ok", "font/otf")]
    df = spark.createDataFrame([(r, i, bytearray(c), m) for r, i, c, m in rows], "request_id long, doc_index int, content binary, mime_type string")
    out = {r.request_id: r for r in validate_batches(df.repartition(5), filename_col=None).collect()}
    assert out[1].is_valid and out[1].errors == [] and out[1].n_documents == 20
    assert out[2].errors == ["Number of documents (21) exceeds limit (20)"] and out[2].warnings == []
    assert out[3].errors == ["Document 2:  MIME type 'font/otf' is not allowed"]
    assert out[3].warnings == ["Document 3: File claims to be PDF but lacks PDF header"]
    plan = validate_batches(df, filename_col=None)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
