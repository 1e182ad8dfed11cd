import hashlib
import os
import subprocess
import sys
import textwrap

from docwarden.operators.documents import validate_documents
from docwarden.rules import InputLimits
from docwarden.sources.documents import read_files, stream_files

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_files_are_read_whole_and_validated(spark, tmp_path):
    files = {"a.pdf": b"%PDF-1.7 x", "b.pdf": b"no header", "c.json": b'{"a": 1}', "d.json": b'{"a": 1} tail', "e.txt": "text é".encode(), "f.exe": b"MZ\x00"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = validate_documents(read_files(spark, str(tmp_path)), mime_col=None)
    out = {r.filename: r for r in found.collect()}
    assert {k: hashlib.md5(bytes(r.content)).hexdigest() for k, r in out.items()} == {k: hashlib.md5(v).hexdigest() for k, v in files.items()}
    assert out["a.pdf"].is_valid and out["a.pdf"].warnings == [] and len(out["b.pdf"].warnings) == 1
    assert out["c.json"].warnings == [] and len(out["d.json"].warnings) == 1 and not out["f.exe"].is_valid


def test_works_from_another_folder(tmp_path):
    """Executors get the package by ``ship``: nothing is on their path by chance."""
    code = f"""
        import sys
        sys.path.insert(0, {REPO!r})
        from pyspark.sql import SparkSession
        from pyspark.sql import functions as F
        from docwarden.operators.admission import admit_requests
        from docwarden.ship import ship
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        ship(spark)
        df = spark.range(20).select(F.col("id").alias("request_id"), (F.col("id") % 3).alias("user_id"), F.lit(1).alias("tokens"), F.timestamp_seconds("id").alias("ts"))
        print("admitted", admit_requests(df).where("allowed").count())
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "admitted 20" in done.stdout, done.stderr[-2000:]


def test_files_over_the_limit_are_rows_and_stay_closed(spark, tmp_path):
    (tmp_path / "small.txt").write_bytes(b"short")
    (tmp_path / "large.pdf").write_bytes(b"x" * 5000)
    (tmp_path / "middle.json").write_bytes(b"[" + b"1," * 200 + b"1]")
    limits = InputLimits(max_document_size_mb=0.001)
    key = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(key, "300")  # a file that is longer ends the job when it is opened
    try:
        found = validate_documents(read_files(spark, str(tmp_path), max_bytes=1048), mime_col=None, limits=limits, size_col="size_bytes")
        out = {r.filename: r for r in found.collect()}
    finally:
        spark.conf.unset(key)
    assert {n: r.size_bytes for n, r in out.items()} == {"small.txt": 5, "large.pdf": 5000, "middle.json": 403}
    assert {n: r.content is None for n, r in out.items()} == {"small.txt": False, "large.pdf": True, "middle.json": True}
    assert out["large.pdf"].errors == ["Document size (0.00MB) exceeds limit (0.001MB)"] and out["large.pdf"].warnings == []
    assert out["middle.json"].errors == ["Document was not read"] and out["small.txt"].is_valid


def test_arriving_files_are_validated_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def run():
        files = stream_files(spark, str(source), glob="*.txt", max_bytes=100)
        out = validate_documents(files, mime_col=None, limits=InputLimits(max_document_size_mb=0.0001), size_col="size_bytes")
        out = out.select("filename", "size_bytes", "is_valid", "errors", "content")
        writer = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        writer.trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r.filename, r.size_bytes, r.is_valid, r.content is None) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect())

    (source / "a.txt").write_bytes(b"one")
    (source / "b.txt").write_bytes(b"y" * 200)
    (source / "other.bin").write_bytes(b"z")
    first = [("a.txt", 3, True, False), ("b.txt", 200, False, True)]
    assert run() == first
    (source / "c.txt").write_bytes(b"two")
    assert run() == [*first, ("c.txt", 3, True, False)] == run()
