"""Document tables from files, URLs, bytes and texts.

All four give the same columns, so they can be united: exactly one of ``content``, ``text`` and ``uri``
is set. ``source``, ``size_bytes``, ``size_chars``, ``guessed_mime`` and ``is_url`` replace a metadata map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mime import MIME_FAMILY, guess_mime

_COLUMNS = {
    "content": "binary",
    "text": "string",
    "uri": "string",
    "doc_type": "string",
    "filename": "string",
    "source": "string",
    "size_bytes": "bigint",
    "size_chars": "bigint",
    "guessed_mime": "string",
    "is_url": "boolean",
}


def _document(df: DataFrame, keys: list[str], **given: Column) -> DataFrame:
    cols = [given.get(n, F.lit(None)).cast(t).alias(n) for n, t in _COLUMNS.items()]
    return df.select(*keys, *cols)


def supported_type(mime: Column) -> Column:
    """The MIME type itself if it is one of the document types, else ``text/plain``."""
    return F.when(mime.isin(*MIME_FAMILY), mime).otherwise(F.lit("text/plain"))


def read_files(
    spark: SparkSession,
    path: str,
    glob: str | None = None,
    recursive: bool = False,
    max_bytes: int | None = None,
) -> DataFrame:
    """One row per file; Spark's readers leave out empty ones. A missing path is an error.

    Files of more than ``max_bytes``, or of more than Spark's reader takes, have their size and no ``content``: they are
    not opened. The length is known before, so the source leaves them out of the scan that reads contents.
    Queries that do not touch ``content`` open no file.
    """
    return _from_files(_reader(spark.read, glob, recursive).load(path), _readable(spark, max_bytes))


def stream_files(
    spark: SparkSession,
    path: str,
    glob: str | None = None,
    recursive: bool = False,
    max_bytes: int | None = None,
    max_files_per_trigger: int = 1000,
) -> DataFrame:
    """The same for files that arrive in a folder: each once. A file must not change after it has appeared."""
    reader = _reader(spark.readStream, glob, recursive).option("maxFilesPerTrigger", str(max_files_per_trigger))
    files = reader.schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return _from_files(files, _readable(spark, max_bytes))


def _reader(read, glob: str | None, recursive: bool):
    reader = read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.option("pathGlobFilter", glob) if glob else reader


def _readable(spark: SparkSession, max_bytes: int | None) -> int:
    limit = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    return limit if max_bytes is None else min(max_bytes, limit)


def _from_files(files: DataFrame, max_bytes: int) -> DataFrame:
    opened = files.where(F.col("length") <= max_bytes).select("path", "length", "content")
    left = files.where(F.col("length") > max_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"))
    name = F.element_at(F.split("path", "/"), -1)
    mime = guess_mime(name)
    return _document(
        opened.union(left),
        ["path"],
        content=F.col("content"),
        doc_type=supported_type(mime),
        filename=name,
        source=F.col("path"),
        size_bytes=F.col("length"),
        guessed_mime=mime,
        is_url=F.lit(False),
    )


def from_url_table(df: DataFrame, keys: list[str], url_col: str, doc_type: Column) -> DataFrame:
    """References to URLs; nothing is fetched."""
    url = F.col(url_col)
    return _document(
        df, keys, uri=url, doc_type=doc_type, source=url, is_url=F.lit(True)
    )


def from_bytes_table(
    df: DataFrame,
    keys: list[str],
    content_col: str,
    doc_type: Column,
    filename: Column | None = None,
) -> DataFrame:
    return _document(
        df,
        keys,
        content=F.col(content_col),
        doc_type=doc_type,
        filename=F.lit(None) if filename is None else filename,
        source=F.lit("bytes"),
        size_bytes=F.octet_length(content_col),
        is_url=F.lit(False),
    )


def from_text_table(
    df: DataFrame,
    keys: list[str],
    text_col: str,
    doc_type: Column | None = None,
    filename: Column | None = None,
) -> DataFrame:
    return _document(
        df,
        keys,
        text=F.col(text_col),
        doc_type=F.lit("text/plain") if doc_type is None else doc_type,
        filename=F.lit(None) if filename is None else filename,
        source=F.lit("text"),
        size_chars=F.length(text_col),
        is_url=F.lit(False),
    )
