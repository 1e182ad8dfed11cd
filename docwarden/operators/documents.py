"""Document predicates and file validation.

Validation of one document is an expression over its own row: bytes are looked at where they were read.
Only verdicts and messages are ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsoncheck import is_strict_json
from ..functions.mime import AUDIO_TYPES, IMAGE_TYPES, TEXT_TYPES, VIDEO_TYPES, guess_mime
from ..functions.text import fixed2
from ..rules import InputLimits

_MB = 1024 * 1024

# First bytes (hex) and the MIME type they stand for, tried in this order.
MAGIC = (
    ("25504446", "application/pdf"),
    ("89504E47", "image/png"),
    ("FFD8FF", "image/jpeg"),
    ("474946383761", "image/gif"),
    ("474946383961", "image/gif"),
    ("52494646", "audio/wav"),
    ("000000", "video/mp4"),
    ("494433", "audio/mpeg"),
    ("FFFB", "audio/mpeg"),
)
SNIFFED_BYTES = 1000


def document_size(df: DataFrame) -> Column:
    """Bytes of content, else of the text, else of the address itself, else the known file size, else 0."""
    parts = [F.octet_length(c) for c in ("content", "text", "uri") if c in df.columns]
    known = [F.col("size_bytes")] if "size_bytes" in df.columns else []
    return F.coalesce(*parts, *known, F.lit(0)).cast("bigint")


def is_text_based(doc_type: Column) -> Column:
    return doc_type.isin(*TEXT_TYPES)


def is_image(doc_type: Column) -> Column:
    return doc_type.isin(*IMAGE_TYPES)


def is_audio(doc_type: Column) -> Column:
    return doc_type.isin(*AUDIO_TYPES)


def is_video(doc_type: Column) -> Column:
    return doc_type.isin(*VIDEO_TYPES)


def with_document_facts(df: DataFrame) -> DataFrame:
    """Add size in bytes, URL flag and the four type predicates."""
    kind = F.col("doc_type")
    flag = F.col("is_url") if "is_url" in df.columns else F.lit(None).cast("boolean")
    return df.withColumns(
        {
            "document_size": document_size(df),
            "is_url": F.coalesce(flag, F.lit(False)),
            "is_text_based": is_text_based(kind),
            "is_image": is_image(kind),
            "is_audio": is_audio(kind),
            "is_video": is_video(kind),
        }
    )


def detect_mime(content: Column) -> Column:
    """MIME from the first bytes; text/plain if the first 1000 bytes are UTF-8 (a character cut there is
    not), else application/octet-stream."""
    head = F.hex(F.substring(content, 1, 6))
    found = F.lit(None).cast("string")
    for magic, mime in reversed(MAGIC):
        found = F.when(head.startswith(magic), F.lit(mime)).otherwise(found)
    sniffed = F.substring(content, 1, SNIFFED_BYTES).cast("string")
    fallback = F.when(F.is_valid_utf8(sniffed), F.lit("text/plain")).otherwise(
        F.lit("application/octet-stream")
    )
    return F.coalesce(found, fallback)


def resolve_mime(content: Column, filename: Column, mime: Column) -> Column:
    """The given MIME type, else the guess from the file name, else from the content."""
    return F.coalesce(mime, guess_mime(filename), detect_mime(content))


def size_error(n_bytes: str, limits: InputLimits = InputLimits()) -> Column:
    """Message when the size in bytes (SQL) is above the limit, else null."""
    mb = f"{n_bytes} / {_MB}D"
    shown = f"{limits.max_document_size_mb}MB"
    return F.when(
        F.expr(mb) > limits.max_document_size_mb,
        F.concat(F.lit("Document size ("), fixed2(mb), F.lit(f"MB) exceeds limit ({shown})")),
    )


def mime_error(mime: Column, limits: InputLimits = InputLimits()) -> Column:
    """Message when an allow-list exists and does not hold the MIME type, else null."""
    if not limits.allowed_mime_types:
        return F.lit(None).cast("string")
    return F.when(
        ~mime.isin(*limits.allowed_mime_types),
        F.concat(F.lit("MIME type '"), mime, F.lit("' is not allowed")),
    )


def content_warnings(content: Column, mime: Column) -> Column:
    """A PDF without its header, JSON that does not parse."""
    is_json = mime == "application/json"
    return F.array_compact(
        F.array(
            F.when(
                (mime == "application/pdf")
                & ~F.hex(F.substring(content, 1, 4)).eqNullSafe("25504446"),
                F.lit("File claims to be PDF but lacks PDF header"),
            ),
            F.when(
                is_json & ~is_strict_json(content, is_json),
                F.lit("File claims to be JSON but is not valid JSON"),
            ),
        )
    )


def validate_documents(
    df: DataFrame,
    content_col: str = "content",
    filename_col: str | None = "filename",
    mime_col: str | None = "mime_type",
    limits: InputLimits = InputLimits(),
    prefix: str = "",
    size_col: str | None = None,
) -> DataFrame:
    """Add ``is_valid``, ``resolved_mime``, ``errors`` and ``warnings``. One narrow stage.

    The validated bytes are the input column itself, to be used where ``is_valid``. ``size_col`` names a size that is known
    without them: a document of some size whose bytes are null was not opened. It is judged by size and file name, and is
    never valid.
    """
    content = F.col(content_col)
    size = f"octet_length({content_col})"
    unopened = F.lit(False)
    if size_col:
        size = f"coalesce({size}, {size_col})"
        unopened = content.isNull() & (F.coalesce(F.col(size_col), F.lit(0)) > 0)
    none = F.lit(None).cast("string")
    filename = F.col(filename_col) if filename_col else none
    given = F.col(mime_col) if mime_col else none
    mime = F.col(prefix + "resolved_mime")
    staged = df.withColumn(prefix + "resolved_mime", resolve_mime(content, filename, given))
    too_large = size_error(size, limits)
    errors, warnings = F.array(too_large, mime_error(mime, limits)), content_warnings(content, mime)
    if size_col:
        not_read = F.when(unopened & too_large.isNull(), F.lit("Document was not read"))
        errors = F.array(too_large, not_read, mime_error(mime, limits))
        warnings = F.when(unopened, F.array().cast("array<string>")).otherwise(warnings)
    staged = staged.withColumns({prefix + "errors": F.array_compact(errors), prefix + "warnings": warnings})
    return staged.withColumn(prefix + "is_valid", F.size(prefix + "errors") == 0)


def validate_batches(
    docs: DataFrame,
    request_col: str = "request_id",
    index_col: str = "doc_index",
    content_col: str = "content",
    filename_col: str | None = "filename",
    mime_col: str | None = "mime_type",
    limits: InputLimits = InputLimits(),
) -> DataFrame:
    """One row per request: ``n_documents``, ``is_valid``, ``errors``, ``warnings``.

    More documents than allowed is the only error of its request. Documents are numbered from 1 in the
    order of ``index_col``, which must be unique in a request.

    Bytes are reduced to messages before the shuffle. A request of any size costs one task no more than
    the limit: the count is combined on the map side, and the rank filter lets every map task send at
    most ``max_documents_per_request`` documents of a request, all that a request within the limit has.
    """
    cap = limits.max_documents_per_request
    counts = docs.groupBy(request_col).agg(F.count(F.lit(1)).alias("n_documents"))
    checked = validate_documents(docs, content_col, filename_col, mime_col, limits, "__").select(
        request_col, index_col, F.col("__errors").alias("e"), F.col("__warnings").alias("w")
    )
    place = F.row_number().over(Window.partitionBy(request_col).orderBy(index_col))
    ranked = checked.withColumn("rank", place).where(F.col("rank") <= cap)
    listed = ranked.groupBy(request_col).agg(
        F.array_sort(F.collect_list(F.struct("rank", "e", "w"))).alias("docs")
    )

    def messages(field: str, sep: str) -> Column:
        return F.flatten(
            F.transform(
                "docs",
                lambda d: F.transform(
                    d[field],
                    lambda m: F.concat(F.lit("Document "), d["rank"].cast("string"), F.lit(sep), m),
                ),
            )
        )

    n = F.col("n_documents")
    oversized = n > cap
    too_many = F.array(
        F.concat(
            F.lit("Number of documents ("), n.cast("string"), F.lit(f") exceeds limit ({cap})")
        )
    )
    # Null-safe: documents without a request id form a request of their own.
    listed = listed.withColumnRenamed(request_col, "__request")
    joined = counts.join(listed, F.col(request_col).eqNullSafe(F.col("__request")))
    return joined.select(
        request_col,
        "n_documents",
        F.when(oversized, too_many).otherwise(messages("e", ":  ")).alias("errors"),
        F.when(oversized, F.array().cast("array<string>"))
        .otherwise(messages("w", ": "))
        .alias("warnings"),
    ).withColumn("is_valid", F.size("errors") == 0)
