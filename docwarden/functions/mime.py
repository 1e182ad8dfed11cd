"""MIME types: the supported set, families, and the guess from a file name."""

from __future__ import annotations

import mimetypes
import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

# Supported document types and the family each belongs to.
MIME_FAMILY = {
    "application/pdf": "pdf",
    "image/png": "image",
    "image/jpeg": "image",
    "image/webp": "image",
    "image/gif": "image",
    "text/plain": "text",
    "text/markdown": "text",
    "text/html": "text",
    "text/csv": "csv",
    "application/json": "json",
    "audio/mpeg": "audio",
    "audio/wav": "audio",
    "video/mp4": "video",
    "video/webm": "video",
}
TEXT_TYPES = ("text/plain", "text/markdown", "text/html", "text/csv", "application/json")
IMAGE_TYPES = ("image/png", "image/jpeg", "image/webp", "image/gif")
AUDIO_TYPES = ("audio/mpeg", "audio/wav")
VIDEO_TYPES = ("video/mp4", "video/webm")

# Ours: the standard table calls WAV files audio/x-wav, which no document type and no allow-list knows.
_OVERRIDES = {".wav": "audio/wav", ".webp": "image/webp", ".webm": "video/webm", ".md": "text/markdown"}


def extension_types() -> dict[str, str]:
    """Lower-case extension -> MIME, from Python's own table without the machine's mime.types files."""
    known = mimetypes.MimeTypes(filenames=())
    table = {ext.lower(): mime for ext, mime in known.types_map[True].items()}
    for short, full in known.suffix_map.items():
        inner = posixpath.splitext(posixpath.splitext("x" + full)[0])[1]
        if inner in table:
            table[short] = table[inner]
    return table | _OVERRIDES


def guess_mime(filename: Column) -> Column:
    """MIME from the extension (a compression suffix is looked through), else null."""
    name = F.regexp_replace(filename, r"\.(gz|Z|bz2|xz|br)$", "")
    ext = F.lower(F.regexp_extract(name, r"[^/.][^/]*(\.[^./]*)$", 1))
    table = F.create_map(*[F.lit(x) for kv in sorted(extension_types().items()) for x in kv])
    return F.try_element_at(table, F.nullif(ext, F.lit("")))


def mime_family(mime: Column) -> Column:
    """pdf, image, text, csv, json, audio or video; null for other types."""
    table = F.create_map(*[F.lit(x) for kv in MIME_FAMILY.items() for x in kv])
    return F.try_element_at(table, mime)
