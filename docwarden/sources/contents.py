"""Contents and texts of documents stored once, so that links and tasks carry references instead."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import and_

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REF = "struct<file:string,start:bigint,length:bigint,sha256:string>"
_REF = pa.struct({"file": pa.string(), "start": pa.int64(), "length": pa.int64(), "sha256": pa.string()})


def place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of an address, and the path there."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri)


def store_contents(documents: DataFrame, folder: str, columns: tuple[str, ...] = ("content", "text")) -> DataFrame:
    """``documents`` with ``content_ref`` and ``text_ref`` (file, start, length, digest) in place of ``content`` and ``text``.

    Each task appends contents, and texts in UTF-8, to a file of its own below ``folder``, every different one once; the rows that
    had any are written there as well, so that nothing is stored again when they are read twice. Rows without are
    not copied. A task that is repeated writes a new file; the rows name the files of the attempt that counted.
    ``folder`` must be new, and shared by driver and executors. Only ``columns`` that are there are replaced; columns that have a
    reference's name already are dropped.
    """
    moved = [c for c in columns if c in documents.columns]
    names = [f"{c}_ref" for c in moved]
    documents = documents.drop(*names)
    others = [c for c in documents.columns if c not in moved]

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = place(f"{folder}/contents")
        fs.create_dir(base)
        name = f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}.bin"
        at: dict[bytes, int] = {}
        with fs.open_output_stream(f"{base}/{name}") as out:

            def kept(value: pa.Scalar) -> dict | None:
                if not value.is_valid:
                    return None
                data = value.as_buffer()
                digest = hashlib.sha256(data).digest()
                if digest not in at:
                    at[digest] = out.tell()
                    out.write(data)
                return {"file": f"{folder}/contents/{name}", "start": at[digest], "length": data.size, "sha256": digest.hex()}

            for batch in batches:
                refs = [pa.array([kept(v) for v in batch[c]], _REF) for c in moved]
                yield pa.RecordBatch.from_arrays([batch[c] for c in others] + refs, others + names)

    none = reduce(and_, (F.col(c).isNull() for c in moved))
    plain = documents.where(none).select(*others, *(F.lit(None).cast(REF).alias(n) for n in names))
    schema = plain.schema
    documents.where(~none).select(*others, *moved).mapInArrow(store, schema).write.parquet(f"{folder}/documents")
    return plain.unionByName(documents.sparkSession.read.schema(schema).parquet(f"{folder}/documents"))


@lru_cache(maxsize=64)
def _opened(uri: str) -> pyarrow.NativeFile:
    """A file of contents, kept open: a task reads many from few files, which never change."""
    fs, path = place(uri)
    return fs.open_input_file(path)


def read_content(ref: dict) -> bytes:
    """The bytes of a reference; an error if they are not those that were stored."""
    data = _opened(ref["file"]).read_at(ref["length"], ref["start"])
    if hashlib.sha256(data).hexdigest() != ref["sha256"]:
        raise ValueError(f"stored content differs from its digest: {ref['file']}")
    return data
