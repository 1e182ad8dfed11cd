"""Token ids in binary shard files with keyed access through a minimal perfect hash.

A shard file holds raw ids (unsigned, little-endian, 2 or 4 bytes each), then its index, then 16 bytes: where the
index begins and a mark. The index maps the document keys of the shard one to one onto slots; a slot holds a
fingerprint of its key, which tells strangers, and the place of the document's ids. Finding a document takes a
few hashes and one read, however large the shard is.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docwarden.llm.common import blocks, new_folder, written
from docwarden.llm.tokens import crc32, encoder

MARK = b"DWTOKEN1"
SHARD_ROWS = 8192
READ_AT_ONCE = 32 << 20


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys (finaliser of splitmix64)."""
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def document_keys(ids: list[int | None]) -> np.ndarray:
    """Keys of documents in order of id: the id, and for rows that repeat it, which of them it is. Null counts as an id."""
    nth, before = [], object()
    for i in ids:
        nth.append(nth[-1] + 1 if nth and i == before else 0)
        before = i
    key = np.array([0 if i is None else i for i in ids], np.int64).view(np.uint64)
    null = np.array([i is None for i in ids], np.uint64)
    extra = np.array(nth, np.uint64) * np.uint64(2) + null
    return np.where(extra > 0, mixed(key ^ mixed(extra, 1), 2), key)


class PerfectHash:
    """Minimal perfect hash: levels of bits. A key that is alone at its place of a level gets the bit; others go on.

    A key's slot is the number of bits before its own.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = [np.append(0, np.cumsum(np.bitwise_count(bits), dtype=np.int64)) for bits in levels]
        self.base = np.append(0, np.cumsum([b[-1] for b in self.before], dtype=np.int64))

    @staticmethod
    def built(keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            bits = np.zeros(-(-2 * len(rest) // 64), np.uint64)
            at = (mixed(rest, 16 + len(levels)) % np.uint64(64 * len(bits))).astype(np.int64)
            alone = np.bincount(at, minlength=64 * len(bits))[at] == 1
            np.bitwise_or.at(bits, at[alone] >> 6, np.uint64(1) << (at[alone] & 63).astype(np.uint64))
            levels.append(bits)
            rest = rest[~alone]
        return PerfectHash(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for some strangers, any slot for others."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = (mixed(keys[left], 16 + level) % np.uint64(64 * len(bits))).astype(np.int64)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[here]] = (self.base[level] + self.before[level][at >> 6] + below)[here]
            left = left[~here]
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<Q", len(b)) + b.astype("<u8").tobytes() for b in self.levels)

    @staticmethod
    def from_bytes(data: memoryview) -> tuple[PerfectHash, int]:
        (n,), at, levels = struct.unpack_from("<I", data), 4, []
        for _ in range(n):
            (size,) = struct.unpack_from("<Q", data, at)
            levels.append(np.frombuffer(data, "<u8", size, at + 8).astype(np.uint64))
            at += 8 + 8 * size
        return PerfectHash(levels), at


SLOT = np.dtype([("fingerprint", "<u4"), ("length", "<u8"), ("offset", "<u8")])


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 7) >> np.uint64(32)).astype("<u4")


def _place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


class ShardWriter:
    def __init__(self, uri: str, width: int):
        self.fs, self.path = _place(uri)
        self.width = width
        # Written under a name of its own and then renamed: a repeated or doubled task leaves one whole file.
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.path.rpartition("/")[0])
        self.out = self.fs.open_output_stream(self.temporary)
        self.ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        if self.width == 2:
            wide = np.frombuffer(ids, "<u4")
            if len(wide) and int(wide.max()) >= 1 << 16:
                raise ValueError("an id needs more than 2 bytes")
            ids = wide.astype("<u2").tobytes()
        self.out.write(ids)

    def close(self) -> int:
        """Write the index; the number of ids in the shard."""
        keys = document_keys(self.ids)
        found = PerfectHash.built(keys)
        table = np.zeros(len(keys), SLOT)
        at = found.slots(keys)
        lengths = np.array(self.lengths, np.uint64)
        table["fingerprint"][at], table["length"][at], table["offset"][at] = _fingerprints(keys), lengths, np.cumsum(lengths) - lengths
        null = np.array([i is None for i in self.ids], np.uint8)
        plain = np.array([0 if i is None else i for i in self.ids], "<i8")
        index = struct.pack("<BQ", self.width, len(keys)) + found.to_bytes() + table.tobytes() + plain.tobytes() + null.tobytes()
        total = int(lengths.sum())
        self.out.write(index)
        self.out.write(struct.pack("<Q", total * self.width) + MARK)
        self.out.close()
        if self.fs.get_file_info(self.path).type == pyarrow.fs.FileType.NotFound:
            self.fs.move(self.temporary, self.path)
        else:
            # Another attempt at the same task was first; its file is the same.
            self.fs.delete_file(self.temporary)
        return total


class ShardReader:
    """Keyed access to one shard file."""

    def __init__(self, uri: str):
        fs, path = _place(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        begin, mark = struct.unpack("<Q8s", self.file.read_at(16, size - 16))
        if mark != MARK:
            raise ValueError(f"not a token file: {uri}")
        data = memoryview(self.file.read_at(size - 16 - begin, begin))
        self.width, n = struct.unpack_from("<BQ", data)
        self.hash, used = PerfectHash.from_bytes(data[9:])
        at = 9 + used
        self.table = np.frombuffer(data, SLOT, n, at)
        at += n * SLOT.itemsize
        ids = np.frombuffer(data, "<i8", n, at)
        null = np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.ids = [None if z else i for i, z in zip(ids.tolist(), null.tolist(), strict=True)]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each key whether it is there, its first id's number in the shard, and its number of ids."""
        at = self.hash.slots(keys)
        there = at >= 0
        row = self.table[np.where(there, at, 0)] if len(self.table) else np.zeros(len(keys), SLOT)
        there &= row["fingerprint"] == _fingerprints(keys)
        return there, row["offset"].astype(np.int64), row["length"].astype(np.int64)

    def read(self, offset: int, length: int) -> Iterator[bytes]:
        """The ids from ``offset`` on as unsigned 32-bit, in parts of bounded size."""
        for a in range(offset, offset + length, READ_AT_ONCE // 4):
            n = min(READ_AT_ONCE // 4, offset + length - a)
            data = self.file.read_at(n * self.width, a * self.width)
            yield data if self.width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()

    def get(self, doc_id: int | None, nth: int = 0) -> np.ndarray | None:
        """Ids of one document, or None if the shard has no such key."""
        there, offset, length = self.find(document_keys([doc_id] * (nth + 1))[-1:])
        return np.frombuffer(b"".join(self.read(int(offset[0]), int(length[0]))), "<u4") if there[0] else None


def write_tokens(
    docs: DataFrame, folder: str, path: str, end_id: int, id_width: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """Write shard files in ascending order of id (nulls first); the manifest: ``shard``, ``file``, ``n_docs``, ``n_tokens``, ``start``.

    One shuffle, by range of id; rows that share an id are in order of a hash of their text. Each task streams its documents to its file.
    ``folder`` is any place that tasks reach by URI; a cluster needs a shared one.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = blocks(docs.count(), shard_rows)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        end, writer = np.array([end_id], "<u4").tobytes(), None
        for batch in batches:
            if batch.num_rows and writer is None:
                writer = ShardWriter(f"{folder}/shard-{shard:06d}.tokens", id_width)
            for doc, ids in zip(batch["id"].to_pylist(), encoder(path)(batch["text"]), strict=True):
                writer.add(doc, ids + end)
        if writer is not None:
            total = writer.close()
            yield pa.record_batch({
                "shard": pa.array([shard], pa.int32()), "file": [f"{folder}/shard-{shard:06d}.tokens"],
                "n_docs": pa.array([len(writer.ids)], pa.int64()), "n_tokens": pa.array([total], pa.int64()),
            })

    # A hash stands for the text in the range, whose bounds the driver samples.
    order = (F.col("id").asc_nulls_first(), F.xxhash64("text").asc())
    ordered = docs.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    manifest = written(ordered.mapInArrow(write, "shard int, file string, n_docs long, n_tokens long"), "manifest")
    # One row per shard: small enough for a running sum in one place.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(manifest: DataFrame) -> DataFrame:
    """``id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document, each found in its shard by its key."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
                reader = ShardReader(uri)
                keys = document_keys(reader.ids)
                for i in range(0, len(keys), 4096):
                    ids = reader.ids[i : i + 4096]
                    there, offset, length = reader.find(keys[i : i + 4096])
                    if not there.all():
                        raise ValueError(f"keys missing from the index of {uri}")
                    crcs = []
                    for o, k in zip(offset.tolist(), length.tolist(), strict=True):
                        crc = 0
                        for part in reader.read(o, k):
                            crc = crc32(part, crc)
                        crcs.append(crc)
                    yield pa.record_batch({
                        "id": pa.array(ids, pa.int64()), "start": pa.array(offset + base), "n_tokens": pa.array(length), "ids_crc32": pa.array(crcs, pa.int64()),
                    })

    # A number of partitions that is given is kept: by its few bytes alone the manifest would be one task that reads all files.
    spread = manifest.select("shard", "file", "start").repartition(max(1, manifest.count()), "shard")
    return spread.mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long")


def stored_documents(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back: ``id``, ``start``, ``n_tokens``, ``ids_crc32``.

    ``start`` counts the ids of all documents before. Null and empty texts are the end id alone; null ids come first;
    rows that repeat an id follow each other in order of a hash of the text; an empty table gives no rows; other columns are ignored.
    """
    folder = new_folder(docs.sparkSession, "tokens")
    return read_documents(write_tokens(docs, folder, path, end_id, id_col=id_col, text_col=text_col))
