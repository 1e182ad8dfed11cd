"""Byte-level BPE by sentencepiece: a BPE model written straight from a vocabulary of ranks.

Each token's bytes are mapped to printable characters, one each; a piece's score is its negative rank, so that the
best-scored merge is the one of lowest rank; normalisation is the identity. Texts are cut into pre-tokens by a
pattern, and each pre-token is encoded by itself. Decoding maps ids back to their bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.llm.common import free_name

#: Pre-tokens remembered per Python worker; a full memory is emptied, which changes no result.
REMEMBERED = 250_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next free one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(other)) for b in range(256)]


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer message."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank, of a file with a base64 token and its rank on each line. Ranks are 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [t for _, t in pairs]


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model; ids are ranks, and one unknown piece comes after them."""
    mapped = byte_characters()
    # Field numbers and piece kinds (1 normal, 2 unknown; model kind 2 is BPE) of the model's format.
    pieces = [
        _field(1, _field(1, "".join(mapped[b] for b in t).encode()) + _field(2, float(-rank)) + _field(3, 1)) for rank, t in enumerate(tokens)
    ]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(n, 2**64 - 1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class BytePairs:
    """Encode and decode whole texts with a vocabulary of ranks and a pattern of pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.tokens = read_ranks(path)
        self.rank = {t: r for r, t in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        self.pattern = regex.compile(pattern)
        self.mapped = byte_characters()
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        mapped = self.mapped
        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        found = self.model.encode(["".join([mapped[b] for b in d]) for d in data], out_type=int, num_threads=1)
        # A pre-token that is a token is that token, also if no merges lead there.
        whole = map(self.rank.get, data)
        self.known.update((p, np.array([w] if w is not None else ids, "<u4").tobytes()) for p, w, ids in zip(pieces, whole, found, strict=True))

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit. Null is empty."""
        for text in texts:
            pieces = self.pattern.findall(text or "")
            new = [p for p in set(pieces) if p not in self.known]
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = list(set(pieces))
            if new:
                self._learn(new)
            yield b"".join(map(self.known.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], BytePairs] = {}


def byte_pairs(path: str, pattern: str) -> BytePairs:
    """One encoder per vocabulary, pattern and Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = BytePairs(path, pattern)
    return _LOADED[path, pattern]


def encode_texts(df: DataFrame, path: str, pattern: str, text_col: str = "text", to: str = "ids") -> DataFrame:
    """``df`` with the ids of each text (binary, little-endian unsigned 32-bit). Null and empty texts have none."""

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(list(byte_pairs(path, pattern).encode(texts)), dtype=object)

    return df.withColumn(to, encode(F.col(text_col)))


def decode_ids(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the bytes that ids stand for; null ids give null."""

    @F.pandas_udf("binary")
    def decode(ids: pd.Series) -> pd.Series:
        return pd.Series([None if i is None else byte_pairs(path, pattern).decode(i) for i in ids], dtype=object)

    return df.withColumn(to, decode(F.col(ids_col)))


def digests(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each text, encoded and decoded in one pass.

    The same encoding as ``encode_texts``, for where ids themselves are not wanted: only digests leave Python.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def of(texts: pd.Series) -> pd.DataFrame:
        pairs = byte_pairs(path, pattern)
        rows = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(pairs.decode(ids)).hexdigest()) for ids in pairs.encode(texts)]
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    made = free_name(df, "digests")
    kept = [c for c in df.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    return df.withColumn(made, of(F.col(text_col))).select(*(F.col(f"`{c}`") for c in kept), f"{made}.*")
