"""Token ids of whole texts by the tokenizers library, and ids as bytes."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from docwarden.llm.bpe import byte_characters

#: Pieces remembered per Python worker, and bytes of them and their ids; a full memory keeps those of the texts at hand, which
#: changes no result.
REMEMBERED_PIECES = 300_000
REMEMBERED = 64 << 20
#: Pieces encoded by one call, for which the library takes some hundred bytes each.
LEARNED_AT_ONCE = 16_384
#: Bytes of text that are cut and encoded together.
AT_ONCE = 2_000_000

# Kinds of characters, as the usual pattern of byte-level tokenizers tells them apart.
SPACE, LETTER, DIGIT, OTHER, UNKNOWN = range(5)


class Pieces:
    """Where byte-level tokenizers with the usual pattern cut texts before merging, for many texts at once.

    The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Which characters
    are letters, digits and white space is asked of the library, once for each that occurs.
    """

    def __init__(self, pre_tokenizer):
        self.cut = pre_tokenizer.pre_tokenize_str
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self._ask(np.arange(128))

    def _ask(self, points: np.ndarray) -> None:
        # A character is of the kind of the letter, digit or mark from which it is not cut off.
        asked = "".join(f"a{c} 1{c} !{c}\n" for c in map(chr, points.tolist()))
        cut_off = np.zeros(len(asked) + 1, bool)
        cut_off[[start for _, (start, _) in self.cut(asked)]] = True
        after = cut_off[:-1].reshape(-1, 9)
        self.kinds[points] = np.select([~after[:, 1], ~after[:, 4], ~after[:, 7]], [LETTER, DIGIT, OTHER], SPACE)

    def _kinds(self, data: np.ndarray) -> np.ndarray:
        """The kind of the character that each byte belongs to."""
        kinds = self.kinds[data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            byte = data[lead].astype(np.int32)
            more = [data[np.minimum(lead + k, len(data) - 1)].astype(np.int32) & 0x3F for k in (1, 2, 3)]
            two, three = (byte & 0x1F) << 6 | more[0], (byte & 0x0F) << 12 | more[0] << 6 | more[1]
            points = np.where(byte < 0xE0, two, np.where(byte < 0xF0, three, (byte & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2]))
            unknown = points[self.kinds[points] == UNKNOWN]
            if len(unknown):
                self._ask(np.unique(unknown))
            kind = self.kinds[points]
            kinds[lead], kinds[lead + 1] = kind, kind
            for k, least in ((2, 0xE0), (3, 0xF0)):
                wide = byte >= least
                kinds[lead[wide] + k] = kind[wide]
        return kinds

    def __call__(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where the pieces of texts that follow each other in ``data`` (UTF-8) and begin at ``starts`` begin."""
        n = len(data)
        kinds = self._kinds(data)
        first = np.zeros(n + 3, bool)
        first[starts] = True
        first[n:] = True
        cut = first.copy()
        cut[1:n] |= kinds[1:] != kinds[:-1]
        # The last white space before other characters stands alone; a blank goes with what follows it.
        last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & ~first[1:n])
        blank = data[last] == 0x20
        cut[last[blank]] = True
        cut[last[blank] + 1] = False
        begin = last[~blank]
        for _ in range(3):
            begin = begin - ((data[begin] & 0xC0) == 0x80)
        cut[begin] = True
        # An apostrophe that a piece begins with takes certain endings along.
        mark = np.flatnonzero(data == 0x27)
        mark = mark[cut[mark]]
        one, two = (np.append(data, [0, 0, 0])[mark + k] for k in (1, 2))
        short = ~first[mark + 1] & np.isin(one, list(b"stmd"))
        long = ~first[mark + 1] & ~first[mark + 2] & (((two == ord("e")) & np.isin(one, list(b"rv"))) | ((one == ord("l")) & (two == ord("l"))))
        for found, end in ((mark[short], 2), (mark[long], 3)):
            cut[found + 1] = False
            end = found + end
            end = end[end < n]
            cut[end[kinds[end] == LETTER]] = True
        return np.flatnonzero(cut[:n])


class Encoder:
    """The ids of whole texts as bytes (little-endian unsigned 32-bit), equal to one call of the library for each.

    Byte-level tokenizers with the usual pattern merge only inside the pieces that it cuts. So texts are cut, many at once,
    and put together from their different pieces; pieces not met before are encoded by the library, those of a block of texts
    in few calls, as the printable characters that stand for their bytes. Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str):
        # Spark already runs a worker per core.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.by_piece = (
            told.get("normalizer") is None
            and usual.items() <= (told.get("pre_tokenizer") or {}).items()
            and told["model"].get("type") == "BPE"
            and all(c in told["model"]["vocab"] for c in byte_characters())
            and all(t["special"] for t in told.get("added_tokens") or ())
        )
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        if self.by_piece:
            self.pieces = Pieces(self.tokenizer.pre_tokenizer)
            characters = byte_characters()
            self.mapped = np.array([ord(c) for c in characters], "<u4")
            # The byte 0xFF is in no UTF-8 text, so its token stands between pieces only.
            self.merger = Tokenizer(self.tokenizer.model)
            self.merger.pre_tokenizer = Split(characters[0xFF], "isolated")
            self.between = self.tokenizer.token_to_id(characters[0xFF])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learned(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each of these pieces, which are remembered."""
        characters = self.mapped[np.frombuffer(b"\xff".join(pieces), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.merger.encode_batch_fast([characters], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(ids == self.between) * 4
        ids, ends = ids.tobytes(), zip([0, *(at + 4).tolist()], [*at.tolist(), 4 * len(ids)], strict=True)
        found = [ids[i:j] for i, j in ends]
        self.held += sum(map(len, pieces)) + len(ids)
        self.known.update(zip(pieces, found, strict=True))
        return found

    def _by_pieces(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        """Ids of the texts that lie in ``data`` between ``offsets``."""
        if not len(data):
            yield from [b""] * (len(offsets) - 1)
            return
        at = self.pieces(data, offsets)
        ends = np.append(at, len(data)).astype("<i4")
        cut = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        _, places, held = cut.dictionary.buffers()
        places, held = np.frombuffer(places, "<i4", len(cut.dictionary) + 1).tolist(), held.to_pybytes()
        pieces = [held[i:j] for i, j in zip(places, places[1:])]
        ids = list(map(self.known.get, pieces))
        new = [p for p, i in zip(pieces, ids, strict=True) if i is None]
        if new:
            if len(self.known) + len(new) > REMEMBERED_PIECES or self.held > REMEMBERED:
                self.known = {p: i for p, i in zip(pieces, ids, strict=True) if i is not None}
                self.held = sum(map(len, self.known)) + sum(map(len, self.known.values()))
            found = iter([i for k in range(0, len(new), LEARNED_AT_ONCE) for i in self._learned(new[k : k + LEARNED_AT_ONCE])])
            ids = [next(found) if i is None else i for i in ids]
        joined = pa.array(ids, pa.large_binary()).take(cut.indices)
        _, places, held = joined.buffers()
        ends = np.frombuffer(places, "<i8")[np.searchsorted(at, offsets)].tolist()
        held = memoryview(held)
        for i, j in zip(ends, ends[1:]):
            yield bytes(held[i:j])

    def rest(self) -> None:
        """Forget all pieces, where other work follows in the same Python workers: idle ones keep their memory."""
        self.known, self.held = {}, 0

    def __call__(self, texts: pa.Array | Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text in turn. Null is empty."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not self.by_piece:
            yield from (self._whole(t) if t else b"" for t in texts.to_pylist())
            return
        # No null has any bytes then, and buffers begin with the first text.
        texts = pa.concat_arrays([texts.fill_null("").cast(pa.large_string())])
        texts.validate(full=True)
        _, places, held = texts.buffers()
        offsets = np.frombuffer(places, "<i8")[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(held or b"", np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + AT_ONCE, "right")) - 1)
            yield from self._by_pieces(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            i = j


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per path and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def crc32(ids: bytes, before: int = 0) -> int:
    return zlib.crc32(ids, before)
