"""Alignment of two tokenizers over the same texts, and how often their ids meet.

A text's bytes are cut into ranges. The tokens that start in a range make a fragment: an open prefix up to the first offset
where tokens of both ends meet, closed groups, and an open suffix behind the last such offset; a range without one is
all open. Fragments are composed by closing what the suffix of one and the prefix of the next hold together, which is
associative, so the fragments of a very long document are made by tasks of their own and composed as a tree.
A short text is one range.

A document's links (pairs of overlapping tokens) are counted in the corpus by blocks of documents: a block names its
different pairs once, pairs are counted over blocks, and the counts return to the blocks that asked for them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.llm.bpe import byte_characters
from docwarden.llm.common import new_folder, written

#: Characters of a range; longer texts are aligned by several tasks.
RANGE = 1 << 16
#: How far from a range's end a place is looked for where texts may be cut before encoding.
NEAR = 1 << 12
#: Characters of texts that are aligned together.
AT_ONCE = 1 << 20
#: Links of a block of documents.
BLOCK_LINKS = 1 << 22
#: Fragments that one task of the tree composes.
FAN_IN = 8

# Fixed value: the pattern of byte-level tokenizers that keep one space in front of a word.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Neither tokenizer has a token across a space that stands between two characters that are not white space.
CUT = regex.compile(r"(?<=\S) (?=\S)")


# ------------------------------------------------------------------ tokens


class ByteLevel:
    """Tokenizer A: a byte-level BPE file. Its vocabulary is read as ranks where ids follow the order of the merges."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, before = told["model"], told.get("pre_tokenizer") or {}
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        special = {t["id"] for t in told.get("added_tokens") or []}
        tokens = {i: bytes(byte_of[c] for c in t) for t, i in model["vocab"].items() if i not in special}
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        usual = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if told.get("normalizer") or not usual or made != sorted(made) or not all(bytes([b]) in set(tokens.values()) for b in range(256)):
            raise ValueError("tokenizer A must be a byte-level BPE with the usual pattern, ids in order of its merges, and no normaliser")
        self.bytes = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.lengths = np.array([len(t) for t in self.bytes])
        ranks = {t: i for i, t in tokens.items()}
        self.encoding = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.encoding.encode_ordinary(t), np.int64) for t in texts]

    def same(self, ids: np.ndarray, text: bytes) -> bool:
        return True  # every byte is a token, and nothing is normalised


class Pieces:
    """Tokenizer B: a sentencepiece model, which puts a space in front of the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [self._bytes(i, p) for i, p in enumerate(pieces)]
        self.lengths = np.array([len(t) for t in self.bytes])
        #: False if a piece goes on behind a space, so that texts must be encoded whole.
        self.cut = not any(regex.search("[^▁]▁", p) for p in pieces)

    def _bytes(self, i: int, piece: str) -> bytes:
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Of texts that begin with the space that the model adds itself."""
        return [np.array(ids, np.int64) for ids in self.model.encode([t[1:] for t in texts], num_threads=1)]

    def same(self, ids: np.ndarray, text: bytes) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())) == text


_LOADED: dict[tuple[str, str], tuple[ByteLevel, Pieces]] = {}


def tokenizers(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    """One pair per Python worker."""
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = ByteLevel(a_path), Pieces(b_path)
    return _LOADED[a_path, b_path]


# ------------------------------------------------------------------ groups and links


@dataclass
class Tokens:
    """Neighbouring tokens of both tokenizers: ids, and the byte offsets at which they end."""

    a: np.ndarray
    a_end: np.ndarray
    b: np.ndarray
    b_end: np.ndarray

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate(x) for x in zip(self.parts(), other.parts(), strict=True)))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.a, self.a_end, self.b, self.b_end

    def common(self) -> np.ndarray:
        """Offsets where tokens of both end."""
        return self.a_end[np.isin(self.a_end, self.b_end, assume_unique=True)]

    def until(self, at: int) -> tuple[Tokens, Tokens]:
        i, j = np.searchsorted(self.a_end, at, "right"), np.searchsorted(self.b_end, at, "right")
        return Tokens(self.a[:i], self.a_end[:i], self.b[:j], self.b_end[:j]), Tokens(self.a[i:], self.a_end[i:], self.b[j:], self.b_end[j:])


def no_tokens() -> Tokens:
    return Tokens(*(np.zeros(0, np.int64) for _ in range(4)))


def links(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Of whole groups: the index of the A token and of the B token of every overlapping pair, in order."""
    start = np.concatenate([[-1], t.a_end[:-1]])
    b_start = np.concatenate([[-1], t.b_end[:-1]])
    first = np.searchsorted(t.b_end, start, "right")
    many = np.searchsorted(b_start, t.a_end, "left") - first
    i = np.repeat(np.arange(len(t.a)), many)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + first[i]


_WORDS: list[str] = []


def _decimals(highest: int) -> list[str]:
    """Each id behind a comma, a bar and a semicolon in turn."""
    for i in range(len(_WORDS) // 3, highest + 1):
        _WORDS.extend((f",{i}", f"|{i}", f";{i}"))
    return _WORDS


def written_groups(t: Tokens, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Of whole groups that end at ``ends``: the words ``;a1``, ``,a2``, ``|b1``, ``,b2``, ... and the group of each."""
    group = np.concatenate([np.searchsorted(ends, t.a_end), np.searchsorted(ends, t.b_end)])
    is_b = np.repeat([0, 1], [len(t.a), len(t.b)])
    order = np.argsort(group * 2 + is_b, kind="stable")
    ids, group, is_b = np.concatenate([t.a, t.b])[order], group[order], is_b[order]
    sign = np.zeros(len(ids), np.int64)
    sign[1:][is_b[1:] > is_b[:-1]] = 1
    sign[1:][is_b[1:] < is_b[:-1]] = 2
    sign[:1] = 2
    words = _decimals(int(ids.max(initial=0)))
    return list(map(words.__getitem__, (ids * 3 + sign).tolist())), group


def different(codes: np.ndarray, many: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in order, and how many of each."""
    if many is None:
        return np.unique(codes, return_counts=True)
    found, at = np.unique(codes, return_inverse=True)
    return found, np.bincount(at, many, len(found)).astype(np.int64)


def codes_of(t: Tokens) -> np.ndarray:
    i, j = links(t)
    return t.a[i] << 32 | t.b[j]


@dataclass
class Fragment:
    """The tokens that start in a byte range. ``bounded`` if it holds an offset where both end; else all is in ``prefix``."""

    bounded: bool
    prefix: Tokens
    suffix: Tokens
    groups: str
    n: np.ndarray  # A tokens, B tokens, groups, links of the closed groups
    codes: np.ndarray
    many: np.ndarray
    same: bool

    def write(self) -> bytes:
        head = {"bounded": self.bounded, "same": self.same, "n": self.n.tolist(), "groups": self.groups}
        arrays = [*self.prefix.parts(), *self.suffix.parts(), self.codes, self.many]
        head["sizes"] = [len(x) for x in arrays]
        told = json.dumps(head).encode()
        return len(told).to_bytes(8, "little") + told + b"".join(x.astype("<i8").tobytes() for x in arrays)

    @staticmethod
    def read(data: bytes) -> Fragment:
        size = int.from_bytes(data[:8], "little")
        head = json.loads(data[8 : 8 + size])
        flat = np.frombuffer(data, "<i8", offset=8 + size)
        arrays = np.split(flat, np.cumsum(head["sizes"])[:-1])
        return Fragment(
            head["bounded"], Tokens(*arrays[:4]), Tokens(*arrays[4:8]), head["groups"], np.array(head["n"]), arrays[8], arrays[9], head["same"]
        )


def closed(t: Tokens) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Whole groups as a fragment holds them: their words, counts, different pairs, and how many of each."""
    ends = t.common()
    codes = codes_of(t)
    found, many = different(codes)
    return "".join(written_groups(t, ends)[0]), np.array([len(t.a), len(t.b), len(ends), len(codes)]), found, many


def nothing(same: bool = True, at_start: bool = False) -> Fragment:
    """The fragment of no bytes; ``at_start``: that of the place before a text, where a group begins."""
    none = np.zeros(0, np.int64)
    return Fragment(at_start, no_tokens(), no_tokens(), "", np.zeros(4, np.int64), none, none, same)


def fragment(t: Tokens, same: bool = True) -> Fragment:
    """Of all tokens that start in a range."""
    ends = t.common()
    if not len(ends):
        out = nothing(same)
        out.prefix = t
        return out
    prefix, rest = t.until(ends[0])
    inner, suffix = rest.until(ends[-1])
    return Fragment(True, prefix, suffix, *closed(inner), same)


def compose(x: Fragment, y: Fragment) -> Fragment:
    """Of two neighbours; associative, with ``nothing()`` as its one."""
    if not (x.same and y.same):
        return nothing(False)
    middle = (x.suffix if x.bounded else x.prefix) + y.prefix
    if not x.bounded or not y.bounded:
        # Of a side without a bound, all is open. A bounded one's prefix ends where both end, so ``inner`` is bounded too.
        inner = fragment(middle)
        if not inner.bounded:
            return Fragment(True, x.prefix, middle, x.groups, x.n, x.codes, x.many, True) if x.bounded else inner
        if x.bounded:
            return Fragment(True, x.prefix, inner.suffix, *compose_closed(x, inner.prefix, inner), True)
        if y.bounded:
            return Fragment(True, inner.prefix, y.suffix, *compose_closed(inner, no_tokens(), y), True)
        return inner
    return Fragment(True, x.prefix, y.suffix, *compose_closed(x, middle, y), True)


def compose_closed(x: Fragment, middle: Tokens, y: Fragment) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Closed groups of ``x``, of ``middle`` and of ``y``."""
    groups, n, codes, many = closed(middle) if len(middle.a) else ("", np.zeros(4, np.int64), x.codes[:0], x.many[:0])
    found, total = different(np.concatenate([x.codes, codes, y.codes]), np.concatenate([x.many, many, y.many]))
    return x.groups + groups + y.groups, x.n + n + y.n, found, total


# ------------------------------------------------------------------ blocks of documents

#: A document: counts and digest, and its pairs as places in its block's list. A block: its list, and in how many of its documents each is.
ALIGNED = (
    "block string, row int, id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, refs binary, many binary,"
    " codes array<bigint>, docs array<int>"
)


class Blocks:
    """Gathers aligned documents and gives them out in blocks of about ``size`` links."""

    def __init__(self, name: str, id_type: pa.DataType, size: int):
        self.name, self.id_type, self.size, self.n = name, id_type, size, 0
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple] = []
        self.codes: list[np.ndarray] = []
        self.many: list[np.ndarray] = []
        self.links = 0

    def add(self, doc, n: list[int], groups: str, codes: np.ndarray, many: np.ndarray) -> None:
        self.rows.append((doc, *n, hashlib.sha256(groups.encode()).hexdigest() if n[0] else ""))
        self.codes.append(codes)
        self.many.append(many)
        self.links += len(codes) + 16

    def full(self) -> bool:
        return self.links >= self.size

    def out(self) -> pa.RecordBatch:
        name, n = f"{self.name}-{self.n}", len(self.rows)
        found, refs = np.unique(np.concatenate(self.codes), return_inverse=True)
        at = np.cumsum([len(c) for c in self.codes])[:-1]
        ids, *counts, sums = zip(*self.rows, strict=True)
        docs = np.bincount(refs, minlength=len(found)).astype(np.int32)
        none = [None]
        batch = pa.record_batch({
            "block": pa.array([name] * (n + 1)), "row": pa.array([*range(n), -1], pa.int32()), "id": pa.array([*ids, None], self.id_type),
            **{c: pa.array([*x, None], pa.int64()) for c, x in zip(("n_a", "n_b", "n_groups", "n_links"), counts, strict=True)},
            "groups_sha256": pa.array([*sums, None], pa.string()),
            "refs": pa.array([r.astype("<u4").tobytes() for r in np.split(refs, at)] + none, pa.binary()),
            "many": pa.array([m.astype("<u4").tobytes() for m in self.many] + none, pa.binary()),
            "codes": pa.array([None] * n + [found], pa.list_(pa.int64())), "docs": pa.array([None] * n + [docs], pa.list_(pa.int32())),
        })
        self.n += 1
        self.clear()
        return batch


def aligned_texts(ids: list, texts: list[str], tok: tuple[ByteLevel, Pieces]) -> Iterator[tuple]:
    """Each short text as one range: id, counts, groups, different pairs and how many of each. All texts of the call are worked on as
    one run of bytes, in which both tokenizers end where a text ends."""
    a_tok, b_tok = tok
    spaced = [" " + t for t in texts]
    b_ids = b_tok.encode(spaced)
    good = [bool(t) and b_tok.same(b, s.encode()) for t, s, b in zip(texts, spaced, b_ids, strict=True)]
    a_ids = a_tok.encode([s for s, g in zip(spaced, good, strict=True) if g])
    b_ids = [b for b, g in zip(b_ids, good, strict=True) if g]
    if a_ids:
        a, b = np.concatenate(a_ids), np.concatenate(b_ids)
        t = Tokens(a, np.cumsum(a_tok.lengths[a]), b, np.cumsum(b_tok.lengths[b]))
        a_stop, b_stop = (np.cumsum([len(x) for x in ids_]) for ids_ in (a_ids, b_ids))
        ends = t.common()
        doc_end = t.a_end[a_stop - 1]
        words, group = written_groups(t, ends)
        g_stop = np.searchsorted(ends, doc_end, "right")
        w_stop = np.searchsorted(group, g_stop, "left").tolist()
        i, j = links(t)
        l_stop = np.searchsorted(i, a_stop, "left")
        # Different pairs of each document, by one sort of (document, pair).
        code = t.a[i] << 32 | t.b[j]
        doc = np.repeat(np.arange(len(a_ids)), np.diff(l_stop, prepend=0))
        order = np.lexsort((code, doc))
        code, doc = code[order], doc[order]
        first = np.ones(len(code), bool)
        first[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(first)
        many, code, doc = np.diff(at, append=len(code)), code[at], doc[at]
        p_stop = np.searchsorted(doc, np.arange(len(a_ids)), "right")
        n_a, n_b, n_groups, n_links = (np.diff(x, prepend=0).tolist() for x in (a_stop, b_stop, g_stop, l_stop))
        codes, counts = np.split(code, p_stop[:-1]), np.split(many, p_stop[:-1])
    none = np.zeros(0, np.int64)
    k = 0
    for doc_id, g in zip(ids, good, strict=True):
        if not g:
            yield doc_id, [0, 0, 0, 0], "", none, none
            continue
        text = "".join(words[w_stop[k - 1] if k else 0 : w_stop[k]])
        yield doc_id, [n_a[k], n_b[k], n_groups[k], n_links[k]], text[1:], codes[k], counts[k]
        k += 1


# ------------------------------------------------------------------ very long texts


def ranges(text: str, size: int, near: int, cut: bool) -> Iterator[tuple[int, int, int, str]]:
    """Byte ranges of a text with a space before it: first and last byte of the range, first byte of the stretch that is encoded
    for it, and the stretch, which begins and ends where texts may be cut.

    A range ends wherever it does, in the middle of a word too, if there are places to cut at near by on both sides; else at the next such place.
    """
    text = " " + text
    stops: list[tuple[int, int, int]] = []  # end of the range, place to cut at before it, and behind it
    at = size
    while cut and at < len(text):
        before = [m.start() for m in CUT.finditer(text, max(at - near, 1), at)]
        behind = CUT.search(text, at)
        if behind is None:
            break
        stop = at if before and behind.start() - at <= near else behind.start()
        stops.append((stop, before[-1] if before and stop == at else stop, behind.start()))
        at = stop + size
    byte_at, here = [0], 0
    marks = sorted({m for s in stops for m in s} | {len(text)})
    for mark in marks:
        byte_at.append(byte_at[-1] + len(text[here:mark].encode()))
        here = mark
    byte_of = dict(zip([0, *marks], byte_at, strict=True))
    start, from_ = 0, 0
    for stop, before, behind in [*stops, (len(text), 0, len(text))]:
        yield byte_of[start], byte_of[stop], byte_of[from_], text[from_:behind]
        start, from_ = stop, before


def range_fragment(lo: int, hi: int, at: int, stretch: str, tok: tuple[ByteLevel, Pieces]) -> Fragment:
    """The fragment of the tokens that start in [lo, hi); ``stretch`` begins at byte ``at``."""
    found, same = [], True
    for t in tok:
        (ids,) = t.encode([stretch])
        same = same and t.same(ids, stretch.encode())
        ends = np.cumsum(t.lengths[ids]) + at
        start = ends - t.lengths[ids]
        i, j = np.searchsorted(start, [lo, hi])
        found += [ids[i:j], ends[i:j]]
    return fragment(Tokens(*found), True) if same else nothing(False)


def _long_aligned(df: DataFrame, a_path: str, b_path: str, id_type: str, size: int, near: int, block: int, fan_in: int) -> DataFrame:
    """Long texts of ``df`` (id, text), aligned by ranges in tasks of their own and composed as a tree."""
    docs = written(df.withColumn("key", F.monotonically_increasing_id()), "long-texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = tokenizers(a_path, b_path)[1].cut
        for batch in batches:
            for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for k, (lo, hi, at, stretch) in enumerate(ranges(text, size, near, whole)):
                    yield pa.record_batch({
                        "key": pa.array([key], pa.int64()), "part": pa.array([k], pa.int64()), "lo": pa.array([lo], pa.int64()),
                        "hi": pa.array([hi], pa.int64()), "at": pa.array([at], pa.int64()), "stretch": pa.array([stretch], pa.string()),
                    })

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(a_path, b_path)
        for batch in batches:
            for row in batch.to_pylist():
                f = range_fragment(row["lo"], row["hi"], row["at"], row["stretch"], tok)
                if row["part"] == 0:
                    f = compose(nothing(at_start=True), f)
                yield pa.record_batch({
                    "key": pa.array([row["key"]], pa.int64()), "part": pa.array([row["part"]], pa.int64()), "data": pa.array([f.write()], pa.binary()),
                })

    def up(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("part")
        f = None
        for chunk in parts["data"]:
            g = Fragment.read(chunk.as_py())
            f = g if f is None else compose(f, g)
        return pa.table({"key": parts["key"][:1], "part": pa.array([parts["part"][0].as_py() // fan_in], pa.int64()), "data": pa.array([f.write()], pa.binary())})

    stretches = docs.select("key", "text").mapInArrow(cut, "key long, part long, lo long, hi long, at long, stretch string")
    stretches = written(stretches, "stretches")
    fragments = "key long, part long, data binary"
    parts = written(stretches.repartition("key", "part").mapInArrow(leaf, fragments), "fragments")
    most = parts.agg(F.max("part")).first()[0] or 0
    while most > 0:
        parts = parts.groupBy("key", F.floor(F.col("part") / fan_in).alias("up")).applyInArrow(up, fragments)
        most //= fan_in
    whole = docs.select("key", "id").join(parts.select("key", "data"), "key")
    name = new_folder(df.sparkSession, "long").rsplit("-", 1)[1][:8]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = None
        for batch in batches:
            blocks = blocks or Blocks(f"{name}-{TaskContext.get().partitionId()}", batch.schema.field("id").type, block)
            for doc, data in zip(batch["id"].to_pylist(), batch["data"], strict=True):
                f = Fragment.read(data.as_py())
                if f.same:
                    blocks.add(doc, f.n.tolist(), f.groups[1:], f.codes, f.many)
                else:
                    blocks.add(doc, [0, 0, 0, 0], "", f.codes[:0], f.many[:0])
                if blocks.full():
                    yield blocks.out()
        if blocks is not None and blocks.rows:
            yield blocks.out()

    return whole.select("id", "data").mapInArrow(gather, ALIGNED.format(id=id_type))


# ------------------------------------------------------------------ the corpus


def aligned_blocks(
    df: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, size: int = RANGE, near: int = NEAR, block: int = BLOCK_LINKS, fan_in: int = FAN_IN
) -> DataFrame:
    """Documents and blocks as ``ALIGNED`` tells, written and read again."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    is_long = F.coalesce(F.length("text") >= size, F.lit(False))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, blocks = tokenizers(a_path, b_path), None
        for batch in batches:
            blocks = blocks or Blocks(f"p-{TaskContext.get().partitionId()}", batch.schema.field("id").type, block)
            ids, texts, i = batch["id"].to_pylist(), [t or "" for t in batch["text"].to_pylist()], 0
            while i < len(ids):
                j, chars = i, 0
                while j < len(ids) and chars < AT_ONCE:
                    chars += len(texts[j])
                    j += 1
                for row in aligned_texts(ids[i:j], texts[i:j], tok):
                    blocks.add(*row)
                    if blocks.full():
                        yield blocks.out()
                i = j
        if blocks is not None and blocks.rows:
            yield blocks.out()

    short = docs.where(~is_long).mapInArrow(align, ALIGNED.format(id=id_type))
    return written(short.union(_long_aligned(docs.where(is_long), a_path, b_path, id_type, size, near, block, fan_in)), "aligned")


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "id", text_col: str = "text", **sizes: int) -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    Tokenizer A is a byte-level BPE file, B a sentencepiece model; both see a space and the text, and strings of special tokens
    are ordinary text. Offsets where tokens of both end cut them into groups; tokens of both that overlap are linked. A pair's
    count is the number of rows that hold it. ``count_sum`` adds the counts of a row's links; ``n_best`` counts links whose
    count is the highest that their A id has anywhere. Null and empty texts, and texts that B's pieces do not spell, have no tokens:
    zeros and an empty digest. Every row is a document, also where ids repeat or are null; other columns are not used.
    """
    rows = aligned_blocks(df, a_path, b_path, id_col, text_col, **sizes)
    named = rows.where("row = -1").select("block", F.posexplode(F.arrays_zip("codes", "docs")).alias("pos", "p")).select(F.col("block").alias("asker"), "pos", "p.*")
    counts = named.groupBy(F.col("codes").alias("code")).agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("code", 32))
    # One row per id of tokenizer A: bounded by its vocabulary.
    best = counts.groupBy("a").agg(F.max("n").alias("best"))
    counts = counts.join(F.broadcast(best), "a").select("code", "n", (F.col("n") == F.col("best")).alias("is_best"))
    answered = named.join(counts, F.col("codes") == F.col("code")).select("asker", "pos", "n", "is_best")
    id_type = rows.schema["id"].dataType.simpleString()

    def tell(docs: pa.Table, answers: pa.Table) -> pa.Table:
        size = answers.num_rows
        n, is_best = np.zeros(size, np.int64), np.zeros(size, bool)
        pos = answers["pos"].to_numpy()
        n[pos], is_best[pos] = answers["n"].to_numpy(), answers["is_best"].to_numpy()
        sums, bests = [], []
        for refs, many in zip(docs["refs"], docs["many"], strict=True):
            r, m = np.frombuffer(refs.as_py(), "<u4"), np.frombuffer(many.as_py(), "<u4").astype(np.int64)
            sums.append(int((n[r] * m).sum()))
            bests.append(int(m[is_best[r]].sum()))
        kept = docs.select(["id", "n_a", "n_b", "n_groups", "n_links"])
        return kept.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64())).append_column(
            "groups_sha256", docs["groups_sha256"].combine_chunks()
        )

    kept = rows.where("row >= 0").select("block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "refs", "many")
    told = kept.groupBy("block").cogroup(answered.groupBy("asker")).applyInArrow(
        tell, f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
    return told.withColumnRenamed("id", id_col)
