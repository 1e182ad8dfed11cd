"""BPE with word ends, where long unsplit text is encoded as a tree of halves.

A word that the pre-tokenizer leaves whole is cut into halves until they are short. The leaves are rows, encoded by
tasks of their own. Going up the tree, two neighbours are joined by encoding a window around the join anew: a few tokens
of the left and of the right, twice as many each time until the window begins with the left's own token and ends with
the right's own. Then every two neighbouring tokens of the whole stand in the encoding of a text that holds both, and a
sequence of which that is true is the encoding: merges run in order of rank, so no merge crosses a boundary in the whole that
crosses it in none of the pairs. A window that never agrees grows to the whole word, so the result is always the library's.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from string import punctuation

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.llm.bpe import byte_characters
from docwarden.llm.common import free_name, written

#: Characters of a leaf; texts without a longer run of non-white space are encoded whole where they are read.
LEAF = 1 << 14
#: Characters of text that are encoded in one call of the library.
AT_ONCE = 1 << 19
#: Words remembered per Python worker; those not met for long are forgotten, which changes no result.
REMEMBERED = 800_000
#: Tokens of either side in the first window around a join.
WINDOW = 4

# Fixed value: a pre-tokenizer's pattern that keeps no white space, so that texts may be cut at spaces.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Behind the Latin letters that have no other normal form.
LATIN_END = "\u0250"
PART = "key long, part int, words array<string>, joined boolean, open boolean, special int"


class TreePairs:
    """A tokenizer file's BPE: whole texts, leaves of a word, and joins of neighbours."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs a worker per core.
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = told["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        alphabet = byte_characters()
        if model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("halves can be joined only where words are encoded by merges alone")
        if not all(c in model["vocab"] and c + self.suffix in model["vocab"] for c in alphabet):
            raise ValueError("the vocabulary must hold every byte, within a word and at its end")
        added = told.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("special tokens must be plain strings")
        self.special = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, longest_first)) or r"(?!)")
        bare = told | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}
        self.closed_model = Tokenizer.from_str(json.dumps(bare))
        self.open_model = Tokenizer.from_str(json.dumps(bare | {"model": model | {"end_of_word_suffix": None}}))
        self.at_spaces = self._cut_at_spaces(told)
        self.token = self.tokenizer.id_to_token
        # What half of the memory holds becomes the older half when it is full; words met again move back.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.marks = {"": b""}
        self.mapped = {i: c for i, c in enumerate(alphabet)}
        names = [self.token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.ends = np.array([t.endswith(self.suffix) for t in names])
        self.at_spaces = self.at_spaces and bool(self.suffix)

    def _cut_at_spaces(self, told: dict) -> bool:
        """True if a text's ids are those of its words, cut at spaces and line ends."""
        normal = told.get("normalizer") or {"normalizers": []}
        steps = [n["type"] for n in normal.get("normalizers", [normal])]
        split, *_ = (told.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        whole = split.get("pattern") == {"Regex": WORDS} and split.get("behavior") == "Removed" and split.get("invert")
        return bool(whole) and set(steps) <= {"NFC", "Replace", "Lowercase"} and not any(" " in t for t in self.special)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of whole texts, in blocks; null is empty."""
        block: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if size + len(text) > AT_ONCE and block:
                yield from self._block(block)
                block, size = [], 0
            block.append(text)
            size += len(text)
        yield from self._block(block)

    def _block(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Where texts may be cut at spaces, they are put together from their words, and a word is encoded once."""
        if not self.at_spaces:
            yield from (np.array(ids, "<u4") for ids in self._whole(texts))
            return
        split = [t.replace("\n", " ").split(" ") for t in texts]
        words = set().union(*split)
        if len(self.words) + len(words) > REMEMBERED // 2:
            self.words, self.older = {}, self.words
        known, older = self.words, self.older
        new = [w for w in words if w not in known]
        known.update((w, older[w]) for w in new if w in older)
        new = [w for w in new if w not in older]
        self._learn([w for w in new if w not in older])
        # A dict of the words at hand fits the processor's caches, the memory of all words does not.
        get = {w: known[w] for w in words}.__getitem__
        for parts in split:
            yield np.frombuffer(b"".join(map(get, parts)), "<u4")

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of words. Latin letters with marks behind them are lower-cased here and split from the marks; of them
        composed letters stay as they are in normal form C."""
        known, plain, other = self.words, [], []
        for w in words:
            bare = w.rstrip(punctuation)
            low = bare.lower()
            if low.isalpha() and (low.isascii() or max(low) < LATIN_END):
                plain.append((w, low, w[len(bare) :]))
            else:
                other.append(w)
        for some, into in ((other, known), (list({m for _, _, m in plain if m not in self.marks}), self.marks)):
            for i in range(0, len(some), 10_000):
                part = some[i : i + 10_000]
                into.update((w, np.array(ids, "<u4").tobytes()) for w, ids in zip(part, self._whole(part), strict=True))
        letters, marks = self.letters, self.marks
        if len(letters) > REMEMBERED // 2:
            letters = self.letters = {}
        new = list({b for _, b, _ in plain if b not in letters})
        if new:
            mapped = [b if b.isascii() else b.encode().decode("latin-1").translate(self.mapped) for b in new]
            ids = np.array(self.closed_model.encode(mapped, is_pretokenized=True, add_special_tokens=False).ids, "<u4")
            # A word ends with the one token that has the ending of words.
            stop = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            data = ids.tobytes()
            letters.update(zip(new, (data[i:j] for i, j in zip([0, *stop], stop)), strict=True))
        known.update((w, letters[b] + marks[m]) for w, b, m in plain)
        if len(marks) > REMEMBERED // 8:
            self.marks = {"": b""}

    def leaves(self, text: str, leaf: int) -> Iterator[tuple[list[str] | None, bool, bool, int | None]]:
        """The parts of a text in order: words (in the characters of the vocabulary), whether the first continues the part
        before, whether the last goes on in the next, and the id if the part is a special token."""
        at = 0
        for found in [*self.specials.finditer(text), None]:
            yield from self._words(text[at : found.start() if found else len(text)], leaf)
            if found:
                yield None, False, False, self.special[found[0]]
                at = found.end()

    def _words(self, text: str, leaf: int) -> Iterator[tuple[list[str], bool, bool, None]]:
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        words: list[str] = []
        size = 0
        for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            if size + len(word) > leaf and words:
                yield words, False, False, None
                words, size = [], 0
            if len(word) > leaf:
                pieces = halves(word, leaf)
                yield from (([p], i > 0, i + 1 < len(pieces), None) for i, p in enumerate(pieces))
            else:
                words.append(word)
                size += len(word)
        if words:
            yield words, False, False, None

    def leaf_ids(self, words: list[str], is_open: bool) -> list[int]:
        if is_open:
            return self.open_model.encode(words[0], add_special_tokens=False).ids
        return self.closed_model.encode(words, is_pretokenized=True, add_special_tokens=False).ids

    def join(self, left: list[int], right: list[int], is_open: bool) -> list[int]:
        """The ids of two neighbouring parts of a word; ``is_open`` if the word goes on behind them."""
        n = WINDOW
        while True:
            i, j = min(n, len(left)), min(n, len(right))
            ends_open = is_open or j < len(right)
            text = "".join(map(self.token, left[-i:] + right[:j]))
            if not ends_open and self.suffix:
                text = text[: -len(self.suffix)]
            window = self.leaf_ids([text], ends_open)
            agree_left = i == len(left) or window[0] == left[-i]
            agree_right = j == len(right) or window[-1] == right[j - 1]
            if agree_left and agree_right:
                return left[: len(left) - i] + window + right[j:]
            n *= 2

    def tree(self, parts: list[list[int]]) -> list[int]:
        """The ids of a word from those of its leaves, joined two by two, level by level."""
        while len(parts) > 1:
            last = len(parts) - 2
            up = [self.join(parts[i], parts[i + 1], i < last) for i in range(0, len(parts) - 1, 2)]
            parts = up + parts[len(up) * 2 :]
        return parts[0]

    def decode(self, ids: np.ndarray) -> str:
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def halves(word: str, leaf: int) -> list[str]:
    """``word`` cut in the middle again and again until no part is longer than ``leaf``."""
    if len(word) <= leaf:
        return [word]
    middle = len(word) // 2
    return halves(word[:middle], leaf) + halves(word[middle:], leaf)


_LOADED: dict[str, TreePairs] = {}


def tree_pairs(path: str) -> TreePairs:
    """One per path and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = TreePairs(path)
    return _LOADED[path]


def _unsplit(text: Column, leaf: int) -> Column:
    """True for texts with a run of more than ``leaf`` characters that are not white space."""
    return F.coalesce((F.length(text) > leaf) & text.rlike(rf"(?<!\S)\S{{{leaf + 1}}}"), F.lit(False))


def _tree_encoded(df: DataFrame, path: str, text_col: str, to: str, leaf: int) -> DataFrame:
    """``df`` with the ids of each text, whose leaves are encoded by tasks of their own."""
    key = free_name(df, "key")
    docs = written(df.withColumn(key, F.monotonically_increasing_id()), "unsplit")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
                parts = list(tree_pairs(path).leaves(text, leaf))
                for i in range(0, len(parts), 64):
                    words, joined, is_open, special = zip(*parts[i : i + 64], strict=True)
                    n = len(words)
                    yield pa.record_batch({
                        "key": pa.array([k] * n, pa.int64()), "part": pa.array(range(i, i + n), pa.int32()), "words": pa.array(words, pa.list_(pa.string())),
                        "joined": pa.array(joined), "open": pa.array(is_open), "special": pa.array(special, pa.int32()),
                    })

    @F.pandas_udf("array<int>")
    def encode(words: pd.Series, joined: pd.Series, is_open: pd.Series, special: pd.Series) -> pd.Series:
        pairs = tree_pairs(path)
        rows = zip(words, is_open, special, strict=True)
        return pd.Series([[int(s)] if w is None else pairs.leaf_ids(list(w), o) for w, o, s in rows], dtype=object)

    def combine(parts: pa.Table) -> pa.Table:
        pairs = tree_pairs(path)
        parts = parts.sort_by("part")
        ids: list[int] = []
        word: list[list[int]] = []
        for more, is_open in zip(parts["ids"].to_pylist(), parts["open"].to_pylist(), strict=True):
            word.append(more)
            if not is_open:
                ids += pairs.tree(word)
                word = []
        return pa.table({"key": parts["key"][:1], "ids": [np.array(ids, "<u4").tobytes()]})

    leaves = docs.select(F.col(key).alias("key"), F.col(text_col).alias("text")).mapInArrow(cut, PART)
    leaves = written(leaves, "leaves").repartition("key", "part")
    encoded = leaves.select("key", "part", "open", encode("words", "joined", "open", "special").alias("ids"))
    whole = encoded.groupBy("key").applyInArrow(combine, "key long, ids binary")
    # A text of which nothing is left after splitting has no parts.
    joined = docs.join(whole.select(F.col("key").alias(key), F.col("ids").alias(to)), key, "left").drop(key)
    return joined.withColumn(to, F.coalesce(to, F.lit(bytearray())))


def encode_texts(df: DataFrame, path: str, text_col: str = "text", to: str = "ids", leaf: int = LEAF) -> DataFrame:
    """``df`` with the ids of each text (binary, little-endian unsigned 32-bit) as the tokenizers library gives them, special
    tokens inside texts included.

    Null and empty texts have none. Rows that repeat are encoded each. Rows keep all columns; a column named ``to`` is replaced.
    Texts with a run longer than ``leaf`` that no white space interrupts are encoded as trees; the result does not depend on ``leaf``.
    """

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([ids.tobytes() for ids in tree_pairs(path).encode(texts)], dtype=object)

    df = df.drop(to) if to != text_col else df
    unsplit = _unsplit(F.col(text_col), leaf)
    plain = df.where(~unsplit).withColumn(to, encode(F.col(text_col)))
    return plain.unionByName(_tree_encoded(df.where(unsplit), path, text_col, to, leaf))


def decode_ids(df: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the text that ids stand for, special tokens kept; null ids give null. A column named ``to`` is replaced."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        return pd.Series([None if i is None else tree_pairs(path).decode(np.frombuffer(i, "<u4")) for i in ids], dtype=object)

    return df.withColumn(to, decode(F.col(ids_col)))


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest(pairs: TreePairs, ids: np.ndarray) -> tuple[int, str, str]:
    decimal = " ".join(map(str, ids.tolist())).encode()
    return len(ids), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(pairs.decode(ids).encode()).hexdigest()


def digests(df: DataFrame, path: str, text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """``df`` without its text, with ``n_tokens``, ``ids_sha256`` (decimal ids joined by a space) and ``decoded_sha256``; columns of
    these names are replaced. The same encoding as ``encode_texts``, for where ids themselves are not wanted."""

    def rows(found: Iterable[np.ndarray]) -> pd.DataFrame:
        pairs = tree_pairs(path)
        return pd.DataFrame([_digest(pairs, ids) for ids in found], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    @F.pandas_udf(DIGESTS)
    def of_texts(texts: pd.Series) -> pd.DataFrame:
        return rows(tree_pairs(path).encode(texts))

    @F.pandas_udf(DIGESTS)
    def of_ids(ids: pd.Series) -> pd.DataFrame:
        return rows(np.frombuffer(i, "<u4") for i in ids)

    df = df.drop("n_tokens", "ids_sha256", "decoded_sha256")
    kept = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    ids, told = free_name(df, "ids"), free_name(df, "told")
    unsplit = _unsplit(F.col(text_col), leaf)
    plain = df.where(~unsplit).withColumn(told, of_texts(F.col(text_col)))
    tree = _tree_encoded(df.where(unsplit), path, text_col, ids, leaf).withColumn(told, of_ids(F.col(ids)))
    return plain.select(*kept, f"{told}.*").unionByName(tree.select(*kept, f"{told}.*"))
