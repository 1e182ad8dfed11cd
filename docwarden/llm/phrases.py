"""Phrases that stand together more often than their parts explain.

Words are counted first; those frequent enough get ids, and texts are written again as ids. Phrases are then counted length by
length: only where both phrases of one word less are frequent, since no phrase is more frequent than its parts. What is
frequent is asked of a bitmap of fixed size, whose chance hits cost a count that is dropped afterwards and change nothing.

A task counts in a HAT-trie: a shallow trie over word ids whose leaves are hash containers of the rest of the phrase.
A container that grows too full bursts into one per next word; when all hold too much, whole subtrees, the largest
first, leave as runs sorted by phrase. The runs of all tasks meet by prefix (the first two words) and are merged there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docwarden.llm.common import written

#: Bytes of texts (of one language) that share a list of words.
BLOCK_BYTES = 1 << 24
#: Phrases in a container before it bursts, and in all containers of a task before subtrees leave.
BURST, HELD = 1 << 12, 1 << 19
#: Bits of a bitmap of frequent phrases: 2 MB. Results do not depend on it; more data are counted faster with more.
BITS = 24
#: Parts to which words are dealt by hash to be counted and numbered.
PARTS = 4096
#: The language of rows without one.
NO_LANGUAGE = "und"

# Where pieces end, what separates words, and the letters that are lower-cased. All are single bytes in UTF-8.
PIECE_END = b".,;:!?\x0a\x0b\x0c\x0d"
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: Stands for any piece end once texts are prepared; no text in UTF-8 holds this byte. It is a word of its own.
END = b"\xff"
PREPARED = bytes.maketrans(PIECE_END + UPPER + b"\t", END * len(PIECE_END) + LOWER + b" ")


# ------------------------------------------------------------------ texts as ids


def packed(codes: np.ndarray) -> bytes:
    """Codes as bytes; the most frequent are the smallest, so their upper bytes are mostly zero."""
    return pa.compress(codes.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, many: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * many, codec="zstd"), "<i4")


class WordBlock:
    """Texts of one language as places in a list of their different words, the most frequent first; 0 ends a piece."""

    def __init__(self):
        self.place: dict[bytes, int] = {END: 0}
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        words = text.translate(PREPARED).replace(END, b" \xff ").split()
        words.append(END)
        place = self.place
        for w in set(words).difference(place):
            place[w] = len(place)
        self.codes.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
        self.size += len(text)

    def out(self, lang: str, name: str) -> pa.RecordBatch:
        codes = np.concatenate(self.codes)
        words = list(self.place)
        many = np.bincount(codes, minlength=len(words))
        order = np.concatenate([[0], 1 + np.argsort(-many[1:], kind="stable")])
        new = np.empty_like(order)
        new[order] = np.arange(len(order))
        in_order = [words[i] for i in order[1:].tolist()]
        return pa.record_batch({
            "block": pa.array([name]), "lang": pa.array([lang]), "size": pa.array([len(codes)], pa.int64()), "codes": pa.array([packed(new[codes])], pa.binary()),
            "words": pa.array([in_order], pa.list_(pa.binary())).cast(pa.list_(pa.string())), "many": pa.array([many[order[1:]]], pa.list_(pa.int64())),
        })


def word_blocks(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """Blocks of texts of a language: ``block``, ``lang``, ``size``, ``codes``, ``words``, ``many`` (occurrences of each word)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, WordBlock] = {}
        n, size = 0, 0

        def done(lang: str) -> pa.RecordBatch:
            nonlocal n, size
            block = blocks.pop(lang)
            n, size = n + 1, size - block.size
            return block.out(lang, f"{TaskContext.get().partitionId()}-{n}")

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    block = blocks.setdefault(lang, WordBlock())
                    block.add(text)
                    size += len(text)
                    if block.size >= BLOCK_BYTES:
                        yield done(lang)
                    elif size >= 2 * BLOCK_BYTES:
                        yield done(max(blocks, key=lambda x: blocks[x].size))
        for lang in list(blocks):
            yield done(lang)

    texts = df.select(F.coalesce(F.col(lang_col), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text_col).alias("text"))
    blocks = texts.mapInArrow(make, "block string, lang string, size bigint, codes binary, words array<string>, many array<bigint>")
    return written(blocks, "words")


def frequent_words(blocks: DataFrame, least: int, parts: int = PARTS) -> tuple[DataFrame, int]:
    """The frequent words of each block: ``asker``, ``place``, ``lang``, ``word``, ``n`` in the language, ``id``, and ``first`` in one
    row of each word; written. And the bytes that hold an id.

    One shuffle, to parts by hash of the word, counts words and numbers the frequent ones: place in the part times parts, and the part.
    """
    named = blocks.select(F.col("block").alias("asker"), "lang", F.posexplode(F.arrays_zip("words", "many")).alias("place", "w"))
    named = named.select("asker", "lang", "place", F.col("w.words").alias("word"), F.col("w.many").alias("many"))
    named = named.withColumn("part", F.pmod(F.xxhash64("lang", "word"), F.lit(parts)).cast("int")).repartition("part")
    same = Window.partitionBy("part", "lang", "word")
    counts = named.withColumn("n", F.sum("many").over(same)).where(F.col("n") >= least).withColumns({
        "first": F.row_number().over(same.orderBy("asker", "place")) == 1,
        "id": F.dense_rank().over(Window.partitionBy("part").orderBy("lang", "word")).cast("long") * parts + F.col("part"),
    })
    found = written(counts.drop("many", "part"), "frequent")
    highest = found.agg(F.max("id")).first()[0] or 0
    return found, max(1, (highest.bit_length() + 7) // 8)


def id_blocks(blocks: DataFrame, frequent: DataFrame) -> DataFrame:
    """Blocks whose frequent words have their ids: ``ids`` (64-bit, of the block's list) and ``size`` ``codes`` into it; 0 for all else."""

    def recode(block: pa.Table, found: pa.Table) -> pa.Table:
        codes = unpacked(block["codes"][0].as_py(), block["size"][0].as_py())
        found = found.sort_by("place")
        to = np.zeros(int(codes.max(initial=0)) + 1, np.int32)
        to[found["place"].to_numpy() + 1] = np.arange(1, found.num_rows + 1)
        ids = np.concatenate([[-1], found["id"].to_numpy()]).astype("<i8")
        return pa.table({"ids": pa.array([ids.tobytes()], pa.binary()), "size": block["size"], "codes": pa.array([packed(to[codes])], pa.binary())})

    kept = blocks.select("block", "size", "codes").groupBy("block")
    answers = frequent.select("asker", "place", "id").groupBy("asker")
    return written(kept.cogroup(answers).applyInArrow(recode, "ids binary, size bigint, codes binary"), "ids")


# ------------------------------------------------------------------ counting


class HatTrie:
    """Counts of phrases of word ids, given as ``width`` bytes a word, most significant first."""

    def __init__(self, width: int, burst: int = BURST):
        self.width, self.burst = width, burst
        #: First word -> container (rest -> count), or a node of the same kind for the next word.
        self.root: dict[bytes, _Container | _Node] = {}
        self.size = 0

    def add(self, phrases: list[bytes], counts: list[int]) -> None:
        """Add different phrases in order of their bytes."""
        self.size += _add_below(self.root, phrases, counts, self.width, self.burst)

    def spill(self, down_to: int) -> Iterator[tuple[list[bytes], list[int]]]:
        """Whole subtrees, the largest first, as sorted runs, until no more than ``down_to`` phrases are held."""
        for first in sorted(self.root, key=lambda f: -self.root[f].size):
            if self.size <= down_to:
                return
            tree = self.root.pop(first)
            self.size -= tree.size
            phrases, counts = [], []
            for rest, n in tree.items():
                phrases.append(first + rest)
                counts.append(n)
            yield phrases, counts


def _add_below(trees: dict, phrases: list[bytes], counts: list[int], width: int, burst: int) -> int:
    """Give each run of phrases with the same first word to that word's tree; how many phrases are new."""
    i = new = 0
    while i < len(phrases):
        first, j = phrases[i][:width], i + 1
        while j < len(phrases) and phrases[j].startswith(first):
            j += 1
        tree = trees.get(first) or _Container()
        before = tree.size
        tree = trees[first] = tree.add([p[width:] for p in phrases[i:j]], counts[i:j], width, burst)
        new += tree.size - before
        i = j
    return new


class _Container:
    def __init__(self):
        self.counts: dict[bytes, int] = {}

    @property
    def size(self) -> int:
        return len(self.counts)

    def add(self, rests: list[bytes], counts: list[int], width: int, burst: int) -> _Container | _Node:
        held = self.counts
        get = held.get
        for r, n in zip(rests, counts, strict=True):
            held[r] = get(r, 0) + n
        # The last word of a phrase is never a node of its own.
        if len(held) <= burst or len(rests[0]) <= width:
            return self
        in_order = sorted(held.items())
        return _Node().add([r for r, _ in in_order], [n for _, n in in_order], width, burst)

    def items(self) -> Iterator[tuple[bytes, int]]:
        return iter(sorted(self.counts.items()))


class _Node:
    def __init__(self):
        self.trees: dict[bytes, _Container | _Node] = {}
        self.size = 0

    def add(self, rests: list[bytes], counts: list[int], width: int, burst: int) -> _Node:
        self.size += _add_below(self.trees, rests, counts, width, burst)
        return self

    def items(self) -> Iterator[tuple[bytes, int]]:
        for first in sorted(self.trees):
            for rest, n in self.trees[first].items():
                yield first + rest, n


def as_bytes(ids: np.ndarray, width: int) -> bytes:
    """Word ids as ``width`` bytes each, most significant first."""
    return ids.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].tobytes()


def as_ids(data: bytes, width: int) -> np.ndarray:
    flat = np.frombuffer(data, np.uint8).reshape(-1, width)
    return np.pad(flat, ((0, 0), (8 - width, 0))).view(">i8").ravel().astype(np.int64)


def hashes(ids: np.ndarray, bits: int) -> np.ndarray:
    """A place in a bitmap for each row of word ids."""
    h = np.zeros(len(ids), np.uint64)
    with np.errstate(over="ignore"):
        for column in ids.T:
            h = (h ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)  # the golden ratio: a usual multiplier
            h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def bitmap(frequent: DataFrame, length: int, width: int, bits: int) -> np.ndarray:
    """Bits of the phrases of ``frequent`` (``phrase`` binary): built by tasks, of the same size whatever there is."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = np.zeros(1 << bits, bool)
        for batch in batches:
            data = b"".join(batch["phrase"].to_pylist())
            here[hashes(as_ids(data, width).reshape(-1, length), bits)] = True
        words = np.packbits(here).view(">i8")
        at = np.flatnonzero(words)
        yield pa.record_batch({"at": pa.array(at, pa.int32()), "bits": pa.array(words[at].astype(np.int64), pa.int64())})

    rows = frequent.select("phrase").mapInArrow(some, "at int, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(1 << bits >> 6, ">i8")
    for row in rows.toLocalIterator():
        out[row.at] = row.bits
    return out.view(np.uint8)


def _has(bits_of: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits_of[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def counted(
    blocks: DataFrame, shorter: DataFrame, length: int, width: int, least: int, bits: int = BITS, burst: int = BURST, held: int = HELD
) -> DataFrame:
    """``phrase`` (``width`` bytes a word id) and ``n`` of all phrases of ``length`` words with ``n`` of at least ``least``, written.

    ``shorter`` holds the frequent phrases of one word less.
    """
    known = blocks.sparkSession.sparkContext.broadcast(bitmap(shorter, length - 1, width, bits))

    def different(ids: np.ndarray, codes: np.ndarray) -> tuple[list[bytes], list[int]]:
        """Different phrases of a block in order of their bytes, and their numbers."""
        n = len(codes) - length + 1
        if n <= 0:
            return [], []
        at = np.flatnonzero(np.logical_and.reduce([codes[i : i + n] > 0 for i in range(length)]))
        words = ids[np.stack([codes[at + i] for i in range(length)], axis=1)]
        good = _has(known.value, hashes(words[:, :-1], bits)) & _has(known.value, hashes(words[:, 1:], bits))
        words = words[good]
        order = np.lexsort(words.T[::-1])
        words = words[order]
        first = np.ones(len(words), bool)
        first[1:] = (words[1:] != words[:-1]).any(axis=1)
        start = np.flatnonzero(first)
        data = as_bytes(words[start], width)
        step = width * length
        return [data[i : i + step] for i in range(0, len(data), step)], np.diff(start, append=len(words)).tolist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = HatTrie(width, burst)

        def runs(down_to: int) -> Iterator[pa.RecordBatch]:
            phrases, counts = [], []
            for more, n in trie.spill(down_to):
                phrases += more
                counts += n
                if len(phrases) >= 1 << 15:
                    yield run(phrases, counts)
                    phrases, counts = [], []
            if phrases:
                yield run(phrases, counts)

        def run(phrases: list[bytes], counts: list[int]) -> pa.RecordBatch:
            return pa.record_batch({"phrase": pa.array(phrases, pa.binary()), "n": pa.array(counts, pa.int64())})

        for batch in batches:
            for ids, size, codes in zip(*(batch[c].to_pylist() for c in ("ids", "size", "codes")), strict=True):
                trie.add(*different(np.frombuffer(ids, "<i8"), unpacked(codes, size)))
                if trie.size > held:
                    yield from runs(held // 2)
        yield from runs(0)

    runs = blocks.select("ids", "size", "codes").mapInArrow(count, "phrase binary, n bigint")
    if length > 2:
        # One shuffle, by prefix, serves the merge as well.
        prefix = F.substring("phrase", 1, 2 * width)
        merged = runs.repartition(prefix).withColumn("prefix", prefix).groupBy("prefix", "phrase")
    else:
        merged = runs.groupBy("phrase")
    return written(merged.agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("phrase", "n"), f"phrases-{length}")


# ------------------------------------------------------------------ scores

#: Exact up to products of 38 digits.
SCORE = "cast(1000 as decimal(38,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"


def _words(phrase: Column, width: int, first: Column | int, many: Column | int) -> Column:
    """Some of a phrase's words, as bytes."""
    return F.substring(phrase, width * F.lit(first) + 1, width * F.lit(many))


def collocations(
    df: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 5, least: int = 100, percent: int = 100, top: int = 2000, **sizes: int
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Texts are lower-cased (A to Z), cut into pieces at punctuation and line ends and into words at spaces and tabs. ``a`` is how often a
    phrase of 2 to ``longest`` words stands within pieces, at least ``least``; a cut behind its first words gives ``l`` and ``r``, how often
    both parts stand, and ``score`` = floor(1000 a n / (l r)), ``n`` being all words of the language. The cut of lowest score counts, of
    equal ones the first. A phrase gives way to a longer one that holds it and has ``percent`` of its occurrences. Order: score, then ``a``, both descending,
    then the phrase's bytes. Null texts are empty, null languages ``und``; every row counts, repeated ones too; other columns are not used.
    """
    blocks = word_blocks(df, lang_col, text_col)
    totals = blocks.groupBy("lang").agg(F.sum(F.aggregate("many", F.lit(0).cast("long"), lambda x, y: x + y)).alias("total"))
    frequent, width = frequent_words(blocks, least)
    words = frequent.where("first")
    ids = id_blocks(blocks, frequent)
    one = F.unhex(F.lpad(F.hex("id"), 2 * width, "0"))
    level = words.select(one.alias("phrase"), "n")
    levels = [level]
    for length in range(2, longest + 1):
        level = counted(ids, level, length, width, least, **sizes)
        levels.append(level)
    known = levels[0]
    for more in levels[1:]:
        known = known.union(more)

    # A longer phrase that takes the place of a shorter one is found among those of one word more: those between are at least as frequent.
    size = (F.length("phrase") / width).cast("int")
    found = written(known.where(size > 1), "found")
    longer = found.where(size > 2).select(
        F.explode(F.array(_words(F.col("phrase"), width, 0, size - 1), _words(F.col("phrase"), width, 1, size - 1))).alias("phrase"), F.col("n").alias("more")
    )
    longer = longer.groupBy("phrase").agg(F.max("more").alias("more"))
    kept = found.join(longer, "phrase", "left").where(F.col("more").isNull() | (100 * F.col("more") < percent * F.col("n"))).drop("more")

    spelled = kept.select("phrase", F.posexplode(F.transform(F.sequence(F.lit(0), size - 1), lambda i: _words(F.col("phrase"), width, i, 1))).alias("place", "one"))
    names = words.select(one.alias("one"), "lang", "word")
    spelled = spelled.join(names, "one").groupBy("phrase").agg(
        F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda w: w["word"]), " ").alias("text")
    )

    def counts_of(name: str, n: str) -> DataFrame:
        return known.select(F.col("phrase").alias(name), F.col("n").alias(n))

    cuts = kept.join(spelled, "phrase").join(totals, "lang").select("lang", "phrase", "text", F.col("n").alias("a"), F.col("total").alias("n"), F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": _words(F.col("phrase"), width, 0, F.col("cut")), "right": _words(F.col("phrase"), width, F.col("cut"), size - F.col("cut"))})
    cuts = cuts.join(counts_of("left", "l"), "left").join(counts_of("right", "r"), "right")
    best = cuts.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase", "text", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    scored = best.select("lang", F.col("text").alias("phrase"), "a", "best.l", "best.r", "n", "best.score")

    # The first of each of many parts of a language, then the first of those.
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
