"""Near duplicates by SimHash: 64-bit fingerprints, linked at a few differing bits through deletion-variant signatures.

Of two fingerprints that differ in at most 3 bits, cut into two halves of 32 bits, one half differs in at most one
bit. So every fingerprint is indexed under both halves, each with every single bit struck out in turn (64 signatures),
and two linked fingerprints meet under an equal signature, where the whole distance is verified.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docwarden.llm.common import written
from docwarden.llm.components import connected_components

SEED = 42
WORDS_AT_ONCE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")

#: A signature met by more fingerprints than this is narrowed by further signatures before pairs are looked at.
GROUP = 2048


def _bits_set(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit, lowest bit first."""
    return np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits: one is set where over half the XXH64 of all shingles (repeats included) have it; 0 without words.

    Words are runs of other than ASCII white space, A-Z lower-cased. Long texts are taken piece by piece, with the last
    words of one piece before the next, so memory does not follow the text.
    """
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    counts, n, carry, at = np.zeros(64, np.int64), 0, [], 0
    xxh = xxhash.xxh64_intdigest
    while at < len(data):
        gap = _SPACE.search(data, at + WORDS_AT_ONCE) if len(data) - at > WORDS_AT_ONCE else None
        end = gap.start() if gap else len(data)
        words = carry + data[at:end].split()
        at = end
        if len(words) >= shingle:
            hashes = [xxh(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)), strict=False)]
            for i in range(0, len(hashes), 1 << 16):
                counts += _bits_set(hashes[i : i + (1 << 16)])
            n += len(hashes)
            carry = words[len(words) - shingle + 1 :]
        else:
            carry = words
    if not n and carry:
        counts, n = _bits_set([xxh(b" ".join(carry), SEED)]), 1
    return sum(1 << b for b in range(64) if 2 * int(counts[b]) > n)


def fingerprints(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a (signed) long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn("fp", of(F.col(text_col)))


def _key(which: int, bits: Column) -> Column:
    return F.lit(which << 32).bitwiseOR(bits)


def signatures(fps: DataFrame) -> DataFrame:
    """``key``, ``fp``, ``base``, ``width``: 64 rows a fingerprint, one per half and struck bit.

    ``base`` and ``width`` name the other half, in which linked fingerprints may still differ in up to 3 bits.
    """
    low = (1 << 32) - 1
    halves = (F.col("fp").bitwiseAND(F.lit(low)), F.shiftrightunsigned("fp", 32))
    made = F.array(*(_key(32 * h + b, halves[h].bitwiseAND(F.lit(low & ~(1 << b)))) for h in (0, 1) for b in range(32)))
    return fps.select("fp", F.explode(made).alias("key")).select(
        "key", "fp", F.when(F.shiftright("key", 32) < 32, 32).otherwise(0).alias("base"), F.lit(32).alias("width")
    )


def narrowed(over: DataFrame, width: int) -> DataFrame:
    """The next level for fingerprints that share a signature with too many others: the free part is cut in two likewise.

    The new key is a hash of the old one and the bits compared now. That different ones could collide does no harm:
    every pair is verified whole. ``width``: of the free part so far.
    """
    half = width // 2
    parts = []
    for base in (0, 32, *((16, 48) if width < 32 else ())):
        of_base = []
        for h in (0, 1):
            for b in range(half):
                mask = ((1 << half) - 1 & ~(1 << b)) << (base + h * half)
                mask -= (mask >> 63) << 64
                new = F.xxhash64("key", F.lit(h * half + b), F.col("fp").bitwiseAND(F.lit(mask)))
                of_base.append(F.struct(new.alias("key"), F.lit(base + (1 - h) * half).alias("base")))
        parts.append((base, F.array(*of_base)))
    made = F.lit(None)
    for base, rows in parts:
        made = F.when(F.col("base") == base, rows).otherwise(made)
    return over.select("fp", F.explode(made).alias("n")).select("n.key", "fp", "n.base", F.lit(half).alias("width"))


def _first_meeting(key: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether a first-level signature is the one that stands for the pair, of all under which it meets."""
    which = key >> 32
    low, high = differ & np.uint64((1 << 32) - 1), differ >> np.uint64(32)
    use_low = np.bitwise_count(low) <= 1
    part = np.where(use_low, low, high)
    bit = np.where(part == 0, 0, np.bitwise_count(part - np.uint64(1)))
    return which == bit + np.where(use_low, 0, 32)


class _Forest:
    """Lets through only links between what earlier ones did not connect; starts afresh before it grows large."""

    def __init__(self, most: int = 200_000):
        self.up, self.most = {}, most

    def _root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def new_links(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        out = []
        if len(self.up) > self.most:
            self.up = {}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self._root(x), self._root(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                out.append((x, y))
        return out


MEETING = "kind int, key long, fp long, other long, base int"


def _meet(first: bool, last: bool, most: int, group: int):
    """Over rows in order of key: links of the fingerprints that share one (kind 0), or the rows of too large groups (kind 1)."""

    def links(key: np.ndarray, fp: np.ndarray, forest: _Forest) -> list[tuple[int, int]]:
        out, bits = [], fp.view(np.uint64)

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            differ = bits[i] ^ bits[j]
            good = np.bitwise_count(differ) <= most
            if first:
                good &= _first_meeting(key[i], differ)
            out.extend(forest.new_links(fp[i[good]], fp[j[good]]))

        # Neighbours at every distance up to 16 cover groups of up to 17; larger groups are gone through row by row.
        for lag in range(1, 17):
            i = np.flatnonzero(key[lag:] == key[:-lag])
            if not len(i):
                return out
            keep(i, i + lag)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        for s, e in zip(starts, ends, strict=True):
            for i in range(s, e - 17) if e - s > 17 else ():
                keep(np.full(e - i - 17, i), np.arange(i + 17, e))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()

        def made(found, over):
            n, m = len(found), len(over[0])
            a = np.array(found, np.int64).reshape(-1, 2)
            empty = np.zeros(n, np.int64)
            return pa.record_batch({
                "kind": np.r_[np.zeros(n, np.int32), np.ones(m, np.int32)],
                "key": np.r_[empty, over[0]],
                "fp": np.r_[a[:, 0], over[1]],
                "other": np.r_[a[:, 1], np.zeros(m, np.int64)],
                "base": np.r_[empty.astype(np.int32), over[2]],
            })

        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        held, flowing = none, None
        for batch in batches:
            now = tuple(np.r_[h, batch[c].to_numpy()] for h, c in zip(held, ("key", "fp", "base"), strict=True))
            held = none
            if not len(now[0]):
                continue
            # A group known to be too large flows on as it comes.
            if flowing is not None:
                n = int(np.searchsorted(now[0], flowing, "right"))
                yield made([], tuple(c[:n] for c in now))
                now = tuple(c[n:] for c in now)
                if not len(now[0]):
                    continue
                flowing = None
            key = now[0]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            large = np.repeat((sizes > group) & (not last), sizes)
            tail = np.zeros(len(key), bool)
            tail[starts[-1] :] = True
            if large[-1]:
                flowing = key[-1]
                tail[:] = False
            over, whole = large & ~tail, ~large & ~tail
            yield made(links(key[whole], now[1][whole], forest), tuple(c[over] for c in now))
            held = tuple(c[tail] for c in now)
        if len(held[0]):
            yield made(links(held[0], held[1], forest), none)

    return run


def links(fps: DataFrame, most: int = 3, group: int = GROUP) -> DataFrame:
    """``u``, ``v``: links between different fingerprints (column ``fp``) whose components are those of all links of at most ``most`` bits.

    Each link is verified. Of links that close a circle some are left out, so that a large group of near copies does
    not become all of its pairs. Signatures shared by over ``group`` fingerprints are narrowed twice more, after which
    31 + 15 + 7 bits are equal and at most 2^11 different fingerprints can share one.
    """
    if not 0 <= most <= 3:
        raise ValueError("two segments find links of up to 3 bits")
    rows, found = signatures(fps), None
    for level, width in enumerate((32, 16, 8)):
        met = rows.repartition("key").sortWithinPartitions("key", "fp").select("key", "fp", "base")
        met = written(met.mapInArrow(_meet(level == 0, level == 2, most, group), MEETING), "meetings")
        new = met.where("kind = 0").select(F.col("fp").alias("u"), F.col("other").alias("v"))
        found = new if found is None else found.union(new)
        over = met.where("kind = 1")
        if level == 2 or over.isEmpty():
            break
        rows = narrowed(over, width)
    return found


def grouped(docs: DataFrame, id_col: str = "doc_id", most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` with ``fp``: those fingerprints' ``component`` (smallest fingerprint) and ``component_id`` (smallest id), and the components.

    Copies meet by fingerprint before anything else: one row per different fingerprint goes on.
    """
    distinct = docs.groupBy("fp").agg(F.min(id_col).alias("least_id"))
    distinct = written(distinct, "fingerprints")
    component = connected_components(links(distinct, most))
    members = distinct.join(component.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    members = written(members, "members")
    smallest = members.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return members, smallest


def near_duplicates(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3, most: int = 3
) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id``: the smallest id reachable over links of at most ``most`` bits, itself included.

    Null and empty texts have fingerprint 0 and link like any other. Rows with repeated ids keep their own row each.
    A null id is never the smallest; a component of null ids alone has a null one. An empty table gives no rows; other
    columns are ignored.
    """
    mine = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    mine = written(fingerprints(mine, "text", shingle).select("doc_id", "fp"), "simhash")
    members, smallest = grouped(mine, "doc_id", most)
    named = members.join(smallest, "component").select("fp", "component_id")
    return mine.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3, most: int = 3) -> DataFrame:
    """``docs``, one row of each component: the smallest id (nulls last), of rows that share it the smallest in all columns.

    Columns are those of ``docs`` (a column ``fp`` of its own is kept apart).
    """
    columns = docs.columns
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    text, key = f"c{columns.index(text_col)}", f"c{columns.index(id_col)}"
    inner = written(fingerprints(inner, text, shingle), "simhash")
    members, _ = grouped(inner.select(F.col(key).alias("id"), "fp"), "id", most)
    # The fingerprint that holds the smallest id; of several (repeated ids) the smallest fingerprint.
    first = F.min_by(F.struct("fp", "least_id"), F.struct(F.col("least_id").isNull(), "least_id", "fp")).alias("first")
    kept = members.groupBy("component").agg(first).select(F.col("first.fp").alias("k_fp"), F.col("first.least_id").alias("k_id"))
    rows = inner.join(kept, (F.col("fp") == F.col("k_fp")) & F.col(key).eqNullSafe(F.col("k_id")))
    # Only rows repeated in both are left to choose from.
    order = Window.partitionBy("k_fp", "k_id").orderBy(*(F.col(f"c{i}") for i in range(len(columns))))
    rows = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))
