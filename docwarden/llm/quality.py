"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata.

score = logistic(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j). The pairwise sum is computed in linear time:
for each of the few factors, half of (the square of the sum less the sum of squares) of v_i x_i.
"""

from __future__ import annotations

import io
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BITS = 16
FACTORS = 8
#: Labelled rows that a model is fitted on at most; the choice is by a hash of the id.
FIT_ROWS = 6000
PART = 1 << 20

STRUCTURE = (
    "letters", "upper", "digits", "punctuation", "symbols", "spaces", "lines", "short_lines", "word_length", "different_words",
    "repeated_lines", "words", "symbol_words", "upper_words", "length", "stated_length",
)
_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 punctuation of prose, 5 white space, 6 beyond ASCII
for _code in range(256):
    _c = chr(_code)
    _CLASS[_code] = 6 if _code > 127 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c in ".,;:'\"!?-()" else 5 if _c.isspace() else 0


def features(text: str | None, stated: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of one whole text: first the words' buckets, then the structure statistics."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts: Counter[bytes] = Counter()
    lines: Counter[int] = Counter()
    kinds = np.zeros(7, np.int64)
    n_lines = short = symbol_words = upper_words = 0
    at = 0
    while at < len(data):
        # A piece ends at white space, so that memory does not follow the text.
        end = at + PART
        while end < len(data) and data[end : end + 1] not in b" \n\t\r":
            end += 1
        part = data[at:end]
        at = end
        words = part.split()
        symbol_words += sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:'\"!?-)")
        upper_words += sum(1 for w in words if w.isupper())
        counts.update(part.lower().split())
        kinds += np.bincount(_CLASS[np.frombuffer(part, np.uint8)], minlength=7)
        for line in part.split(b"\n"):
            n_lines += 1
            short += len(line) < 40
            lines[zlib.crc32(line)] += 1
    n_words = sum(counts.values())
    n = max(1, len(data))
    letters = kinds[1] + kinds[2] + kinds[6]
    stats = np.array([
        letters / n, kinds[2] / max(1, letters), 5 * kinds[3] / n, 5 * kinds[4] / n, 5 * kinds[0] / n, kinds[5] / n,
        50 * n_lines / n, short / max(1, n_lines), (n - kinds[5]) / max(1, n_words) / 10, len(counts) / max(1, n_words),
        1 - len(lines) / max(1, n_lines), np.log1p(n_words) / 10, symbol_words / max(1, n_words), upper_words / max(1, n_words),
        np.log1p(len(data)) / 12, np.log1p(max(0.0, stated or 0.0)) / 12,
    ])
    if not np.isfinite(stats).all():
        stats = np.nan_to_num(stats, posinf=0, neginf=0)
    mask = (1 << WORD_BITS) - 1
    buckets = np.fromiter((zlib.crc32(w) & mask for w in counts), np.int64, len(counts))
    values = np.log1p(np.fromiter(counts.values(), float, len(counts)))
    values /= max(1e-9, float(np.sqrt((values**2).sum())))
    return np.r_[buckets, (1 << WORD_BITS) + np.arange(len(stats))], np.r_[values, np.minimum(stats, 3.0)]


class FactorisationMachine:
    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def raw(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        at = np.cumsum([0] + [len(i) for i, _ in rows])[:-1]
        index, x = np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows])
        vx = self.v[index] * x[:, None]
        sums = np.add.reduceat(vx, at)
        pairs = 0.5 * (sums**2 - np.add.reduceat(vx**2, at)).sum(1)
        return self.w0 + np.add.reduceat(self.w[index] * x, at) + pairs, (index, x, vx, sums)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows)[0], -30, 30)))

    @staticmethod
    def fitted(rows, labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.1, shrink: float = 1e-4) -> FactorisationMachine:
        """Adaptive gradient descent on the logistic loss, the same for the same rows in the same order."""
        rng = np.random.default_rng(0)
        size = (1 << WORD_BITS) + len(STRUCTURE)
        model = FactorisationMachine(0.0, np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)))
        if not len(rows):
            return FactorisationMachine(0.0, model.w, np.zeros_like(model.v))
        share = float(np.clip(labels.mean(), 0.01, 0.99))
        model.w0 = float(np.log(share / (1 - share)))
        seen_w, seen_v, seen_0 = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                raw, (index, x, vx, sums) = model.raw([rows[j] for j in some])
                slope = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[some]
                each = np.repeat(slope, [len(rows[j][0]) for j in some])
                row = np.repeat(np.arange(len(some)), [len(rows[j][0]) for j in some])
                where, inverse = np.unique(index, return_inverse=True)
                g_w = np.bincount(inverse, each * x, len(where)) / len(some) + shrink * model.w[where]
                g_each = (each * x)[:, None] * (sums[row] - vx)
                g_v = np.stack([np.bincount(inverse, g_each[:, f], len(where)) for f in range(FACTORS)], 1) / len(some) + shrink * model.v[where]
                g_0 = slope.mean()
                seen_w[where] += g_w**2
                seen_v[where] += g_v**2
                seen_0 += g_0**2
                model.w[where] -= rate * g_w / np.sqrt(seen_w[where])
                model.v[where] -= 0.3 * rate * g_v / np.sqrt(seen_v[where])
                model.w0 -= rate * g_0 / np.sqrt(seen_0)
        return model

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, w0=self.w0, w=self.w.astype(np.float32), v=self.v.astype(np.float32))
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> FactorisationMachine:
        with np.load(io.BytesIO(data)) as z:
            return FactorisationMachine(float(z["w0"]), z["w"], z["v"])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from fitting: crc32 of the id as text leaves 1 modulo 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _stated(docs: DataFrame, length_col: str) -> Column:
    return F.col(length_col).cast("double") if length_col in docs.columns else F.lit(None).cast("double")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", length_col: str = "n_chars", fit_rows: int = FIT_ROWS) -> bytes:
    """A model fitted on up to ``fit_rows`` labelled rows that are not held out; its size does not depend on the data.

    Rows without id or label are left aside; of several labels of an id the mean counts, of several documents of an id the one of
    smallest hash (then text, then stated length), so that ``fit_rows`` bounds rows whatever repeats. One task fits; only the model
    (2 MB) comes to the driver. Without labelled rows every score is one half.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.avg(label_col).alias("label"))
    # At most fit_rows rows of two numbers: bounded, so this side can be broadcast.
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    mine = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), _stated(docs, length_col).alias("stated"))
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "stated", "label")).alias("one")
    sample = mine.join(F.broadcast(chosen), "id").groupBy("id").agg(one).select("id", "one.text", "one.stated", "one.label")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t, s) for t, s in zip(b["text"].to_pylist(), b["stated"].to_pylist(), strict=True)]
            yield pa.record_batch({"id": b["id"], "label": b["label"], "i": pa.array([i for i, _ in found], pa.list_(pa.int64())), "x": pa.array([x for _, x in found], pa.list_(pa.float64()))})

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for b in batches:
            rows += list(zip((np.array(i.values) for i in b["i"]), (np.array(x.values) for x in b["x"]), strict=True))
            labels += b["label"].to_pylist()
        yield pa.record_batch({"model": [FactorisationMachine.fitted(rows, np.array(labels, float)).to_bytes()]})

    prepared = sample.mapInArrow(prepare, "id long, label double, i array<long>, x array<double>")
    made = prepared.repartition(1).sortWithinPartitions("id", "label", "i").mapInArrow(train, "model binary").first()
    return made["model"] if made else FactorisationMachine.fitted([], np.zeros(0)).to_bytes()


def score(docs: DataFrame, model: bytes, text_col: str = "text", length_col: str = "n_chars", to: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each whole text; null and empty texts are scored by their statistics."""
    loaded: list[FactorisationMachine] = []

    @F.pandas_udf("double")
    def of(texts: pd.Series, stated: pd.Series) -> pd.Series:
        if not loaded:
            loaded.append(FactorisationMachine.from_bytes(model))
        return pd.Series(np.concatenate([np.zeros(0), *(loaded[0].scores(rows) for rows in _groups(texts, stated))]))

    return docs.withColumn(to, of(F.col(text_col), _stated(docs, length_col)))


def _groups(texts: Iterable, stated: Iterable, most: int = 256):
    rows = []
    for t, s in zip(texts, stated, strict=True):
        rows.append(features(t, None if s is None or s != s else s))
        if len(rows) == most:
            yield rows
            rows = []
    if rows:
        yield rows


def predicted(score_col: str = "score") -> Column:
    return (F.col(score_col) >= 0.5).cast("int")
