"""Threats from a caller's model: an Arrow batch scorer, and a small word model fitted on labelled texts.

A scorer is built once per Python worker and gets texts in batches, which Spark bounds by rows and bytes and which are cut further
to the size a model takes. What it finds goes to ``detect_injection`` as ``extra_threats``.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import SEVERITY_WEIGHT
from .detect import THREATS_TYPE

#: Takes texts, returns as many confidences from 0 to 1.
Scorer = Callable[[list[str]], list[float]]

_MODELS: dict[str, Scorer] = {}
_WORD = "[A-Za-z]+"


def _model(key: str, factory: Callable[[], Scorer]) -> Scorer:
    """One model per scorer and Python worker."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = factory()
    return _MODELS[key]


def _scores(key: str, factory: Callable[[], Scorer], texts: pa.Array, rows: int, chars: int) -> Iterator[float]:
    """Confidences of a batch; the model sees at most ``rows`` texts at once, of ``chars`` characters together unless one is longer."""

    def asked(some: list[str]) -> Iterator[float]:
        found = [float(x) for x in _model(key, factory)(some)]
        if len(found) != len(some) or not all(math.isfinite(x) and 0 <= x <= 1 for x in found):
            raise ValueError("a scorer returns one confidence from 0 to 1 for each text")
        yield from found

    held, size = [], 0
    for value in texts:
        text = value.as_py() or ""
        if held and (len(held) == rows or size + len(text) > chars):
            yield from asked(held)
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield from asked(held)


def confidence(text_col: str, factory: Callable[[], Scorer], rows: int = 64, chars: int = 1 << 20) -> Column:
    """The scorer's confidence of each whole text, a double. A null text counts as empty."""
    key = uuid.uuid4().hex

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(_scores(key, factory, texts, rows, chars), pa.float64())

    return scored(F.col(text_col))


def model_threats(
    df: DataFrame,
    text_col: str,
    factory: Callable[[], Scorer],
    threat_type: str,
    severity: str = "high",
    threshold: float = 0.5,
    description: str = "Model judgement",
    to: str = "threats",
    rows: int = 64,
    chars: int = 1 << 20,
) -> DataFrame:
    """``df`` with ``to``: an ``array<threat>`` of one threat where the model's confidence reaches ``threshold``, else empty.

    The threat has the whole text for its span and the model's confidence for its weight. A null text counts as empty; a
    column named ``to`` is replaced; an empty table stays empty. What the model raises ends the job.
    """
    if severity not in SEVERITY_WEIGHT:
        raise ValueError(f"unknown severity: {severity}")
    given = F.struct(
        F.lit(threat_type),
        F.lit(severity),
        F.lit("model"),
        F.lit(description),
        F.lit(0),
        F.length(F.coalesce(F.col(text_col), F.lit(""))),
        F.col("__confidence"),
    )
    threats = F.when(F.col("__confidence") >= threshold, F.array(given)).otherwise(F.array())
    return df.withColumn("__confidence", confidence(text_col, factory, rows, chars)).withColumn(to, threats.cast(THREATS_TYPE)).drop("__confidence")


def words_of(text_col: str) -> Column:
    """The different words of a text, runs of the letters A to Z, in lower case."""
    return F.array_distinct(F.transform(F.expr(f"regexp_extract_all({text_col}, '({_WORD})', 1)"), F.lower))


def fit_words(
    texts: DataFrame, text_col: str, label_col: str, min_texts: int = 5, ratio: int = 8, most_words: int = 5000, full: int = 4
) -> Callable[[], Scorer]:
    """A scorer that counts telling words: confidence is their number in a text over ``full``, at most 1.

    A word tells if it stands in ``min_texts`` texts of label 1 and its share there is at least ``ratio`` times its share in texts of
    label 0; of more than ``most_words`` the most frequent stay (ties: by word). Rows without a label are left aside, a null text
    is empty, and without texts of label 1 no word tells. Only the words that stay come to the driver.
    """
    known = texts.where(F.col(label_col).isin(0, 1)).select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), (F.col(label_col) == 1).alias("hit"))
    totals = known.agg(F.count_if("hit").alias("all_hits"), F.count_if(~F.col("hit")).alias("all_others"))
    words = known.select(F.explode(words_of("t")).alias("word"), "hit").groupBy("word").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("others"))
    # One row of two numbers.
    telling = words.where(F.col("hits") >= min_texts).join(F.broadcast(totals), F.expr(f"hits * all_others >= {ratio} * others * all_hits"))
    chosen = frozenset(r.word for r in telling.orderBy(F.desc("hits"), "word").limit(most_words).select("word").collect())

    def factory() -> Scorer:
        find = re.compile(_WORD).findall
        return lambda some: [min(len(chosen.intersection(w.lower() for w in find(t))), full) / full for t in some]

    return factory
