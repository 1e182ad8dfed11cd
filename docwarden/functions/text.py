"""Scalar text measures and formatting."""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .regex import FOLDED, WHITESPACE

# Characters that do not count as special, as a pattern and as code points.
_SPECIAL = r"""(?U)[^a-zA-Z0-9\s\x1c-\x1f.,!?;:'"()-]"""
_IS_PLAIN = np.zeros(ord(max(WHITESPACE)) + 1, dtype=bool)
_IS_PLAIN[[ord(c) for c in string.ascii_letters + string.digits + WHITESPACE + ".,!?;:'\"()-"]] = True
_MEASURES = T.StructType().add("entropy", T.DoubleType()).add("special", T.IntegerType()).add("words", T.IntegerType()).add("may", T.LongType())

Needs = tuple[tuple[str, ...], ...]


def fixed2(x: str) -> Column:
    """A non-negative double (SQL) with two decimals, rounded as Python's ``:.2f`` rounds.

    Java's ``%.2f`` rounds the shortest decimal form half up, so 0.155 and 0.625 come out differently.
    Here the exact distance to the tie decides: ``x`` is split into a 24-bit head and the rest, which
    makes both products with 200 exact.
    """
    hundredths = f"floor(({x}) * 100D)"
    head = f"cast(cast(({x}) AS float) AS double)"
    beyond = f"(({head} * 200D - cast(2 * {hundredths} + 1 AS double)) + (({x}) - {head}) * 200D)"
    up = f"if({beyond} > 0 OR ({beyond} = 0 AND {hundredths} % 2 = 1), 1L, 0L)"
    cents = f"({hundredths} + {up})"
    return F.expr(f"concat(cast({cents} DIV 100 AS string), '.', lpad(cast({cents} % 100 AS string), 2, '0'))")


def special_char_ratio(text: Column) -> Column:
    """Share of characters outside ASCII letters, digits, whitespace and plain punctuation."""
    return F.regexp_count(text, F.lit(_SPECIAL)) / F.greatest(F.length(text), F.lit(1))


def substring_count(text: Column, piece: str) -> Column:
    """Number of non-overlapping occurrences of a literal."""
    removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(piece), F.lit("")))
    return (removed / len(piece.encode())).cast("int")


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different code points of a text, in order, and how often each occurs."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    if points.max() > 4 * points.size + 1024:
        return np.unique(points, return_counts=True)
    counts = np.bincount(points)
    found = np.flatnonzero(counts)
    return found, counts[found]


def _bits(counts: np.ndarray) -> float:
    share = counts / counts.sum()
    return float(-(share * np.log2(share)).sum())


@F.pandas_udf(T.DoubleType())
def _entropy(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: _bits(_counts(text)[1]) if text else None).astype("float64")


def char_entropy(text: Column, longer_than: int = 0) -> Column:
    """Shannon entropy in bits over the characters of a text; null for texts not longer than the bound.

    Spark has no character histogram; the native forms cost
    5 times more (characters exploded and aggregated twice, plus a join that shuffles the texts back)
    to 9 times more (sorted characters in the row), and this one keeps the stage narrow. Short texts
    travel as null.
    """
    return _entropy(F.when(F.length(text) > longer_than, text))


#: More conditions than this are not asked.
MOST_NEEDS = 63


def text_measures(text: Column, longer_than: int, words: tuple[str, ...] = (), needs: tuple[Needs, ...] = ()) -> Column:
    """Struct of what one trip to Python tells of a text; null for texts not longer than the bound, which do not travel.

    ``entropy`` is that of ``char_entropy``, ``special`` the characters that count for ``special_char_ratio``, ``words`` the occurrences
    of ``words`` in the lowered text, and bit i of ``may`` whether ``needs[i]`` holds there as in ``may_match``. Words and literals
    are ASCII in lower case, for which every way to lower a text gives the same; a condition with others counts as met. Python
    looks for a literal some ten times faster than Spark's ``contains``.
    """
    asked = [groups if all(x.isascii() for group in groups for x in group) else () for groups in needs[:MOST_NEEDS]]

    def mask(low: str) -> int:
        if any(x in low for x in FOLDED):
            return -1
        return sum(1 << i for i, groups in enumerate(asked) if all(any(x in low for x in group) for group in groups))

    def measured(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            if not text:
                rows.append((None, None, None, None))
                continue
            points, counts = _counts(text)
            known = np.searchsorted(points, _IS_PLAIN.size)
            special = counts.sum() - counts[:known][_IS_PLAIN[points[:known]]].sum()
            low = text.lower()
            rows.append((_bits(counts), int(special), sum(low.count(w) for w in words), mask(low)))
        found = pd.DataFrame(rows, columns=["entropy", "special", "words", "may"], dtype="object")
        return found.astype({"entropy": "float64", "special": "Int32", "words": "Int32", "may": "Int64"})

    return F.pandas_udf(measured, _MEASURES)(F.when(F.length(text) > longer_than, text))


def special_ratio(text: Column, special: Column) -> Column:
    """``special_char_ratio`` where the characters may have been counted already."""
    counted = F.coalesce(special, F.regexp_count(text, F.lit(_SPECIAL)))
    return counted / F.greatest(F.length(text), F.lit(1))
