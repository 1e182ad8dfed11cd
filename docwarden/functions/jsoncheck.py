"""Strict JSON validity (Spark's own parser accepts trailing text)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.BooleanType())
def _parses(contents: pd.Series) -> pd.Series:
    def ok(raw: bytes | None) -> bool | None:
        if raw is None:
            return None
        try:
            json.loads(bytes(raw).decode("utf-8"))
            return True
        except (ValueError, RecursionError):
            return False

    return contents.map(ok).astype("boolean")


def is_strict_json(content: Column, only_where: Column) -> Column:
    """Whether bytes are UTF-8 JSON; null, and not sent to Python, where ``only_where`` is false."""
    return _parses(F.when(only_where, content))
