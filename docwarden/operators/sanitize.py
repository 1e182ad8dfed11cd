"""Text sanitizing: truncate, NFKC, strip controls, escape HTML, normalize whitespace, strip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import py_strip
from ..functions.unicode import nfkc
from ..rules import InputLimits

CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def strip_controls(text: Column) -> Column:
    """Drop control characters other than tab, line feed and carriage return."""
    return F.regexp_replace(text, CONTROLS, "")


def escape_html(text: Column) -> Column:
    for raw, entity in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"),
    ):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def collapse_whitespace(text: Column) -> Column:
    """LF line ends, one space per run of other whitespace, no blanks at line ends."""
    text = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    text = F.replace(text, F.lit("\r"), F.lit("\n"))
    text = F.regexp_replace(text, r"(?U)[\s\x1c-\x1f&&[^\n]]+", " ")
    return F.regexp_replace(text, r" (?=\n|\z)", "")


def sanitize_text(
    df: DataFrame,
    text_col: str,
    max_length: int | None = None,
    strip_html: bool = True,
    normalize_whitespace: bool = True,
    limits: InputLimits = InputLimits(),
    prefix: str = "",
) -> DataFrame:
    """Add ``is_valid``, ``sanitized_value``, ``modifications``, ``errors`` and ``warnings``.

    A null text is invalid. ``max_length`` of 0 means the default, as None does. "Normalized whitespace"
    is listed whenever the text differs from the original at that point, also when only an earlier step
    changed it; the final strip is never listed.
    """
    n = {
        k: prefix + k
        for k in ("is_valid", "sanitized_value", "modifications", "errors", "warnings")
    }
    limit = max_length or limits.max_prompt_length
    text = F.col(text_col)
    too_long = F.length(text) > limit
    staged = df.withColumn("__cut", F.substring(text, 1, limit))
    staged = staged.withColumn("__nfkc", nfkc(F.col("__cut")))
    staged = staged.withColumn("__clean", strip_controls(F.col("__nfkc")))
    staged = staged.withColumn(
        "__esc", escape_html(F.col("__clean")) if strip_html else F.col("__clean")
    )
    staged = staged.withColumn(
        "__ws", collapse_whitespace(F.col("__esc")) if normalize_whitespace else F.col("__esc")
    )
    steps = [
        F.when(
            too_long,
            F.concat(
                F.lit("Truncated from "),
                F.length(text).cast("string"),
                F.lit(f" to {limit} characters"),
            ),
        ),
        F.when(F.col("__nfkc") != F.col("__cut"), F.lit("Normalized unicode characters")),
        F.when(F.col("__clean") != F.col("__nfkc"), F.lit("Removed control characters")),
    ]
    if strip_html:
        steps.append(F.when(F.col("__esc") != F.col("__clean"), F.lit("Escaped HTML entities")))
    if normalize_whitespace:
        steps.append(F.when(F.col("__ws") != text, F.lit("Normalized whitespace")))
    none = F.array().cast("array<string>")
    return staged.withColumns(
        {
            n["is_valid"]: text.isNotNull(),
            n["sanitized_value"]: py_strip(F.col("__ws")),
            n["modifications"]: F.array_compact(F.array(*steps)),
            n["errors"]: F.when(text.isNull(), F.array(F.lit("Input must be a string"))).otherwise(
                none
            ),
            n["warnings"]: F.when(
                too_long, F.array(F.lit("Input was truncated to maximum length"))
            ).otherwise(none),
        }
    ).drop("__cut", "__nfkc", "__clean", "__esc", "__ws")
