"""Regular expressions with the meaning they have in Python's ``re``, run by Spark's Java engine.

``jregex`` restates a Python pattern for Java:

* ``\\d \\w \\b`` and case folding follow Unicode (``(?U)``, ``(?iu)``),
* ``.``, ``^`` and ``$`` treat only the line feed as a line end (``(?d)``),
* ``\\s`` also covers U+001C to U+001F,
* ``[`` and ``&&`` inside a character class are plain characters.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MATCH_TYPE = "array<struct<value:string,start:int,end:int>>"

_PY_SPACE = r"\s\x1c-\x1f"
# The whitespace of Python's str.strip().
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# What lower case leaves of the characters that regexes take for ASCII i and s: dotless i, long s and
# dotted capital I.
FOLDED = ("\u0131", "\u017f", "i\u0307")


def jregex(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """Java form of a Python pattern. Leading inline flags (``(?i)``) are honoured."""
    flags = set("dU")
    while pattern.startswith("(?") and pattern[2:3] in ("i", "m", "s", "x"):
        inline, _, rest = pattern[2:].partition(")")
        if not inline.isalpha():
            break
        flags |= set(inline)
        pattern = rest
    if ignore_case:
        flags.add("i")
    if multiline:
        flags.add("m")
    if "i" in flags:
        flags.add("u")

    out: list[str] = []
    in_class = False
    at_class_start = False
    i = 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        ch = pattern[i]
        if ch == "\\":
            if two == r"\s":
                two = _PY_SPACE if in_class else f"[{_PY_SPACE}]"
            elif two == r"\S" and not in_class:
                two = f"[^{_PY_SPACE}]"
            elif two == r"\Z":
                two = r"\z"
            out.append(two)
            i += 2
            at_class_start = False
            continue
        if in_class:
            if ch == "]" and not at_class_start:
                in_class = False
            elif ch in "[]" or two == "&&":
                ch = "\\" + ch
            at_class_start = at_class_start and ch == "^"
        elif ch == "[":
            in_class = at_class_start = True
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        out.append(ch)
        i += 1
    order = "".join(f for f in "dimsuxU" if f in flags)
    return f"(?{order})" + "".join(out)


def compile_check(
    spark: SparkSession, pattern: str, ignore_case: bool = False, multiline: bool = False
) -> None:
    """Try a pattern on one row, with the engine that will run it; ``ValueError`` if it is invalid."""
    probe = spark.range(1).select(
        F.regexp_count(F.col("id").cast("string"), F.lit(jregex(pattern, ignore_case, multiline)))
    )
    try:
        probe.collect()
    except PySparkException as bad:
        raise ValueError(f"Invalid regex pattern: {pattern}") from bad


def valid_patterns(spark: SparkSession, jpatterns: list[str]) -> list[bool]:
    """Which Java patterns the engine can use. One job tries them all; only if it fails are they tried in halves."""
    if not jpatterns:
        return []
    probe = spark.range(1).select(*(F.regexp_count(F.col("id").cast("string"), F.lit(p)) for p in jpatterns))
    try:
        probe.collect()
        return [True] * len(jpatterns)
    except PySparkException:
        if len(jpatterns) == 1:
            return [False]
        half = len(jpatterns) // 2
        return valid_patterns(spark, jpatterns[:half]) + valid_patterns(spark, jpatterns[half:])


def sql_text(value: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# The functions below take columns by name and hand Spark one SQL expression each. Rule sets make dozens
# of them, and built call by call they cost the driver seconds per query.


def contains_any(low: str, literals: Iterable[str]) -> str:
    """SQL: one of the literals occurs."""
    return "(" + " OR ".join(f"contains({low}, {sql_text(x)})" for x in literals) + ")"


def has_folded(low: str) -> str:
    """SQL: the lowered text holds a character that regexes take for an ASCII letter, so that literals tell nothing."""
    return contains_any(low, FOLDED)


def may_match(low: str, needs: tuple[tuple[str, ...], ...], folded: str | None = None) -> str | None:
    """SQL of a cheap necessary condition on the lowered text: one literal of every group occurs.

    ``folded`` names a column of ``has_folded``, for those who test many patterns on one text.
    """
    if not needs:
        return None
    return f"({' AND '.join(contains_any(low, group) for group in needs)} OR {folded or has_folded(low)})"


def matches(
    text: str,
    jpattern: str,
    low: str | None = None,
    needs: tuple[tuple[str, ...], ...] = (),
    guard: str | None = None,
) -> Column:
    """True where the pattern occurs (``re.search``); ``needs`` may spare the regex, see the rules, or the ``guard`` (SQL) given for them."""
    if guard is None and low is not None:
        guard = may_match(low, needs)
    found = f"{text} RLIKE {sql_text(jpattern)}"
    return F.expr(found if guard is None else f"{guard} AND {found}")


def py_strip(text: Column) -> Column:
    """``str.strip()``."""
    return F.btrim(text, F.lit(WHITESPACE))


def spans_sql(text: str, jpattern: str, only_where: str | None = None) -> str:
    """SQL of all matches with 0-based code-point offsets, end exclusive (``re.finditer``).

    Java matches in UTF-16 units, so offsets are rebuilt from lengths: the text is cut at the matches
    and the running length of gaps and matches gives each start. Work beyond the one ``rlike`` scan is
    done only for rows that match; rows outside ``only_where`` (SQL) are known not to.
    """
    p = sql_text(jpattern)
    # An empty match at the very start yields no leading gap in Java's split.
    gaps = "if(size(x.cut) = size(x.found), concat(array(''), x.cut), x.cut)"
    starts = f"""aggregate(
        zip_with(x.found, slice({gaps}, 1, size(x.found)), (m, g) -> struct(length(m) AS m, length(g) AS g)),
        struct(0 AS pos, cast(array() AS array<int>) AS starts),
        (acc, l) -> struct(acc.pos + l.g + l.m AS pos, array_append(acc.starts, acc.pos + l.g) AS starts)
    ).starts"""
    # The one-element transform names the two regex results, so that each is computed once.
    spans = f"""transform(
        array(struct(regexp_extract_all({text}, {p}, 0) AS found, split({text}, {p}, -1) AS cut)),
        x -> zip_with(x.found, {starts}, (v, s) -> struct(v AS value, s AS start, s + length(v) AS `end`))
    )[0]"""
    hit = f"{text} RLIKE {p}" if only_where is None else f"{only_where} AND {text} RLIKE {p}"
    return f"CASE WHEN {hit} THEN cast({spans} AS {MATCH_TYPE}) ELSE cast(array() AS {MATCH_TYPE}) END"


def match_spans(text: str, jpattern: str, only_where: str | None = None) -> Column:
    return F.expr(spans_sql(text, jpattern, only_where))


def replace_all(text: Column, jpattern: str, replacement: str) -> Column:
    """Replace every match by a literal text."""
    literal = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, jpattern, literal)
