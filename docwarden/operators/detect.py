"""Prompt-injection detection.

One narrow stage: every part of the verdict is an expression over the text of its own row, so nothing
is shuffled and a text of any length stays where it was read. Intermediate results are staged as
columns so that score and verdict read the ``threats`` array instead of building it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import jregex, matches, may_match, py_strip, spans_sql, sql_text
from ..functions.text import MOST_NEEDS, fixed2, special_ratio, substring_count, text_measures
from ..rules import (
    INSTRUCTION_WORDS,
    REPAIRED,
    SEVERITY_WEIGHT,
    THRESHOLDS,
    RegexRule,
    RuleSet,
)

THREAT_TYPE = (
    "struct<threat_type:string,severity:string,pattern_matched:string,description:string,"
    "start:int,end:int,confidence:double>"
)
THREATS_TYPE = f"array<{THREAT_TYPE}>"
WARNINGS_TYPE = "array<string>"

# Bounds of the heuristics.
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
SPECIAL_RATIO_LIMIT = 0.3
CODE_FENCE_LIMIT = 6
RULE_LINE_LIMIT = 10
INSTRUCTION_WORD_LIMIT = 5
ENTROPY_MIN_LENGTH = 50
ENTROPY_LIMIT = 5.5
# The look-behind only keeps the search from starting again inside the same run.
BASE64_RUN = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{50,}={0,2}"


def _threat(
    kind: str | Column,
    severity: str,
    matched: str | Column,
    description: str | Column,
    start: Column | None = None,
    end: Column | None = None,
    confidence: Column | None = None,
) -> Column:
    def col(x: str | Column) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    none = F.lit(None).cast("int")
    return F.struct(
        col(kind).alias("threat_type"),
        F.lit(severity).alias("severity"),
        col(matched).alias("pattern_matched"),
        col(description).alias("description"),
        (none if start is None else start).alias("start"),
        (none if end is None else end).alias("end"),
        (F.lit(1.0) if confidence is None else confidence).alias("confidence"),
    ).cast(THREAT_TYPE)


def normalized(text: Column) -> Column:
    """Lower case, stripped: the form phrases and terms are looked up in."""
    return py_strip(F.lower(text))


def telling_parts(phrases: list[str]) -> list[str]:
    """Few literals of which every phrase holds one: long words, those that most phrases share first, else the phrase itself."""
    parts, left = [], sorted(set(phrases))
    while left:
        words = sorted({w for p in left for w in p.split() if len(w) > 4})
        best = max(words, key=lambda w: (sum(w in p for p in left), len(w)), default=left[0])
        parts.append(best)
        left = [p for p in left if best not in p]
    return parts


def phrase_threats(norm: Column, rules: RuleSet = REPAIRED) -> Column:
    """One critical threat per blocked phrase present, at its first position in the normalized text."""
    phrases = F.array(*[F.lit(p.lower()) for p in rules.blocked_phrases])
    present = F.filter(phrases.cast("array<string>"), lambda p: F.contains(norm, p))

    def to_threat(p: Column) -> Column:
        at = F.instr(norm, p) - 1
        return _threat(
            "instruction_override",
            "critical",
            p,
            F.concat(F.lit("Blocked phrase detected: '"), p, F.lit("'")),
            at,
            at + F.length(p),
        )

    return F.transform(present, to_threat).cast(THREATS_TYPE)


def rule_pattern(rule: RegexRule) -> str:
    """Injection rules always match across lines and in any letter case."""
    return jregex(rule.pattern, ignore_case=True, multiline=True)


def regex_threats(text: str, low: str, rule: RegexRule, guard: str | None = None) -> Column:
    """One threat per match of one rule, left to right; ``low`` names the text in lower case, ``guard`` (SQL) takes the place of
    the rule's literals."""
    kind, severity, text_ = map(sql_text, (rule.threat_type, rule.severity, rule.description))
    spans = spans_sql(text, rule_pattern(rule), guard or may_match(low, rule.needs))
    return F.expr(
        f"cast(transform({spans}, m -> struct({kind}, {severity}, m.value, {text_}, m.start, m.`end`, 1D))"
        f" AS {THREATS_TYPE})"
    )


def term_warnings(norm: Column, rules: RuleSet = REPAIRED) -> Column:
    """One warning per suspicious term present."""
    terms = F.array(*[F.lit(t.lower()) for t in rules.warning_terms]).cast("array<string>")
    return F.transform(
        F.filter(terms, lambda t: F.contains(norm, t)),
        lambda t: F.concat(F.lit("Suspicious term detected: '"), t, F.lit("'")),
    )


def has_control_chars(text: Column) -> Column:
    return text.rlike(CONTROL_CHARS)


def excessive_formatting(text: Column) -> Column:
    """More than 6 code fences or more than 10 horizontal rules."""
    return (substring_count(text, "```") > CODE_FENCE_LIMIT) | (
        substring_count(text, "---") > RULE_LINE_LIMIT
    )


def instruction_word_count(low: Column) -> Column:
    """Occurrences of instruction words in the lowered text, also inside longer words."""
    return sum((substring_count(low, w) for w in INSTRUCTION_WORDS), F.lit(0))


def heuristic_threats(text: Column, ratio_col: str, words: Column) -> Column:
    """Control characters, special characters, formatting and instruction density, in that order."""
    ratio = F.col(ratio_col)
    return F.array_compact(
        F.array(
            F.when(
                has_control_chars(text),
                _threat(
                    "encoding_bypass",
                    "high",
                    "[control characters]",
                    "Suspicious control characters detected",
                ),
            ),
            F.when(
                ratio > SPECIAL_RATIO_LIMIT,
                _threat(
                    "encoding_bypass",
                    "medium",
                    F.concat(F.lit("special_char_ratio="), fixed2(ratio_col)),
                    "Unusually high ratio of special characters",
                    confidence=F.least(ratio * 2, F.lit(1.0)),
                ),
            ),
            F.when(
                excessive_formatting(text),
                _threat(
                    "context_manipulation",
                    "medium",
                    "[excessive formatting]",
                    "Potential formatting-based injection attempt",
                ),
            ),
            F.when(
                words > INSTRUCTION_WORD_LIMIT,
                _threat(
                    "instruction_override",
                    "medium",
                    F.concat(F.lit("instruction_word_count="), words.cast("string")),
                    "High concentration of instruction-related words",
                    confidence=F.least(words / 10, F.lit(1.0)),
                ),
            ),
        )
    )


def encoding_warnings(text: Column, entropy_col: str) -> Column:
    """High entropy, then a base64-like run."""
    return F.array_compact(
        F.array(
            F.when(
                F.col(entropy_col) > ENTROPY_LIMIT,
                F.concat(
                    F.lit("High text entropy ("),
                    fixed2(entropy_col),
                    F.lit(") - possible encoded content"),
                ),
            ),
            F.when(text.rlike(BASE64_RUN), F.lit("Potential base64 encoded content detected")),
        )
    )


def first_marker(text: str, low: str, rules: RuleSet = REPAIRED, guards: list[str] | None = None) -> Column:
    """The first conversation-marker pattern that occurs, else null."""
    hits = [
        F.when(matches(text, jregex(m.pattern), low, m.needs, guard), F.lit(m.pattern))
        for m, guard in zip(rules.conversation_markers, guards or [None] * len(rules.conversation_markers))
    ]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def simulates_system(text: str, low: str, rules: RuleSet = REPAIRED, guard: str | None = None) -> Column:
    known = rules.system_simulation
    if known is None:
        return F.lit(False)
    return matches(text, jregex(known.pattern), low, known.needs, guard)


def structure_threats(text: str, low: str, rules: RuleSet = REPAIRED, guards: list[str] | None = None) -> Column:
    """Fake conversation marker, then system-prompt simulation."""
    marker = first_marker(text, low, rules, guards[:-1] if guards else None)
    return F.array_compact(
        F.array(
            F.when(
                marker.isNotNull(),
                _threat(
                    "context_manipulation", "high", marker, "Fake conversation marker detected"
                ),
            ),
            F.when(
                simulates_system(text, low, rules, guards[-1] if guards else None),
                _threat(
                    "context_manipulation",
                    "critical",
                    "system prompt simulation",
                    "Attempt to simulate system prompt",
                ),
            ),
        )
    )


def risk_score(threats: Column, n_warnings: Column) -> Column:
    """``1 - exp(-x)`` with x the weighted confidences plus a tenth per warning."""
    weight = F.create_map(*[F.lit(v) for kv in SEVERITY_WEIGHT.items() for v in kv])
    total = F.aggregate(
        threats,
        F.lit(0.0),
        lambda acc, t: acc + F.element_at(weight, t["severity"]) * t["confidence"],
    )
    return F.least(1 - F.exp(-(total + n_warnings * F.lit(0.1))), F.lit(1.0))


def thresholds(sensitivity: str) -> tuple[float, float]:
    """(block, warn) scores; an unknown sensitivity counts as medium."""
    return THRESHOLDS.get(sensitivity, THRESHOLDS["medium"])


def check_id(key: Column, text: Column) -> Column:
    """12 hex digits from key and text. The original's id depends on a memory address; this one is ours
    and the same on every run."""
    return F.substring(F.sha2(F.concat_ws("\0", key.cast("string"), text), 256), 1, 12)


def detect_injection(
    df: DataFrame,
    text_col: str,
    rules: RuleSet = REPAIRED,
    sensitivity: str = "high",
    enabled: bool = True,
    extra_threats: str | None = None,
    key_col: str | None = None,
    prefix: str = "",
    low_col: str | None = None,
) -> DataFrame:
    """Add ``is_safe``, ``risk_score``, ``threats`` and ``warnings`` (and ``check_id`` with a key).

    Threats come in the order phrases, regex rules, heuristics, structure; warnings in the order terms,
    entropy, base64, elevated score. ``extra_threats`` names an ``array<threat>`` column, for instance
    from a classifier, that is scored along. A null text counts as empty. ``low_col`` names a column that holds
    ``lower(text_col)`` already.
    """
    names = {n: prefix + n for n in ("is_safe", "risk_score", "threats", "warnings", "check_id")}
    identity = (
        {names["check_id"]: check_id(F.col(key_col), F.col(text_col))} if key_col else {}
    )
    if not enabled:
        return df.withColumns(
            {
                names["is_safe"]: F.lit(True),
                names["risk_score"]: F.lit(0.0),
                names["threats"]: F.array().cast(THREATS_TYPE),
                names["warnings"]: F.array().cast(WARNINGS_TYPE),
                **identity,
            }
        )

    text, low, norm = F.col("__text"), F.col("__low"), F.col("__norm")
    staged = df.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    staged = staged.withColumn("__low", F.coalesce(F.col(low_col), F.lit("")) if low_col else F.lower(text))
    simulation = rules.system_simulation.needs if rules.system_simulation else ()
    needs = (
        (tuple(telling_parts([p.lower() for p in rules.blocked_phrases])),),
        (tuple(t.lower() for t in rules.warning_terms),),
        *(r.needs for r in rules.injection_rules),
        *(m.needs for m in rules.conversation_markers),
        simulation,
    )
    # Short texts were not asked and are simply searched, as for conditions beyond those that fit.
    guards = [f"coalesce(getbit(__may, {i}) = 1, true)" if i < MOST_NEEDS else "true" for i in range(len(needs))]
    n_rules = len(rules.injection_rules)
    staged = staged.withColumn("__measures", text_measures(text, ENTROPY_MIN_LENGTH, INSTRUCTION_WORDS, needs))
    staged = staged.withColumns(
        {
            "__norm": py_strip(low),
            "__may": F.col("__measures.may"),
            "__ratio": special_ratio(text, F.col("__measures.special")),
            "__words": F.coalesce(F.col("__measures.words"), instruction_word_count(low)),
            "__entropy": F.col("__measures.entropy"),
        }
    )
    extra = F.col(extra_threats).cast(THREATS_TYPE) if extra_threats else F.lit(None)
    staged = staged.withColumns(
        {
            names["threats"]: F.concat(
                F.when(F.expr(guards[0]), phrase_threats(norm, rules)).otherwise(F.array().cast(THREATS_TYPE)),
                *[regex_threats("__text", "__low", r, g) for r, g in zip(rules.injection_rules, guards[2:])],
                heuristic_threats(text, "__ratio", F.col("__words")),
                structure_threats("__text", "__low", rules, guards[2 + n_rules :]),
                F.coalesce(extra, F.array()).cast(THREATS_TYPE),
            ),
            "__warnings": F.concat(
                F.when(F.expr(guards[1]), term_warnings(norm, rules)).otherwise(F.array().cast(WARNINGS_TYPE)),
                encoding_warnings(text, "__entropy")
            ),
        }
    )
    staged = staged.withColumn(
        names["risk_score"], risk_score(F.col(names["threats"]), F.size("__warnings"))
    )
    score = F.col(names["risk_score"])
    block, warn = thresholds(sensitivity)
    elevated = F.when(
        (score >= warn) & (score < block),
        F.array(F.concat(F.lit("Elevated risk score: "), fixed2(names["risk_score"]))),
    ).otherwise(F.array().cast(WARNINGS_TYPE))
    return staged.withColumns(
        {
            names["is_safe"]: score < block,
            names["warnings"]: F.concat("__warnings", elevated),
            **identity,
        }
    ).drop("__text", "__low", "__measures", "__norm", "__may", "__ratio", "__words", "__entropy", "__warnings")


def explode_findings(df: DataFrame, key_cols: list[str], array_col: str, number: str) -> DataFrame:
    """One row per array element, numbered from 1.

    The outer form is on purpose: for the inner one Spark puts a filter on the array below the projection
    that makes it, and so computes all findings twice.
    """
    rows = df.select(*key_cols, F.posexplode_outer(array_col).alias(number, "t"))
    return rows.where(F.col(number).isNotNull()).select(
        *key_cols, (F.col(number) + 1).alias(number), "t.*"
    )


def threats_table(df: DataFrame, key_cols: list[str], threats_col: str = "threats") -> DataFrame:
    """One row per threat with its 1-based place in the list."""
    return explode_findings(df, key_cols, threats_col, "threat_no")
