"""Filtering of model answers: blocking, personal data, leak warnings. One narrow stage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import has_folded, jregex, match_spans, matches, may_match, replace_all, sql_text
from ..rules import REPAIRED, PiiRule, RuleSet
from .detect import explode_findings

PII_TYPE = (
    "array<struct<pii_type:string,value:string,start:int,end:int,action:string,replacement:string>>"
)

# Fixed value: what a blocked answer is replaced by.
BLOCKED_TEXT = "[OUTPUT BLOCKED:  Security policy violation detected]"


def blocked_descriptions(text: str, rules: RuleSet = REPAIRED, low: str | None = None, folded: str | None = None) -> Column:
    """Descriptions of the blocking rules that occur, in rule order; ``low`` names the text in lower case, ``folded`` its ``has_folded``."""
    low = low or f"lower({text})"
    hits = [
        F.when(matches(text, jregex(r.pattern, ignore_case=True), low, r.needs, may_match(low, r.needs, folded)), F.lit(r.description))
        for r in rules.blocked_outputs
    ]
    return F.array_compact(F.array(*hits)).cast("array<string>")


def _hint(text: str, rule: PiiRule) -> str | None:
    """SQL of a rule's hint; one without special characters is looked up as it stands."""
    if rule.hint is None:
        return None
    plain = re.escape(rule.hint) == rule.hint
    return f"contains({text}, {sql_text(rule.hint)})" if plain else f"{text} RLIKE {sql_text(jregex(rule.hint))}"


def pii_spans(text: str, rule: PiiRule) -> Column:
    """All matches of one rule, left to right."""
    hint = _hint(text, rule)
    return match_spans(text, jregex(rule.pattern), hint)


def redact_text(text: str, rule: PiiRule) -> Column:
    redacted = replace_all(F.col(text), jregex(rule.pattern), rule.redaction)
    if rule.hint is None:
        return redacted
    return F.when(F.expr(_hint(text, rule)), redacted).otherwise(F.col(text))


def credential_warnings(text: str, low: str, rules: RuleSet = REPAIRED, folded: str | None = None) -> Column:
    """One warning per credential shape that occurs; ``low`` names the text in lower case."""
    hits = [
        F.when(
            matches(text, jregex(r.pattern), low, r.needs, may_match(low, r.needs, folded)),
            F.lit(f"{r.description} detected in output"),
        )
        for r in rules.credential_rules
    ]
    return F.array_compact(F.array(*hits)).cast("array<string>")


def discloses_prompt(text: str, low: str, rules: RuleSet = REPAIRED, folded: str | None = None) -> Column:
    """True if any of the disclosure phrases occurs."""
    found = F.lit(False)
    for p in rules.disclosure_patterns:
        found = found | matches(text, jregex(p.pattern), low, p.needs, may_match(low, p.needs, folded))
    return found


def _as_pii(rule: PiiRule, spans: Column) -> Column:
    return F.transform(
        F.reverse(spans),
        lambda m: F.struct(
            F.lit(rule.name).alias("pii_type"),
            m["value"].alias("value"),
            m["start"].alias("start"),
            m["end"].alias("end"),
            F.lit(rule.action).alias("action"),
            F.lit(rule.replacement).cast("string").alias("replacement"),
        ),
    ).cast(PII_TYPE)


def _flag_texts(rule: PiiRule, spans: Column) -> Column:
    return F.transform(
        F.reverse(spans),
        lambda m: F.concat(
            F.lit(f"PII detected ({rule.name}): position "),
            m["start"].cast("string"),
            F.lit("-"),
            m["end"].cast("string"),
        ),
    )


def filter_output(
    df: DataFrame,
    text_col: str,
    redact_pii: bool = True,
    check_leaks: bool = True,
    rules: RuleSet = REPAIRED,
    enabled: bool = True,
    prefix: str = "",
    low_col: str | None = None,
) -> DataFrame:
    """Add ``is_safe``, ``filtered_output``, ``pii``, ``blocked_patterns``, ``warnings`` and
    ``was_modified``.

    Rules run in order, each on the text as redacted by the rules before it; within a rule, matches are
    listed last to first. A blocked answer skips everything after the blocking test. ``low_col`` names a column that
    holds ``lower(text_col)`` already.
    """
    n = {
        k: prefix + k
        for k in (
            "is_safe", "filtered_output", "pii", "blocked_patterns", "warnings", "was_modified",
        )
    }
    no_strings = F.array().cast("array<string>")
    source = F.col(text_col)
    if not enabled:
        return df.withColumns(
            {
                n["is_safe"]: F.lit(True),
                n["filtered_output"]: source,
                n["pii"]: F.array().cast(PII_TYPE),
                n["blocked_patterns"]: no_strings,
                n["warnings"]: no_strings,
                n["was_modified"]: F.lit(False),
            }
        )

    # Lowered once, and again where redaction changed the text; each in its own step, so that it is not repeated in every test.
    staged = df.withColumn("__low0", F.col(low_col) if low_col else F.lower(source))
    staged = staged.withColumn("__folded0", F.expr(has_folded("__low0")))
    blocked = blocked_descriptions(text_col, rules, "__low0", "__folded0") if check_leaks else no_strings
    staged = staged.withColumn(n["blocked_patterns"], F.coalesce(blocked, no_strings))
    is_blocked = F.size(n["blocked_patterns"]) > 0
    # Blocked rows carry a null through the later steps, so those cost nothing.
    staged = staged.withColumn("__t0", F.when(~is_blocked, source))
    temps = ["__t0", "__low0", "__folded0"]
    for i, rule in enumerate(rules.pii_rules):
        text = f"__t{i}"
        redacts = redact_pii and rule.action == "redact"
        staged = staged.withColumns(
            {
                f"__m{i}": pii_spans(text, rule),
                f"__t{i + 1}": redact_text(text, rule) if redacts else F.col(text),
            }
        )
        temps += [f"__m{i}", f"__t{i + 1}"]
    last, low, folded = f"__t{len(rules.pii_rules)}", "__low", "__folded"
    final = F.col(last)
    same = final == F.col("__t0")
    staged = staged.withColumn(low, F.when(same, F.col("__low0")).when(final.isNotNull(), F.lower(final)))
    staged = staged.withColumn(folded, F.when(same, F.col("__folded0")).otherwise(F.expr(has_folded(low))))
    temps += [low, folded]

    flags = [
        _flag_texts(rule, F.col(f"__m{i}"))
        for i, rule in enumerate(rules.pii_rules)
        if rule.action == "flag"
    ]
    disclosure = F.when(
        discloses_prompt(last, low, rules, folded),
        F.array(F.lit("Potential system prompt disclosure detected")),
    ).otherwise(no_strings)
    redacted = [
        F.size(f"__m{i}") > 0
        for i, rule in enumerate(rules.pii_rules)
        if redact_pii and rule.action == "redact"
    ]
    modified = is_blocked
    for r in redacted:
        modified = modified | r
    lists = [_as_pii(rule, F.col(f"__m{i}")) for i, rule in enumerate(rules.pii_rules)]
    return staged.withColumns(
        {
            n["is_safe"]: ~is_blocked,
            n["filtered_output"]: F.when(is_blocked, F.lit(BLOCKED_TEXT)).otherwise(final),
            n["pii"]: F.concat(*lists) if lists else F.array().cast(PII_TYPE),
            n["warnings"]: F.concat(
                *flags, F.coalesce(credential_warnings(last, low, rules, folded), no_strings), disclosure
            ),
            n["was_modified"]: modified,
        }
    ).drop(*temps)


def pii_table(df: DataFrame, key_cols: list[str], pii_col: str = "pii") -> DataFrame:
    """One row per personal-data match, in detection order."""
    return explode_findings(df, key_cols, pii_col, "match_no")
