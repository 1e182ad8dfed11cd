"""Rules from a table."""

from __future__ import annotations

import logging
from dataclasses import replace

from pyspark.sql import DataFrame

from ..functions.regex import jregex, valid_patterns
from ..rules import REPAIRED, SEVERITY_WEIGHT, LeakRule, PiiRule, RegexRule, RuleSet

_log = logging.getLogger(__name__)


def rules_from_table(table: DataFrame, base: RuleSet = REPAIRED) -> RuleSet:
    """A rule set from rows ``kind, pattern, severity, description, name, action, replacement, ord``.

    Kinds: ``phrase``, ``term``, ``injection``, ``pii``, ``blocked_output``. A kind that has rows replaces
    the base set's rules of that kind, in the order of ``ord``; an invalid rule is left out with a warning.
    Rules are configuration: they are read whole, as they become part of the plan. All patterns are tried in one job.
    """
    spark = table.sparkSession
    rows = table.orderBy("ord").collect()
    flags = {"injection": {"ignore_case": True, "multiline": True}, "pii": {}, "blocked_output": {"ignore_case": True}}
    tried = [r for r in rows if r.kind in flags and r.pattern is not None]
    good = valid_patterns(spark, [jregex(r.pattern, **flags[r.kind]) for r in tried])
    invalid = {id(r) for r, ok in zip(tried, good, strict=True) if not ok}
    for r in tried:
        if id(r) in invalid:
            _log.warning("Rule left out: %s", r.pattern)

    def usable(row) -> bool:
        return row.pattern is not None and id(row) not in invalid

    def of(kind: str) -> list:
        return [r for r in rows if r.kind == kind]

    injection = [
        RegexRule(r.pattern, r.severity or "medium", r.description or "Unknown pattern")
        for r in of("injection")
        if (r.severity or "medium") in SEVERITY_WEIGHT
        and usable(r)
    ]
    pii = [
        PiiRule(r.name, r.pattern, r.action or "flag", r.replacement)
        for r in of("pii")
        if (r.action or "flag") in ("redact", "flag", "block") and usable(r)
    ]
    blocked = [
        LeakRule(r.pattern, r.description or "Blocked pattern")
        for r in of("blocked_output")
        if usable(r)
    ]
    given = {
        "blocked_phrases": (of("phrase"), tuple(r.pattern for r in of("phrase"))),
        "warning_terms": (of("term"), tuple(r.pattern for r in of("term"))),
        "injection_rules": (of("injection"), tuple(injection)),
        "pii_rules": (of("pii"), tuple(pii)),
        "blocked_outputs": (of("blocked_output"), tuple(blocked)),
    }
    return replace(base, **{field: made for field, (had, made) in given.items() if had})
