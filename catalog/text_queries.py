"""Detector, output filter and sanitizer queries."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.functions.regex import py_strip
from docwarden.operators.phrase_table import find_phrases
from docwarden.functions.text import char_entropy, special_char_ratio
from docwarden.functions.unicode import nfkc
from docwarden.operators import detect as D
from docwarden.operators import outfilter as O
from docwarden.operators import sanitize as S
from docwarden.operators.scorer import fit_words, model_threats
from docwarden.rules import (
    BLOCKED_OUTPUTS,
    BLOCKED_PHRASES,
    CONVERSATION_MARKERS,
    CREDENTIAL_RULES,
    DISCLOSURE_PATTERNS,
    INJECTION_RULES,
    INSTRUCTION_WORDS,
    PII_RULES,
    REPAIRED,
    SHIPPED,
    SYSTEM_SIMULATION,
    WARNING_TERMS,
    threat_type_of,
)
from docwarden.sources.rules import rules_from_table

from .views import FRONT, PLANTED, PLANTED_CTE, documents, planted, quoted, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add




def _t() -> Column:
    return F.col("t")


def _low() -> Column:
    return F.lower("t")


CTE = f"WITH {PLANTED_CTE}"


def re2(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """Quoted pattern for DuckDB's engine."""
    flags = ("i" if ignore_case or pattern.startswith("(?i)") else "") + ("m" if multiline else "")
    body = pattern.removeprefix("(?i)")
    return quoted((f"(?{flags})" if flags else "") + body)


def injection_re2(rule) -> str:
    return re2(rule.pattern, ignore_case=True, multiline=True)


# ---------------------------------------------------------------- output filter

def _pii_stages(text: str, rules=PII_RULES, source: str = "planted", key: str = "doc_id") -> str:
    """CTEs p0..pn: text before each rule and the rule's matches, last to first."""
    out = [f"p0 AS (SELECT {key}, {text} AS t0 FROM {source})"]
    for i, r in enumerate(rules):
        pat = re2(r.pattern)
        after = f"regexp_replace(t{i}, {pat}, {quoted(r.redaction)}, 'g')" if r.action == "redact" else f"t{i}"
        out.append(
            f"p{i + 1} AS (SELECT *, list_reverse(regexp_extract_all(t{i}, {pat})) AS m{i}, {after} AS t{i + 1} FROM p{i})"
        )
    return ", ".join(out)


def _blocked_sql(text: str, rules=BLOCKED_OUTPUTS) -> str:
    parts = [f"CASE WHEN regexp_matches({text}, {re2(r.pattern, True)}) THEN {quoted(r.description)} END" for r in rules]
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def _leaks_sql(text: str, credentials=CREDENTIAL_RULES, disclosure=DISCLOSURE_PATTERNS) -> str:
    parts = [
        f"CASE WHEN regexp_matches({text}, {re2(r.pattern)}) THEN {quoted(r.description + ' detected in output')} END"
        for r in credentials
    ]
    any_of = " OR ".join(f"regexp_matches({text}, {re2(p.pattern)})" for p in disclosure)
    parts.append(f"CASE WHEN {any_of} THEN 'Potential system prompt disclosure detected' END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


@query(
    "filter_blocked_outputs",
    f"{CTE} SELECT doc_id, len({_blocked_sql('t')}) AS n_blocked, array_to_string({_blocked_sql('t')}, '|') AS blocked FROM planted",
)
def filter_blocked_outputs(spark: SparkSession, sf: str) -> DataFrame:
    found = planted(spark, sf).select("doc_id", O.blocked_descriptions("t").alias("b"))
    return found.select("doc_id", F.size("b").alias("n_blocked"), F.array_join("b", "|").alias("blocked"))


def _one_rule(i: int):
    rule = PII_RULES[i]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = planted(spark, sf).select("doc_id", O.pii_spans("t", rule).alias("m"))
        return found.select(
            "doc_id", F.size("m").alias("n_matches"), F.array_join(F.col("m.value"), "|").alias("found")
        )

    run.__name__ = f"pii_{rule.name}"
    sql = f"regexp_extract_all(t, {re2(rule.pattern)})"
    query(
        f"pii_{rule.name}",
        f"{CTE} SELECT doc_id, len({sql}) AS n_matches, array_to_string({sql}, '|') AS found FROM planted",
    )(run)


for _i in range(len(PII_RULES)):
    _one_rule(_i)


@query(
    "filter_redact",
    f"{CTE}, {_pii_stages('t')} SELECT doc_id, md5(t5) AS redacted, length(t5) AS n_chars,"
    " len(m0) + len(m1) > 0 AS was_modified FROM p5",
)
def filter_redact(spark: SparkSession, sf: str) -> DataFrame:
    out = O.filter_output(planted(spark, sf), "t", check_leaks=False)
    return out.select(
        "doc_id", F.md5("filtered_output").alias("redacted"), F.length("filtered_output").alias("n_chars"), "was_modified"
    )


def _flag_sql(i: int, name: str) -> str:
    # Start of the k-th match: lengths of the pieces before it.
    pat = re2(PII_RULES[i].pattern)
    pieces = f"string_split_regex(t{i}, {pat})"
    return (
        f"list_reverse(list_transform(range(1, len(m{i}) + 1), lambda k: 'PII detected ({name}): position ' ||"
        f" (CAST(coalesce(list_sum(list_transform({pieces}[1:k], lambda s: length(s))), 0) AS BIGINT)"
        f" + CAST(coalesce(list_sum(list_transform(list_reverse(m{i})[1:k - 1], lambda s: length(s))), 0) AS BIGINT)) || '-' ||"
        f" (CAST(coalesce(list_sum(list_transform({pieces}[1:k], lambda s: length(s))), 0) AS BIGINT)"
        f" + CAST(coalesce(list_sum(list_transform(list_reverse(m{i})[1:k], lambda s: length(s))), 0) AS BIGINT))))"
    )


@query(
    "filter_flag_warnings",
    f"{CTE}, {_pii_stages('t')} SELECT doc_id, array_to_string(list_concat(list_concat({_flag_sql(2, 'email')},"
    f" {_flag_sql(3, 'phone')}), {_flag_sql(4, 'ip_address')}), '|') AS flags FROM p5",
)
def filter_flag_warnings(spark: SparkSession, sf: str) -> DataFrame:
    out = O.filter_output(planted(spark, sf), "t", check_leaks=False)
    flags = F.filter("warnings", lambda w: w.startswith("PII"))
    return out.select("doc_id", F.array_join(flags, "|").alias("flags"))


@query(
    "filter_credential_leaks",
    f"{CTE} SELECT doc_id, array_to_string(list_filter({_leaks_sql('t')}, lambda x: x NOT LIKE '%disclosure%'), '|') AS leaks FROM planted",
)
def filter_credential_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return planted(spark, sf).select("doc_id", F.array_join(O.credential_warnings("t", "lower(t)"), "|").alias("leaks"))


@query(
    "filter_prompt_disclosure",
    f"{CTE} SELECT doc_id, {' OR '.join(f'regexp_matches(t, {re2(p.pattern)})' for p in DISCLOSURE_PATTERNS)} AS discloses FROM planted",
)
def filter_prompt_disclosure(spark: SparkSession, sf: str) -> DataFrame:
    return planted(spark, sf).select("doc_id", O.discloses_prompt("t", "lower(t)").alias("discloses"))


def _filter_sql(source: str, key: str, text: str, cte: str, rules=REPAIRED) -> str:
    n = len(rules.pii_rules)
    found = " + ".join(f"len(m{i})" for i in range(n))
    redacted = " + ".join(f"len(m{i})" for i, r in enumerate(rules.pii_rules) if r.action == "redact")
    flagged = " + ".join(f"len(m{i})" for i, r in enumerate(rules.pii_rules) if r.action == "flag")
    return (
        f"WITH {cte}b AS (SELECT *, {text} AS body, {_blocked_sql(text, rules.blocked_outputs)} AS blocked FROM {source}),"
        f" {_pii_stages('CASE WHEN len(blocked) = 0 THEN body END', rules.pii_rules, 'b', key + ', blocked')},"
        f" w AS (SELECT *, {_leaks_sql(f't{n}', rules.credential_rules, rules.disclosure_patterns)} AS leaks FROM p{n})"
        f" SELECT {key}, len(blocked) = 0 AS is_safe,"
        f" md5(CASE WHEN len(blocked) > 0 THEN {quoted(O.BLOCKED_TEXT)} ELSE t{n} END) AS filtered,"
        f" array_to_string(blocked, '|') AS blocked_patterns, coalesce({found}, 0) AS n_pii,"
        f" CASE WHEN len(blocked) > 0 THEN 0 ELSE {flagged} + len(leaks) END AS n_warnings,"
        f" len(blocked) > 0 OR coalesce({redacted}, 0) > 0 AS was_modified FROM w"
    )


def _filter_columns(out: DataFrame, key: str) -> DataFrame:
    return out.select(
        key,
        "is_safe",
        F.md5("filtered_output").alias("filtered"),
        F.array_join("blocked_patterns", "|").alias("blocked_patterns"),
        F.size("pii").alias("n_pii"),
        F.size("warnings").alias("n_warnings"),
        "was_modified",
    )


@query("filter_output", _filter_sql("planted", "doc_id", "t", PLANTED_CTE + ", "))
def filter_output(spark: SparkSession, sf: str) -> DataFrame:
    return _filter_columns(O.filter_output(planted(spark, sf), "t"), "doc_id")


@query("filter_output_pages", _filter_sql("pages", "page_id", "html", ""))
def filter_output_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _filter_columns(O.filter_output(spark.read.parquet(f"{sf}/pages.parquet"), "html"), "page_id")


@query("filter_output_shipped_rules", _filter_sql("planted", "doc_id", "t", PLANTED_CTE + ", ", SHIPPED))
def filter_output_shipped_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _filter_columns(O.filter_output(planted(spark, sf), "t", rules=SHIPPED), "doc_id")


@query(
    "filter_disabled",
    f"{CTE} SELECT doc_id, md5(t) AS filtered, true AS is_safe, false AS was_modified FROM planted",
)
def filter_disabled(spark: SparkSession, sf: str) -> DataFrame:
    out = O.filter_output(planted(spark, sf), "t", enabled=False)
    return out.select("doc_id", F.md5("filtered_output").alias("filtered"), "is_safe", "was_modified")


@query(
    "filter_custom_rule",
    f"{CTE} SELECT doc_id, len(regexp_extract_all(t, '\\bthe\\b')) AS n_custom,"
    " md5(regexp_replace(t, '\\bthe\\b', '[ARTICLE REDACTED]', 'g')) AS redacted FROM planted",
)
def filter_custom_rule(spark: SparkSession, sf: str) -> DataFrame:
    rules = REPAIRED.with_pii_rule(spark, "article", r"\bthe\b", "redact")
    only = type(rules)(pii_rules=rules.pii_rules[-1:])
    out = O.filter_output(planted(spark, sf), "t", check_leaks=False, rules=only)
    return out.select("doc_id", F.size("pii").alias("n_custom"), F.md5("filtered_output").alias("redacted"))


def _pii_table_sql() -> str:
    def start(i: int) -> str:
        # The k-th match from the left, as the lists hold the last match first.
        pieces, k = f"string_split_regex(t{i}, {re2(PII_RULES[i].pattern)})", f"(len(m{i}) - generate_subscripts(m{i}, 1) + 1)"
        return (
            f"CAST(list_sum(list_transform({pieces}[1:{k}], lambda s: length(s)))"
            f" + coalesce(list_sum(list_transform(list_reverse(m{i})[1:{k} - 1], lambda s: length(s))), 0) AS BIGINT)"
        )

    parts = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS rule, {quoted(r.name)} AS pii_type, {quoted(r.action)} AS action,"
        f" unnest(m{i}) AS value, generate_subscripts(m{i}, 1) AS pos, {start(i)} AS start FROM p5"
        for i, r in enumerate(PII_RULES)
    )
    return (
        f"{CTE}, {_pii_stages('t')} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rule, pos) AS match_no,"
        f" pii_type, action, value, start, start + length(value) AS stop FROM ({parts})"
    )


@query("pii_table", _pii_table_sql())
def pii_table(spark: SparkSession, sf: str) -> DataFrame:
    out = O.filter_output(planted(spark, sf), "t", check_leaks=False)
    rows = O.pii_table(out, ["doc_id"])
    return rows.select("doc_id", "match_no", "pii_type", "action", "value", "start", F.col("end").alias("stop"))


@query(
    "rules_from_table",
    f"{CTE}, d AS (SELECT doc_id, t, regexp_extract_all(t, ' de ') AS a, replace(t, ' de ', ' [de] ') AS t1 FROM planted),"
    " e AS (SELECT *, regexp_extract_all(t1, ' en ') AS b, replace(t1, ' en ', ' [en] ') AS t2 FROM d),"
    " f AS (SELECT *, regexp_extract_all(t2, ' es ') AS c, replace(t2, ' es ', ' [es] ') AS t3 FROM e),"
    " g AS (SELECT *, regexp_extract_all(t3, ' fr ') AS f, replace(t3, ' fr ', ' [fr] ') AS t4 FROM f)"
    " SELECT doc_id, len(a) + len(b) + len(c) + len(f) AS n_found, md5(t4) AS redacted,"
    " contains(lower(t), 'instruction')::INT AS n_phrases FROM g",
)
def rules_from_table_query(spark: SparkSession, sf: str) -> DataFrame:
    """Rules made from the languages of the documents: each language's name is redacted where it stands as a word."""
    names = table(spark, sf, "documents").select("lang").distinct()
    more = names.agg(F.max("lang").alias("lang")).selectExpr(
        "'phrase' AS kind", "'instruction' AS pattern", "NULL AS severity", "NULL AS description", "NULL AS name", "NULL AS action",
        "NULL AS replacement", "'0' AS ord",
    )
    pii = names.selectExpr(
        "'pii' AS kind", "' ' || lang || ' ' AS pattern", "NULL AS severity", "NULL AS description", "lang AS name", "'redact' AS action",
        "' [' || lang || '] ' AS replacement", "lang AS ord",
    )
    broken = names.selectExpr(
        "'pii' AS kind", "'(' || lang AS pattern", "NULL AS severity", "NULL AS description", "lang AS name", "'flag' AS action", "NULL AS replacement",
        "'z' AS ord",
    )
    rules = rules_from_table(pii.union(more).union(broken), REPAIRED)
    out = O.filter_output(planted(spark, sf), "t", check_leaks=False, rules=rules)
    return out.select(
        "doc_id", F.size("pii").alias("n_found"), F.md5("filtered_output").alias("redacted"), F.size(D.phrase_threats(F.lower("t"), rules)).alias("n_phrases")
    )


# ---------------------------------------------------------------- detector

_NORM = "trim(lower(t), ' ' || chr(9) || chr(10) || chr(13))"
_PHRASES = "[" + ", ".join(quoted(p.lower()) for p in BLOCKED_PHRASES) + "]"


@query(
    "detect_blocked_phrases",
    f"{CTE}, n AS (SELECT doc_id, {_NORM} AS n FROM planted), h AS (SELECT doc_id, n,"
    f" list_filter({_PHRASES}, lambda p: contains(n, p)) AS hits FROM n) SELECT doc_id, len(hits) AS n_threats,"
    " array_to_string(hits, '|') AS phrases, array_to_string(list_transform(hits, lambda p: (strpos(n, p) - 1) || '-' ||"
    " (strpos(n, p) - 1 + length(p))), '|') AS positions FROM h",
)
def detect_blocked_phrases(spark: SparkSession, sf: str) -> DataFrame:
    found = planted(spark, sf).select("doc_id", D.phrase_threats(D.normalized(_t())).alias("h"))
    span = F.transform("h", lambda h: F.concat_ws("-", h["start"].cast("string"), h["end"].cast("string")))
    return found.select(
        "doc_id",
        F.size("h").alias("n_threats"),
        F.array_join(F.col("h.pattern_matched"), "|").alias("phrases"),
        F.array_join(span, "|").alias("positions"),
    )


@query(
    "detect_phrase_table",
    f"{CTE}, n AS (SELECT doc_id, {_NORM} AS n FROM planted), rules AS (SELECT DISTINCT array_to_string(string_split(lower(text), ' ')[3:4], ' ') AS phrase,"
    " ['critical', 'high', 'medium'][doc_id % 4 + 1] AS severity FROM documents WHERE doc_id % 4 < 3),"
    " hits AS (SELECT doc_id, phrase, severity, strpos(n, phrase) - 1 AS pos FROM n JOIN rules ON contains(n, phrase) WHERE phrase <> '')"
    " SELECT doc_id, count(phrase) AS n_threats, md5(coalesce(string_agg(pos || ':' || phrase || ':' || severity, '|' ORDER BY pos, phrase, severity), '')) AS threats"
    " FROM n LEFT JOIN hits USING (doc_id) GROUP BY doc_id",
)
def detect_phrase_table(spark: SparkSession, sf: str) -> DataFrame:
    """As many rules as documents: two words of each, a quarter of them of a severity that is none."""
    severity = "element_at(array('critical', 'HIGH', 'medium', 'none'), cast(doc_id % 4 + 1 AS int))"
    rules = table(spark, sf, "documents").selectExpr("array_join(slice(split(text, ' ', 5), 3, 2), ' ') AS phrase", f"{severity} AS severity")

    def number_and_list(threats: pa.ListArray) -> pa.Array:
        """Of each text the number of threats, and place, phrase and severity of each."""
        each = threats.values
        place, phrase, severity = (each.field(x).cast(pa.string()) for x in ("start", "pattern_matched", "severity"))
        told = pa.ListArray.from_arrays(threats.offsets, pc.binary_join_element_wise(place, phrase, severity, ":"))
        return pa.StructArray.from_arrays([threats.value_lengths().cast(pa.int64()), pc.binary_join(told, "|")], ["n", "told"])

    found = find_phrases(planted(spark, sf), "t", rules, tell=number_and_list, tell_type="struct<n:bigint,told:string>")
    return found.select("doc_id", F.col("threats.n").alias("n_threats"), F.md5("threats.told").alias("threats"))


def _one_injection_rule(name: str, rule) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = planted(spark, sf).select("doc_id", D.regex_threats("t", "lower(t)", rule).alias("h"))
        return found.select(
            "doc_id",
            F.size("h").alias("n_threats"),
            F.array_join(F.col("h.pattern_matched"), "|").alias("found"),
            F.array_join(F.transform("h", lambda h: h["start"].cast("string")), "|").alias("starts"),
        )

    pat = injection_re2(rule)
    starts = (
        f"list_transform(range(1, len(m) + 1), lambda k: CAST(coalesce(list_sum(list_transform(string_split_regex(t, {pat})[1:k],"
        " lambda s: length(s))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda s: length(s))), 0) AS BIGINT))"
    )
    query(
        name,
        f"{CTE}, h AS (SELECT doc_id, t, regexp_extract_all(t, {pat}) AS m FROM planted)"
        f" SELECT doc_id, len(m) AS n_threats, array_to_string(m, '|') AS found, array_to_string({starts}, '|') AS starts FROM h",
    )(run)


RULE_QUERIES = (
    "detect_instruction_override", "detect_role_manipulation", "detect_prompt_extraction", "detect_code_execution",
    "detect_encoding_bypass", "detect_tag_injection", "detect_prompt_leaking",
)
for _name, _rule in zip(RULE_QUERIES, INJECTION_RULES):
    _one_injection_rule(_name, _rule)

_TERMS = "[" + ", ".join(quoted(t) for t in WARNING_TERMS) + "]"
_TERM_HITS = f"list_transform(list_filter({_TERMS}, lambda w: contains({_NORM}, w)), lambda w: 'Suspicious term detected: ''' || w || '''')"


@query("detect_warning_terms", f"{CTE} SELECT doc_id, array_to_string({_TERM_HITS}, '|') AS terms FROM planted")
def detect_warning_terms(spark: SparkSession, sf: str) -> DataFrame:
    return planted(spark, sf).select("doc_id", F.array_join(D.term_warnings(D.normalized(_t())), "|").alias("terms"))


_CONTROL = "regexp_matches(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')"


@query("detect_control_characters", f"{CTE} SELECT doc_id, {_CONTROL} AS has_control FROM planted")
def detect_control_characters(spark: SparkSession, sf: str) -> DataFrame:
    return planted(spark, sf).select("doc_id", D.has_control_chars(_t()).alias("has_control"))


_RATIO = (
    "length(regexp_replace(t, '[a-zA-Z0-9\\s.,!?;:''\"()-]', '', 'g'))::DOUBLE / greatest(length(t), 1)"
)


@query("detect_special_ratio", f"{CTE} SELECT doc_id, round({_RATIO}, 6) AS ratio, {_RATIO} > 0.3::DOUBLE AS unusual FROM planted")
def detect_special_ratio(spark: SparkSession, sf: str) -> DataFrame:
    ratio = special_char_ratio(_t())
    return planted(spark, sf).select(
        "doc_id", F.round(ratio, 6).alias("ratio"), (ratio > D.SPECIAL_RATIO_LIMIT).alias("unusual")
    )


def _times(text: str, piece: str) -> str:
    return f"((length({text}) - length(replace({text}, {quoted(piece)}, ''))) // {len(piece)})"


_FORMAT = f"({_times('t', '```')} > 6 OR {_times('t', '---')} > 10)"


@query("detect_formatting_abuse", f"{CTE} SELECT doc_id, {_FORMAT} AS abused FROM planted")
def detect_formatting_abuse(spark: SparkSession, sf: str) -> DataFrame:
    return planted(spark, sf).select("doc_id", D.excessive_formatting(_t()).alias("abused"))


_WORDS = "(" + " + ".join(_times("lower(t)", w) for w in INSTRUCTION_WORDS) + ")"


@query("detect_instruction_density", f"{CTE} SELECT doc_id, {_WORDS} AS n_words, {_WORDS} > 5 AS dense FROM planted")
def detect_instruction_density(spark: SparkSession, sf: str) -> DataFrame:
    words = D.instruction_word_count(_low())
    return planted(spark, sf).select("doc_id", words.alias("n_words"), (words > 5).alias("dense"))


_ENTROPY_CTE = (
    "chars AS (SELECT doc_id, c, count(*)::DOUBLE AS k FROM (SELECT doc_id, unnest(string_split(t, '')) AS c FROM planted"
    " WHERE length(t) > 50) GROUP BY doc_id, c), ent AS (SELECT doc_id, -sum(k / n * log2(k / n)) AS h FROM"
    " (SELECT *, sum(k) OVER (PARTITION BY doc_id) AS n FROM chars) GROUP BY doc_id)"
)


@query(
    "detect_entropy",
    f"{CTE}, {_ENTROPY_CTE} SELECT doc_id, round(h, 6) AS entropy, coalesce(h > 5.5::DOUBLE, false) AS is_high"
    " FROM planted LEFT JOIN ent USING (doc_id)",
)
def detect_entropy(spark: SparkSession, sf: str) -> DataFrame:
    found = planted(spark, sf).select("doc_id", char_entropy(_t(), D.ENTROPY_MIN_LENGTH).alias("h"))
    return found.select(
        "doc_id", F.round("h", 6).alias("entropy"), F.coalesce(F.col("h") > D.ENTROPY_LIMIT, F.lit(False)).alias("is_high")
    )


_BASE64 = "regexp_matches(t, '[A-Za-z0-9+/]{50,}={0,2}')"


@query("detect_base64_runs", f"{CTE} SELECT doc_id, {_BASE64} AS has_run FROM planted")
def detect_base64_runs(spark: SparkSession, sf: str) -> DataFrame:
    return planted(spark, sf).select("doc_id", _t().rlike(D.BASE64_RUN).alias("has_run"))


_MARKER = "CASE " + " ".join(
    f"WHEN regexp_matches(t, {re2(m.pattern)}) THEN {quoted(m.pattern)}" for m in CONVERSATION_MARKERS
) + " END"


@query("detect_conversation_markers", f"{CTE} SELECT doc_id, {_MARKER} AS marker FROM planted")
def detect_conversation_markers(spark: SparkSession, sf: str) -> DataFrame:
    return planted(spark, sf).select("doc_id", D.first_marker("t", "lower(t)").alias("marker"))


_SIMULATES = f"regexp_matches(t, {re2(SYSTEM_SIMULATION.pattern)})"


@query("detect_system_simulation", f"{CTE} SELECT doc_id, {_SIMULATES} AS simulates FROM planted")
def detect_system_simulation(spark: SparkSession, sf: str) -> DataFrame:
    return planted(spark, sf).select("doc_id", D.simulates_system("t", "lower(t)").alias("simulates"))


def _detect_ctes(cte: str = PLANTED_CTE) -> str:
    counts = ", ".join(f"len(regexp_extract_all(t, {injection_re2(r)})) AS c{i}" for i, r in enumerate(INJECTION_RULES))
    weight = " + ".join(f"c{i} * {r.weight}::DOUBLE" for i, r in enumerate(INJECTION_RULES))
    n_regex = " + ".join(f"c{i}" for i in range(len(INJECTION_RULES)))
    return (
        f"WITH {cte}, {_ENTROPY_CTE}, f AS (SELECT doc_id, t, len(list_filter({_PHRASES}, lambda p: contains({_NORM}, p))) AS ph, {counts},"
        f" {_CONTROL}::INT AS ctl, {_RATIO} AS ratio, {_FORMAT}::INT AS fm, {_WORDS} AS wd, ({_MARKER} IS NOT NULL)::INT AS mk,"
        f" {_SIMULATES}::INT AS sim, {_TERM_HITS} AS terms, {_BASE64} AS b64, h FROM planted LEFT JOIN ent USING (doc_id)),"
        " g AS (SELECT *, list_concat(terms, list_filter([CASE WHEN h > 5.5::DOUBLE THEN"
        " 'High text entropy (' || format('{:.2f}', h) || ') - possible encoded content' END,"
        " CASE WHEN b64 THEN 'Potential base64 encoded content detected' END], lambda x: x IS NOT NULL)) AS warns FROM f),"
        f" s AS (SELECT *, ph + {n_regex} + ctl + (ratio > 0.3::DOUBLE)::INT + fm + (wd > 5)::INT + mk + sim AS n_threats,"
        f" least(1 - exp(-(ph + {weight} + ctl * 0.7::DOUBLE + CASE WHEN ratio > 0.3::DOUBLE THEN 0.4::DOUBLE * least(ratio * 2, 1) ELSE 0 END"
        " + fm * 0.4::DOUBLE + CASE WHEN wd > 5 THEN 0.4::DOUBLE * least(wd / 10::DOUBLE, 1) ELSE 0 END + mk * 0.7::DOUBLE + sim"
        " + len(warns) * 0.1::DOUBLE)), 1) AS score FROM g)"
    )


def _verdict_sql(block: float, warn: float, cte: str = PLANTED_CTE) -> str:
    return (
        f"{_detect_ctes(cte)} SELECT doc_id, round(score, 6) AS risk_score, score < {block}::DOUBLE AS is_safe, n_threats,"
        f" array_to_string(list_concat(warns, CASE WHEN score >= {warn}::DOUBLE AND score < {block}::DOUBLE"
        " THEN ['Elevated risk score: ' || format('{:.2f}', score)] ELSE [] END), '|') AS warnings FROM s"
    )


def _verdict_columns(out: DataFrame) -> DataFrame:
    return out.select(
        "doc_id",
        F.round("risk_score", 6).alias("risk_score"),
        "is_safe",
        F.size("threats").alias("n_threats"),
        F.array_join("warnings", "|").alias("warnings"),
    )


def _one_sensitivity(level: str, block: float, warn: float) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _verdict_columns(D.detect_injection(planted(spark, sf), "t", sensitivity=level))

    query(f"detect_verdict_{level}", _verdict_sql(block, warn))(run)


for _level, _block, _warn in (("low", 0.8, 0.6), ("medium", 0.6, 0.4), ("high", 0.4, 0.2)):
    _one_sensitivity(_level, _block, _warn)


# An unknown name counts as medium.
def _unknown_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return _verdict_columns(D.detect_injection(planted(spark, sf), "t", sensitivity="paranoid"))


query("detect_verdict_unknown", _verdict_sql(0.6, 0.4))(_unknown_sensitivity)


@query(
    "detect_extra_threats",
    f"{_detect_ctes()} SELECT doc_id, round(CASE WHEN doc_id % 3 = 0 THEN 1 - (1 - score) * exp(-0.35::DOUBLE) ELSE score END, 6) AS risk_score,"
    " n_threats + (doc_id % 3 = 0)::INT AS n_threats, CASE WHEN doc_id % 3 = 0 THEN 'model_judgement' END AS last FROM s",
)
def detect_extra_threats(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the documents bring a threat that another model found, of weight 0.7 and confidence a half."""
    found = "named_struct('threat_type', 'model_judgement', 'severity', 'high', 'pattern_matched', 'm', 'description', 'found elsewhere', 'start', 0, 'end', 1, 'confidence', 0.5D)"
    more = planted(spark, sf).withColumn("more", F.expr(f"CASE WHEN doc_id % 3 = 0 THEN array({found}) END"))
    out = D.detect_injection(more, "t", extra_threats="more")
    last = F.when(F.col("more").isNotNull(), F.element_at("threats", -1)["threat_type"])
    return out.select("doc_id", F.round("risk_score", 6).alias("risk_score"), F.size("threats").alias("n_threats"), last.alias("last"))


@query("detect_risk_score", f"{_detect_ctes()} SELECT doc_id, round(score, 6) AS risk_score FROM s")
def detect_risk_score(spark: SparkSession, sf: str) -> DataFrame:
    out = D.detect_injection(planted(spark, sf), "t")
    return out.select("doc_id", F.round("risk_score", 6).alias("risk_score"))


@query(
    "detect_conversations",
    _verdict_sql(0.4, 0.2, "planted AS (SELECT conv_id * 1000 + turn AS doc_id, text AS t FROM conversations)"),
)
def detect_conversations(spark: SparkSession, sf: str) -> DataFrame:
    talk = table(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn AS doc_id", "text AS t")
    return _verdict_columns(D.detect_injection(talk, "t"))


@query("detect_disabled", f"{CTE} SELECT doc_id, true AS is_safe, 0::DOUBLE AS risk_score FROM planted")
def detect_disabled(spark: SparkSession, sf: str) -> DataFrame:
    return D.detect_injection(planted(spark, sf), "t", enabled=False).select("doc_id", "is_safe", "risk_score")


@query(
    "detect_custom_rule",
    f"{CTE}, m AS (SELECT doc_id, len(regexp_extract_all(t, '(?im)^the\\s+\\w+')) AS n FROM planted)"
    " SELECT doc_id, n AS n_custom, round(1 - exp(-(n * 0.2::DOUBLE)), 6) AS custom_score FROM m",
)
def detect_custom_rule(spark: SparkSession, sf: str) -> DataFrame:
    rules = REPAIRED.with_injection_rule(spark, r"^the\s+\w+", "low", "Line opening with the article")
    rule = rules.injection_rules[-1]
    found = planted(spark, sf).select("doc_id", D.regex_threats("t", "lower(t)", rule).alias("h"))
    return found.select(
        "doc_id", F.size("h").alias("n_custom"), F.round(D.risk_score(F.col("h"), F.lit(0)), 6).alias("custom_score")
    )


@query("detect_check_id", f"{CTE} SELECT doc_id, substr(sha256(doc_id || chr(0) || t), 1, 12) AS check_id FROM planted")
def detect_check_id(spark: SparkSession, sf: str) -> DataFrame:
    return planted(spark, sf).select("doc_id", D.check_id(F.col("doc_id"), _t()).alias("check_id"))


def _threats_sql() -> str:
    cols = "doc_id, {sec} AS sec, {i} AS i, {j} AS j, {kind} AS threat_type, {sev} AS severity, {m} AS pattern_matched"

    def row(sec, i, kind, sev, m, where, j="0"):
        return "SELECT " + cols.format(sec=sec, i=i, j=j, kind=quoted(kind), sev=quoted(sev), m=m) + f" FROM s WHERE {where}"

    parts = [row(1, i, "instruction_override", "critical", quoted(p.lower()), f"contains({_NORM}, {quoted(p.lower())})") for i, p in enumerate(BLOCKED_PHRASES)]
    for i, r in enumerate(INJECTION_RULES):
        found = f"regexp_extract_all(t, {injection_re2(r)})"
        parts.append(row(2, i, threat_type_of(r.description), r.severity, f"unnest({found})", "true", f"generate_subscripts({found}, 1)"))
    parts += [
        row(3, 0, "encoding_bypass", "high", "'[control characters]'", "ctl = 1"),
        row(3, 1, "encoding_bypass", "medium", "'special_char_ratio=' || format('{{:.2f}}', ratio)".replace("{{", "{").replace("}}", "}"), "ratio > 0.3::DOUBLE"),
        row(3, 2, "context_manipulation", "medium", "'[excessive formatting]'", "fm = 1"),
        row(3, 3, "instruction_override", "medium", "'instruction_word_count=' || wd", "wd > 5"),
        row(4, 0, "context_manipulation", "high", _MARKER, "mk = 1"),
        row(4, 1, "context_manipulation", "critical", "'system prompt simulation'", "sim = 1"),
    ]
    return (
        f"{_detect_ctes()} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec, i, j) AS threat_no,"
        f" threat_type, severity, pattern_matched FROM ({' UNION ALL '.join(parts)})"
    )


@query("detect_threats_table", _threats_sql())
def detect_threats_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.threats_table(D.detect_injection(planted(spark, sf), "t"), ["doc_id"])
    return rows.select("doc_id", "threat_no", "threat_type", "severity", "pattern_matched")


@query(
    "detect_threat_types",
    f"SELECT threat_type, severity, count(*) AS n FROM ({_threats_sql()}) GROUP BY ALL",
)
def detect_threat_types(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.threats_table(D.detect_injection(planted(spark, sf), "t"), ["doc_id"])
    return rows.groupBy("threat_type", "severity").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- sanitizer

# Compatibility characters occur only where planted: the fi ligature and the Kelvin sign.
_NFKC = "replace(replace(nfc_normalize({t}), chr(64257), 'fi'), chr(8490), 'K')"
_CTRL = "regexp_replace({t}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"
_ESC = "replace(replace(replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_WS = (
    "regexp_replace(regexp_replace(replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[^\\S\\n]+', ' ', 'g'),"
    " '(?m) $', '', 'g')"
)
_STRIP = "trim({t}, ' ' || chr(9) || chr(10) || chr(13))"


def _sanitize_sql(limit: int, text: str = PLANTED) -> str:
    return (
        f"WITH planted AS (SELECT doc_id, {text} AS t FROM documents), a AS (SELECT doc_id, t, substr(t, 1, {limit}) AS cut FROM planted), b AS (SELECT *, {_NFKC.format(t='cut')} AS nf FROM a),"
        f" c AS (SELECT *, {_CTRL.format(t='nf')} AS cl FROM b), d AS (SELECT *, {_ESC.format(t='cl')} AS es FROM c),"
        f" e AS (SELECT *, {_WS.format(t='es')} AS ws FROM d), r AS (SELECT doc_id, t, {_STRIP.format(t='ws')} AS v,"
        f" list_filter([CASE WHEN length(t) > {limit} THEN 'Truncated from ' || length(t) || ' to {limit} characters' END,"
        " CASE WHEN nf <> cut THEN 'Normalized unicode characters' END, CASE WHEN cl <> nf THEN 'Removed control characters' END,"
        " CASE WHEN es <> cl THEN 'Escaped HTML entities' END, CASE WHEN ws <> t THEN 'Normalized whitespace' END],"
        " lambda x: x IS NOT NULL) AS mods FROM e)"
    )


@query(
    "sanitize_text",
    f"{_sanitize_sql(10000)} SELECT doc_id, true AS is_valid, md5(v) AS sanitized, length(v) AS n_chars,"
    " array_to_string(mods, '|') AS modifications, CASE WHEN length(t) > 10000 THEN 1 ELSE 0 END AS n_warnings FROM r",
)
def sanitize_text(spark: SparkSession, sf: str) -> DataFrame:
    out = S.sanitize_text(planted(spark, sf), "t")
    return out.select(
        "doc_id",
        "is_valid",
        F.md5("sanitized_value").alias("sanitized"),
        F.length("sanitized_value").alias("n_chars"),
        F.array_join("modifications", "|").alias("modifications"),
        F.size("warnings").alias("n_warnings"),
    )


@query("sanitize_modifications", f"{_sanitize_sql(500, FRONT)} SELECT doc_id, len(mods) AS n, array_to_string(mods, '|') AS modifications FROM r")
def sanitize_modifications(spark: SparkSession, sf: str) -> DataFrame:
    front = documents(spark, sf).selectExpr("doc_id", f"{FRONT} AS t")
    out = S.sanitize_text(front, "t", max_length=500)
    return out.select("doc_id", F.size("modifications").alias("n"), F.array_join("modifications", "|").alias("modifications"))


@query(
    "sanitize_type_check",
    "SELECT doc_id, doc_id % 7 <> 3 AS is_valid, CASE WHEN doc_id % 7 = 3 THEN 'Input must be a string' ELSE '' END AS errors,"
    " doc_id % 7 = 3 AS is_null FROM documents",
)
def sanitize_type_check(spark: SparkSession, sf: str) -> DataFrame:
    some = documents(spark, sf).selectExpr("doc_id", "CASE WHEN doc_id % 7 <> 3 THEN text END AS t")
    out = S.sanitize_text(some, "t")
    return out.select("doc_id", "is_valid", F.array_join("errors", "|").alias("errors"), F.col("sanitized_value").isNull().alias("is_null"))


def _one_step(name: str, make, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return planted(spark, sf).select("doc_id", F.md5(make(_t())).alias("result"), F.length(make(_t())).alias("n_chars"))

    expr = sql.format(t="t")
    query(name, f"{CTE} SELECT doc_id, md5({expr}) AS result, length({expr}) AS n_chars FROM planted")(run)


_one_step("sanitize_truncate", lambda t: F.substring(t, 1, 10000), "substr({t}, 1, 10000)")
_one_step("sanitize_nfkc", nfkc, _NFKC)
_one_step("sanitize_strip_controls", S.strip_controls, _CTRL)
_one_step("sanitize_escape_html", S.escape_html, _ESC)
_one_step("sanitize_whitespace", S.collapse_whitespace, _WS)
_one_step("sanitize_strip", py_strip, _STRIP)


@query("sanitize_pages", f"SELECT page_id, md5({_STRIP.format(t=_WS.format(t=_ESC.format(t='html')))}) AS sanitized FROM pages WHERE length(html) <= 10000"
       f" UNION ALL SELECT page_id, md5({_STRIP.format(t=_WS.format(t=_ESC.format(t='substr(html, 1, 10000)')))}) FROM pages WHERE length(html) > 10000")
def sanitize_pages(spark: SparkSession, sf: str) -> DataFrame:
    out = S.sanitize_text(spark.read.parquet(f"{sf}/pages.parquet"), "html")
    return out.select("page_id", F.md5("sanitized_value").alias("sanitized"))


_TELLING = (
    "known AS (SELECT toxic = 1 AS hit, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), lambda w: lower(w))) AS ws"
    " FROM documents JOIN labels USING (doc_id) WHERE toxic IN (0, 1)),"
    " n AS (SELECT count(*) FILTER (hit) AS all_hits, count(*) FILTER (NOT hit) AS all_others FROM known),"
    " w AS (SELECT word, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS others FROM (SELECT unnest(ws) AS word, hit FROM known) GROUP BY 1),"
    " telling AS (SELECT list(word) AS ws FROM (SELECT word FROM w, n WHERE hits >= 5 AND hits * all_others >= 8 * others * all_hits ORDER BY hits DESC, word LIMIT 5000)),"
    " c AS (SELECT doc_id, least(len(list_intersect(list_distinct(list_transform(regexp_extract_all(t, '[A-Za-z]+'), lambda w: lower(w))), coalesce(ws, []))), 4) / 4.0::DOUBLE AS conf"
    " FROM planted, telling)"
)


@query(
    "detect_model_threats",
    f"{_detect_ctes()}, {_TELLING} SELECT doc_id, CASE WHEN conf >= 0.5 THEN conf END AS confidence, n_threats + (conf >= 0.5)::INT AS n_threats,"
    " round(CASE WHEN conf >= 0.5 THEN 1 - (1 - score) * exp(-0.7::DOUBLE * conf) ELSE score END, 6) AS risk_score FROM s JOIN c USING (doc_id)",
)
def detect_model_threats(spark: SparkSession, sf: str) -> DataFrame:
    """A word model fitted on the texts that are labelled toxic or not; what it finds is scored along with the rules' threats."""
    known = documents(spark, sf).select("doc_id", "text").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    found = model_threats(planted(spark, sf), "t", fit_words(known, "text", "toxic"), "toxic_language", to="more")
    out = D.detect_injection(found, "t", extra_threats="more")
    return out.select("doc_id", F.get("more", F.lit(0))["confidence"].alias("confidence"), F.size("threats").alias("n_threats"), F.round("risk_score", 6).alias("risk_score"))
