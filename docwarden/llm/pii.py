"""Personal data: patterns for the protected entities, corpus co-occurrence for the terms that give them away.

Native throughout. The four base kinds are found by pattern. A term discloses an entity as far as meeting it
makes the entity expected: pointwise mutual information over the entity's information content, 1 when the
term is never seen without the entity. Terms beyond a threshold are generalised, those beyond a second one removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docwarden.functions.regex import match_spans
from docwarden.llm.common import written

# The patterns of the base kinds. Loops are possessive, which changes no match (what follows cannot
# begin inside them) and lets Java run them without recursion or quadratic retries on long texts.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
#: A literal without which a text cannot match; texts without it are spared the pattern.
NEEDS = {"email": "contains({0}, '@')", "ip": "contains({0}, '.')", "phone": "contains({0}, '+')"}

#: Words that can be disclosing terms.
TERM = r"[\p{L}\p{N}]{3,}"
#: An entity or a pair counts as known from so many different texts.
SUPPORT = 3
GENERALISE_AT = 0.95
REMOVE_AT = 0.99
#: Bits of the filter that spares words the join with candidate terms: 2^17 slots of 64 bits, whatever the corpus.
SLOTS = 1 << 17

SPAN = "array<struct<value string, start int, `end` int>>"
ANY_SPAN = "array<struct<kind string, start int, `end` int, value string>>"


def _valid(kind: str) -> str | None:
    digits = "regexp_replace(s.value, '[^0-9]', '')"
    if kind == "ip":
        return "forall(split(s.value, '[.]'), p -> coalesce(try_cast(p AS bigint) <= 255, false))"
    if kind == "phone":
        return f"length({digits}) BETWEEN 8 AND 15"
    if kind == "card":
        doubled = "element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), d + 1)"
        luhn = (
            f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + aggregate(array(cast(substr(reverse({digits}), i, 1) AS int)),"
            f" 0, (z, d) -> if(i % 2 = 0, {doubled}, d))) % 10 = 0"
        )
        # The array of one result is made only for lengths a card can have.
        return f"CASE WHEN length({digits}) BETWEEN 16 AND 19 THEN {luhn} ELSE false END"
    return None


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """``df`` with one column of spans (value, start, end in code points) per base kind, named ``_email`` and so on."""
    found = {}
    for kind, pattern in PATTERNS.items():
        need = NEEDS.get(kind)
        found[f"_{kind}"] = match_spans(text, pattern, need.format(text) if need else None)
    df = df.withColumns(found)
    return df.withColumns({f"_{k}": F.expr(f"filter(_{k}, s -> {_valid(k)})") for k in KINDS if _valid(k)})


def all_base(kinds=KINDS) -> Column:
    """One array of all base spans, by kind, then start."""
    return F.expr("concat(" + ", ".join(f"transform(_{k}, s -> struct('{k}' AS kind, s.start AS start, s.`end` AS `end`, s.value AS value))" for k in kinds) + ")")


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def bare(text: str, spans: str) -> str:
    """SQL: ``text`` with blanks for each character of ``spans``, so that words keep their place and none begins in a span."""
    return f"""CASE WHEN size({spans}) = 0 THEN {text} ELSE aggregate(
        array_sort(transform({spans}, s -> struct(s.start AS start, s.`end` AS `end`))), struct(0 AS pos, '' AS done),
        (a, s) -> struct(greatest(a.pos, s.`end`) AS pos, concat(a.done, substr({text}, a.pos + 1, greatest(0, s.start - a.pos)),
                         repeat(' ', greatest(0, s.`end` - greatest(a.pos, s.start)))) AS done),
        a -> concat(a.done, substr({text}, a.pos + 1))) END"""


def occurrences(found: DataFrame) -> DataFrame:
    """``h`` (hash of the text), ``entity``: each entity of each different text, once."""
    return (
        found.where(F.size("_spans") > 0)
        .select(F.col("_h").alias("h"), F.explode("_spans").alias("s"))
        .select("h", F.concat_ws(":", "s.kind", F.lower("s.value")).alias("entity"))
        .distinct()
    )


def disclosing_terms(found: DataFrame, support: int, generalise_at: float, remove_at: float) -> tuple[DataFrame, DataFrame]:
    """Terms that disclose an entity (``term``, ``removed``), and where candidates stand (``term``, ``_key``).

    For an entity c and a term t of the same texts: PMI(c, t) = ln(co N / (n_c n_t)) and IC(c) = ln(N / n_c). All four
    are counted in different texts, so exact copies count once and a term never seen without c scores 1, however alike
    the texts are. Terms are those of texts whose base spans are blank (``_bare``): a word inside a span does not count, the
    same word outside one is scored like any other, also if the entity's own value has it. Pairs of fewer than ``support`` texts are left unestimated.
    """
    seen = occurrences(found)
    entities = seen.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support)
    known = seen.join(entities, "entity")
    texts = found.where(F.size("_spans") > 0).groupBy("_h").agg(F.min("_bare").alias("_bare"))
    pairs = (
        known.join(texts.withColumnRenamed("_h", "h"), "h")
        .select("entity", "n_entity", F.explode(words(F.col("_bare"))).alias("term"))
        .groupBy("entity", "n_entity", "term")
        .agg(F.count("*").alias("n_both"))
        .where(F.col("n_both") >= support)
    )
    # A term stands in at least as many texts as in those with base spans; by this bound alone, common words drop out.
    total = found.select(F.count_distinct("_h").alias("n")).first()["n"]
    seldom = texts.select(F.explode(words(F.col("_bare"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_least"))
    content = F.log(F.lit(float(max(total, 1))) / F.col("n_entity"))

    def pmi(n_term: str) -> Column:
        return F.log(F.col("n_both") * F.lit(float(max(total, 1))) / (F.col("n_entity") * F.col(n_term)))

    pairs = pairs.join(seldom, "term").where(
        (F.col("n_entity") < total) & (pmi("n_least") >= generalise_at * content)
    )
    pairs = written(pairs, "pii-pairs")
    terms = written(pairs.select("term").distinct(), "pii-candidates")
    # Fixed-size bits keep nearly all words out of the exact join; what they let through by chance, the join drops.
    slot = lambda h: h.bitwiseAND(F.lit(SLOTS - 1)).cast("int")
    bit = lambda h: F.expr("shiftleft(1L, cast(pmod(shiftright({h}, 17), 64) AS int))".format(h=h))
    bits = terms.select(F.xxhash64("term").alias("th")).groupBy(slot(F.col("th")).alias("slot")).agg(F.bit_or(bit("th")).alias("bits"))
    standing = (
        found.select("_key", "_h", F.explode(words(F.col("_bare"))).alias("term"))
        .withColumn("wh", F.xxhash64("term"))
        .withColumn("slot", slot(F.col("wh")))
        .join(F.broadcast(bits), "slot")
        .where(F.col("bits").bitwiseAND(bit("wh")) != 0)
        .join(terms, "term")
        .select("_key", "_h", "term")
    )
    standing = written(standing, "pii-standing")
    frequency = standing.groupBy("term").agg(F.count_distinct("_h").alias("n_term"))
    flagged = (
        pairs.join(frequency, "term")
        .withColumn("disclosed", pmi("n_term") / content)
        .groupBy("term")
        .agg(F.max("disclosed").alias("disclosed"))
        .where(F.col("disclosed") >= generalise_at)
        .select("term", (F.col("disclosed") >= remove_at).alias("removed"))
    )
    return flagged, standing


def _term_spans(text: str, terms: str) -> str:
    """SQL: spans of words of ``text`` that are in the map ``terms`` (lowered word to whether it is removed)."""
    low = f"array(regexp_extract_all({text}, '{TERM.replace(chr(92), chr(92) * 2)}', 0))"
    cut = f"split({text}, '{TERM.replace(chr(92), chr(92) * 2)}', -1)"
    starts = (
        "aggregate(zip_with(f, slice(if(size(c) = size(f), concat(array(''), c), c), 1, size(f)), (m, g) -> struct(length(m) AS m, length(g) AS g)),"
        " struct(0 AS pos, cast(array() AS array<int>) AS starts),"
        " (a, l) -> struct(a.pos + l.g + l.m AS pos, array_append(a.starts, a.pos + l.g) AS starts)).starts"
    )
    placed = f"transform(array({cut}), c -> filter(zip_with(f, {starts}, (v, s) -> struct(if({terms}[lower(v)], 'removed', 'general') AS kind, s AS start, s + length(v) AS `end`, v AS value)), w -> w.kind IS NOT NULL AND map_contains_key({terms}, lower(w.value))))[0]"
    return f"transform({low}, f -> {placed})[0]"


def find_personal_data(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    support: int = SUPPORT,
    generalise_at: float = GENERALISE_AT,
    remove_at: float = REMOVE_AT,
    to: str = "spans",
) -> DataFrame:
    """``docs`` with ``to`` (in the place of a column of that name): array of (kind, start, end, value), by kind (email, ip, card, phone, general, removed), then start.

    Offsets are code points, ends exclusive. Base spans come from patterns alone; general and removed ones are words that
    disclose a base entity of the corpus, words of its own value included, outside base spans. Null and empty texts have no
    spans; null and repeated ids and all other columns are kept as they are; an empty table gives no rows.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col))
    found = base_spans(
        docs.select(key.alias("_key"), F.xxhash64(text_col).alias("_h"), F.coalesce(text_col, F.lit("")).alias("_text")), "_text"
    ).select("_key", "_h", "_text", all_base().alias("_spans")).withColumn("_bare", F.expr(bare("_text", "_spans")))
    flagged, standing = disclosing_terms(found, support, generalise_at, remove_at)
    # Only texts in which a flagged term stands are in this table. Terms are looked up in the row's own text, so rows
    # that share a key do not disturb each other.
    marks = written(
        standing.join(flagged, "term").groupBy("_key").agg(F.map_from_entries(F.collect_set(F.struct("term", "removed"))).alias("_terms")), "pii-marks"
    )
    # Columns of the caller go by numbers meanwhile, so that none is taken for one of ours.
    kept = [c for c in docs.columns if c != to]
    out = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), key.alias("_key"), F.coalesce(text_col, F.lit("")).alias("_text"))
    out = base_spans(out, "_text").withColumn("_spans", all_base()).withColumn("_bare", F.expr(bare("_text", "_spans")))
    out = out.join(marks, "_key", "left")
    terms = F.expr(
        f"""CASE WHEN _terms IS NULL THEN cast(array() AS {ANY_SPAN}) ELSE
        array_sort({_term_spans('_bare', '_terms')}) END"""
    )
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), F.concat("_spans", terms).alias(to))


def listed(spans: str, base_only: bool = False) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    chosen = f"filter({spans}, s -> s.kind NOT IN ('general', 'removed'))" if base_only else spans
    return F.expr(f"concat_ws(',', transform({chosen}, s -> concat_ws(':', s.kind, s.start, s.`end`)))")


def sanitised(text: str = "text", spans: str = "spans") -> Column:
    """The text with base spans replaced by labels, general terms by their class, removed ones by nothing."""
    label = "CASE s.kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items())
    label += r" WHEN 'removed' THEN '' ELSE CASE WHEN s.value RLIKE '^[0-9]+$' THEN '[NUMBER]' WHEN s.value RLIKE '^\\p{Lu}' THEN '[NAME]' ELSE '[TERM]' END END"
    ordered = f"array_sort(transform({spans}, s -> struct(s.start AS start, s.`end` AS `end`, {label} AS label)))"
    # What overlaps an earlier span goes with it.
    folded = f"""aggregate({ordered}, struct(0 AS pos, '' AS done),
        (a, s) -> if(s.start >= a.pos, struct(s.`end` AS pos, concat(a.done, substr({text}, a.pos + 1, s.start - a.pos), s.label) AS done),
                     struct(greatest(a.pos, s.`end`) AS pos, a.done AS done)),
        a -> concat(a.done, substr({text}, a.pos + 1)))"""
    return F.expr(f"CASE WHEN size({spans}) = 0 THEN {text} ELSE {folded} END")
