"""The detector's measures from one trip to Python against Spark's own, and what the guard's plan repeats."""

import random

from pyspark.sql import functions as F

from docwarden.functions.regex import may_match
from docwarden.functions.text import char_entropy, special_char_ratio, special_ratio, text_measures
from docwarden.operators.detect import detect_injection, instruction_word_count, phrase_threats, telling_parts
from docwarden.plans.screening import screen_texts
from docwarden.rules import BLOCKED_PHRASES, INJECTION_RULES, INSTRUCTION_WORDS, Settings

ODD = "K İ ı ſ Σ Å \U0001f600  \u0007     ​"


def _texts():
    pick = random.Random(3)
    words = [*ODD.split(" "), *"Ignore previous SYSTEM prompt must never mustnever eval( rot13 <| |> you are now, the ` ĳ x9 a-b".split(" ")]
    return [(i, " ".join(pick.choices(words, k=pick.randint(0, 40)))) for i in range(300)] + [(300, None), (301, "a" * 60), (302, "K" * 60)]


def test_measures_equal_the_expressions_they_stand_for(spark):
    text = F.coalesce("t", F.lit(""))
    needs = (*(r.needs for r in INJECTION_RULES), (("σ",),), ())
    df = spark.createDataFrame(_texts(), "id int, t string").withColumn("low", F.lower(text))
    df = df.withColumn("m", text_measures(text, 50, INSTRUCTION_WORDS, needs)).withColumn("asked", F.length(text) > 50)
    bits = [F.expr(f"getbit(m.may, {i}) = 1") for i in range(len(needs))]
    native = [F.expr(may_match("low", r.needs)) for r in INJECTION_RULES] + [F.lit(True), F.lit(True)]
    got = df.select(
        "asked", F.array(*bits).alias("may"), F.array(*native).alias("can"), F.col("m.words").alias("w"), instruction_word_count(F.col("low")).alias("words"),
        F.col("m.entropy").alias("e"), char_entropy(text, 50).alias("entropy"), special_ratio(text, F.col("m.special")).alias("r"), special_char_ratio(text).alias("ratio"),
    ).collect()
    assert sum(r.asked for r in got) > 100
    for r in got:
        assert r.r == r.ratio and r.e == r.entropy
        assert (r.w, r.may) == (r.words, r.can) if r.asked else r.w is None


def test_every_plain_character_is_counted_alike(spark):
    df = spark.range(1, 0x11000).where("id NOT BETWEEN 55296 AND 57343").selectExpr("repeat(decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32'), 60) AS t")
    m = text_measures(F.col("t"), 50)
    assert df.select(special_ratio(F.col("t"), m["special"]).alias("a"), special_char_ratio(F.col("t")).alias("b")).where("a <> b").count() == 0


def test_telling_parts_leave_no_phrase_out(spark):
    phrases = [p.lower() for p in BLOCKED_PHRASES] + ["", "a b", "σ x"]
    parts = telling_parts(phrases)
    assert all(any(x in p for x in parts) for p in phrases) and len(telling_parts(phrases[:-3])) < 20
    df = spark.createDataFrame([("x " * 30 + p.upper(),) for p in BLOCKED_PHRASES] + [("x " * 40,)], "t string")
    found = detect_injection(df, "t").withColumn("own", phrase_threats(F.trim(F.lower("t"))))
    same = F.slice("threats", 1, F.greatest(F.size("own"), F.lit(1)))
    assert found.where(F.size("own") > 0).where(same == F.col("own")).count() == len(BLOCKED_PHRASES)


def test_guard_names_the_findings_of_the_detector_once(spark):
    df = spark.createDataFrame([(1, "hello", b"{}", "a.json")], "request_id int, t string, content binary, filename string")
    out = screen_texts(df, "t", "t", Settings(), content_col="content")
    kept = out.select("injection_is_safe", "injection_warnings", "injection_risk_score", "file_warnings", "file_is_valid", "output_is_safe")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("shell_exec") <= 3
    added = [c for c in out.columns if c not in df.columns]
    assert [c.split("_")[0] for c in added] == sorted((c.split("_")[0] for c in added), key=("input", "injection", "file", "output").index)
