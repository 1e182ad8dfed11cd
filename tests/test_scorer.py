"""Threats from a caller's model."""

import os

import pytest
from pyspark.sql import functions as F

from docwarden.operators.detect import detect_injection
from docwarden.operators.scorer import confidence, fit_words, model_threats


def as_df(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, t string")


def test_model_sees_bounded_batches_and_is_built_once_per_worker(spark, tmp_path):
    texts = ["a" * (i % 7) for i in range(200)] + [None, "b" * 5000]

    def factory():
        (tmp_path / f"built-{os.getpid()}-{len(list(tmp_path.iterdir()))}").touch()

        def scorer(some):
            assert len(some) <= 16 and (len(some) == 1 or sum(map(len, some)) <= 50)
            return [min(len(t), 10) / 10 for t in some]

        return scorer

    df = as_df(spark, texts).repartition(4)
    out = {r.id: r.c for r in df.select("id", confidence("t", factory, rows=16, chars=50).alias("c")).collect()}
    assert out == {i: min(len(t or ""), 10) / 10 for i, t in enumerate(texts)}
    built = [f.name.split("-")[1] for f in tmp_path.iterdir()]
    assert built and len(built) == len(set(built))


def test_threats_and_errors(spark):
    found = model_threats(as_df(spark, ["calm", "LOUD", None]).withColumn("threats", F.lit(1)), "t", lambda: lambda some: [0.75 if t.isupper() else 0.25 for t in some], "shouting", to="threats")
    out = {r.id: r.threats for r in found.collect()}
    assert out[0] == [] and out[2] == [] and [(t.threat_type, t.start, t.end, t.confidence) for t in out[1]] == [("shouting", 0, 4, 0.75)]
    scored = {r.id: r.risk_score for r in detect_injection(found.drop("threats").join(found.select("id", F.col("threats").alias("more")), "id"), "t", extra_threats="more").collect()}
    assert scored[0] == 0 and scored[1] == pytest.approx(1 - 2.718281828459045 ** (-0.7 * 0.75))
    for bad in (lambda some: [], lambda some: [2.0] * len(some), lambda some: [float("nan")] * len(some)):
        with pytest.raises(Exception, match="one confidence"):
            as_df(spark, ["x"]).select(confidence("t", lambda bad=bad: bad)).collect()
    with pytest.raises(ValueError):
        model_threats(found, "t", lambda: len, "x", severity="none")
    assert model_threats(as_df(spark, ["x"]).limit(0), "t", lambda: lambda some: [], "x").count() == 0


def test_word_model(spark):
    rows = [("You scum, YOU fool", 1)] * 5 + [("fool of you", 1)] + [("you and me", 0)] * 60 + [(None, 0), ("scum", None), ("fool", 0)]
    texts = spark.createDataFrame(rows, "t string, label int")
    model = fit_words(texts, "t", "label")()
    # "you" stands in most texts of either label.
    assert model(["scum fool", "Scum", "you", "", "SCUM!fool?scum"]) == [0.5, 0.25, 0.0, 0.0, 0.5]
    assert fit_words(texts, "t", "label", most_words=1)()(["scum", "fool"]) == [0.0, 0.25]
    assert fit_words(texts.where("label = 0"), "t", "label")()(["scum"]) == [0.0]
    assert fit_words(texts.limit(0), "t", "label")()(["scum"]) == [0.0]
