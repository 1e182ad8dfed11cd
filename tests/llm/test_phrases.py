import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docwarden.llm import phrases

SCHEMA = "doc_id long, lang string, text string, phrase string, id string"


def brute_force(rows, longest=5, least=100, percent=100, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und" if lang is None else lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang, tuple(w[i : i + k])] += 1
    f = {p: c for p, c in f.items() if c >= least}
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or any(
            l2 == lang and len(q) > len(p) and 100 * c >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            for (l2, q), c in f.items()
        ):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    ranked, seen = [], Counter()
    for lang, score, a, p, left, right, total in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], p.decode(), -a, left, right, total, -score))
    return ranked


def rows(seed=1, n=150):
    rng = random.Random(seed)
    words = ["a", "B", "c", "Dd", "é", "É", "don't", "x y", "\x1c", "日本", "zz"]
    made = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n", "?", "\x0b"]) for _ in range(rng.randrange(60)))
        made.append((rng.choice(["en", "de", None, "und", ""]), text))
    made += [("en", "new york stock exchange opens")] * 40 + [("en", "new york")] * 7 + [("en", None), ("en", ""), (None, None), ("fr", "one word"), ("fr", " . ")]
    return made + [("en", "hot pair " * 400)]


@pytest.mark.parametrize(
    "args", [{"least": 5, "percent": 100}, {"least": 2, "percent": 60, "top": 40, "longest": 4}, {"least": 9, "percent": 50, "bits": 6, "burst": 3, "held": 20}, {"least": 10**6}]
)
def test_equals_brute_force(spark, args, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 700)
    made = rows()
    df = spark.createDataFrame([(None, lang, text, "clash", "clash") for lang, text in made], SCHEMA).repartition(3)
    got = phrases.collocations(df, **args)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_force(made, **{k: v for k, v in args.items() if k in ("least", "percent", "top", "longest")})
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert want or args["least"] > 1000


def test_trie_counts_bursts_and_spills():
    rng, want, got = random.Random(3), Counter(), Counter()
    trie = phrases.HatTrie(8, burst=5)
    for _ in range(60):
        block = Counter(tuple(rng.randrange(4) for _ in range(4)) for _ in range(rng.randrange(30)))
        want.update(block)
        in_order = sorted((np.array(p, ">i8").tobytes(), n) for p, n in block.items())
        trie.add([p for p, _ in in_order], [n for _, n in in_order])
        if trie.size > 60:
            before = trie.size
            for run, counts in trie.spill(30):
                assert run == sorted(run) and len({p[:8] for p in run}) == 1
                got.update(dict(zip(run, counts, strict=True)))
            assert trie.size <= 30 < before
    assert any(isinstance(t, phrases._Node) for t in trie.root.values())
    for run, counts in trie.spill(0):
        got.update(dict(zip(run, counts, strict=True)))
    assert got == {np.array(p, ">i8").tobytes(): n for p, n in want.items()} and trie.size == 0


def test_ids_and_bytes():
    ids = np.array([[1, 255], [256, 70000], [2**39, 0]])
    assert phrases.as_ids(phrases.as_bytes(ids, 5), 5).reshape(-1, 2).tolist() == ids.tolist()
    assert phrases.as_bytes(np.array([[258]]), 2) == b"\x01\x02"


def test_scores_beyond_64_bits(spark):
    a, n, left, right = 9_000_000_000_000_001, 8_000_000_000_000_003, 9_000_000_000_000_007, 1_000_003
    row = spark.sql(f"SELECT {a}L a, {n}L n, {left}L l, {right}L r").withColumn("score", F.expr(phrases.SCORE)).first()
    assert row.score == 1000 * a * n // (left * right)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(df).count() == 0
