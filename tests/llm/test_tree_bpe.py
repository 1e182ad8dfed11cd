import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docwarden.llm import queries, treebpe

from ..conftest import SF
from .test_text_operators import ODD_TEXTS, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def unsplit_texts():
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    common = "the and ing tion er on at en nd ha es re".split()
    return [
        "a" * 5000, "!" * 3000, "ab" * 1000 + "  " + "".join(rng.choice(letters) for _ in range(4000)), "日本語" * 700, "é" * 999 + "é" * 500,
        "".join(rng.choice(common) for _ in range(2000)), "x" * 600 + "<|endoftext|>" + "y" * 601 + "<|startoftext|><|endoftext|>", "1" * 900,
        "http://" + "/".join("".join(rng.choice(letters) for _ in range(90)) for _ in range(30)), "\x1c" * 300 + "z" * 400, "😀" * 400 + " end",
        "It's " + "don't" * 200, "　" * 500, "ſK" * 300, "HELLO" * 300 + "\n" + "straße" * 200,
    ]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("leaf", [1, 7, 256])
def test_ids_equal_the_library(spark, plain, leaf):
    texts = ODD_TEXTS + unsplit_texts()
    ids = [None if i % 9 == 0 else i // 2 for i in range(len(texts))]
    df = documents(spark, texts, ids)
    out = treebpe.decode_ids(treebpe.encode_texts(df, PATH, leaf=leaf), PATH).collect()
    assert len(out) == len(texts)
    for row in out:
        want = plain.encode(row.text or "", add_special_tokens=False).ids
        assert np.frombuffer(row.ids, "<u4").tolist() == want, row.text
        assert row.decoded == plain.decode(want, skip_special_tokens=False)
        assert row.fp == row.spans == "clash"


def test_trees_of_random_letters(plain):
    pairs, rng = treebpe.TreePairs(PATH), random.Random(3)
    for alphabet in ("ab", "thein", "abcdefghijklmnopqrstuvwxyz", "-=.", "åß日"):
        for n in (2, 3, 17, 200, 1500):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            parts = list(pairs.leaves(text, 2))
            ids, word = [], []
            for words, _, is_open, _ in parts:
                word.append(pairs.leaf_ids(words, is_open))
                if not is_open:
                    ids += pairs.tree(word)
                    word = []
            assert ids == plain.encode(text, add_special_tokens=False).ids


def test_joins_encode_windows_not_the_whole(monkeypatch):
    pairs, seen = treebpe.TreePairs(PATH), []
    word = "".join(random.Random(1).choice("abcdefghijklmnop") for _ in range(20000))
    left, right = pairs.leaf_ids([word[:10000]], True), pairs.leaf_ids([word[10000:]], False)
    inner = pairs.leaf_ids
    monkeypatch.setattr(pairs, "leaf_ids", lambda words, o: seen.append(len(words[0])) or inner(words, o))
    assert pairs.join(left, right, False) == inner([word], False)
    assert max(seen) < 500


def test_texts_are_put_together_from_words(plain, monkeypatch):
    monkeypatch.setattr(treebpe, "AT_ONCE", 50)
    monkeypatch.setattr(treebpe, "REMEMBERED", 7)
    text = "Some words, and\n\n more  words. " * 40 + "x" * 200 + " ́a  b"
    texts = [text, *ODD_TEXTS, *unsplit_texts(), "İstanbul Straße ŉa ªº µm Ǆabc' x's. don't!? _a_ a._- ÀÉÎõü$$$ e\u0301a ſ K Ω " + "".join(map(chr, range(33, 0x260))) + " " + " ".join(map(chr, range(33, 0x260))) + " a\x1c \x85b <|endoftext|>x \u2003y\r\n\tz <|end of|>", text]
    for at_spaces in (True, False):
        pairs = treebpe.TreePairs(PATH)
        assert pairs.at_spaces
        pairs.at_spaces = at_spaces
        found = [x.tolist() for x in pairs.encode(texts)]
        assert found == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_query_equals_the_library(spark, plain):
    want = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.QUERIES["op13_treebpe"](spark, SF).collect()
    assert len(out) == len(want)
    for row in out:
        ids = plain.encode(want[row.doc_id] or "", add_special_tokens=False).ids
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_table(spark):
    df = documents(spark, ["x"]).limit(0)
    assert treebpe.digests(df, PATH).count() == 0
    assert treebpe.encode_texts(df, PATH).columns == ["doc_id", "text", "fp", "spans", "ids"]
