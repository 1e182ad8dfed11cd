import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from docwarden.llm import align, queries

from ..conftest import SF
from .test_text_operators import ODD_TEXTS, documents

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def brute_force(texts):
    """Rows of ``COLUMNS``, token by token with the libraries."""
    a_tok = Tokenizer.from_file(A_PATH)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    byte_of = {c: b for b, c in enumerate(align.byte_characters())}
    docs = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = [(i, bytes(byte_of[c] for c in a_tok.id_to_token(i))) for i in a_tok.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, b_tok.id_to_piece(i)) for i in b_tok.encode(text or "")]
        b = [(i, bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()) for i, p in b]
        if not text or b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
            docs.append(None)
            continue
        spans = []
        for tokens in (a, b):
            at, found = 0, []
            for i, t in tokens:
                found.append((i, at, at + len(t)))
                at += len(t)
            spans.append(found)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, links, start = [], [], 0
        for end in ends:
            ga, gb = ([x for x in s if start <= x[1] < end] for s in spans)
            groups.append(",".join(str(x[0]) for x in ga) + "|" + ",".join(str(x[0]) for x in gb))
            links += [(x[0], y[0]) for x in ga for y in gb if x[1] < y[2] and y[1] < x[2]]
            start = end
        docs.append((len(a), len(b), groups, links))
    counts = Counter(p for d in docs if d for p in set(d[3]))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(n, best.get(a, 0))
    return [
        (0, 0, 0, 0, 0, 0, "") if d is None else (
            d[0], d[1], len(d[2]), len(d[3]), sum(counts[p] == best[p[0]] for p in d[3]), sum(counts[p] for p in d[3]),
            hashlib.sha256(";".join(d[2]).encode()).hexdigest(),
        ) for d in docs
    ]


def more_texts():
    rng = random.Random(5)
    words = "the quick brun Fuchs springt über naïve zürich 12,345 don't 漢字 😀 http://x.y/z?a=b  x\n\ny \ttab ▁ <0x41> </s> <|endoftext|>".split(" ")
    random_texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 300))) for _ in range(25)]
    return ODD_TEXTS + random_texts + ["unsplit" * 400, "ÿ" * 300, "a▁b", " lead", "trail \n", "the quick " * 500, "ab cd " * 400 + "x" * 900 + " ef" * 300]


@pytest.mark.parametrize("sizes", [{}, {"size": 50, "near": 12, "block": 500, "fan_in": 3}, {"size": 7, "near": 3, "block": 5000, "fan_in": 2}])
def test_equals_brute_force(spark, sizes):
    texts = more_texts()
    ids = [None if i % 11 == 0 else i // 3 for i in range(len(texts))]
    df = documents(spark, texts, ids)
    got = align.align(df, A_PATH, B_PATH, id_col="doc_id", **sizes)
    assert got.columns == ["doc_id", *COLUMNS]
    want = sorted(((i is None, i or 0), row) for i, row in zip(ids, brute_force(texts), strict=True))
    assert sorted(((r.doc_id is None, r.doc_id or 0), tuple(r)[1:]) for r in got.collect()) == want


def test_fragments_compose_in_any_order():
    tok = align.tokenizers(A_PATH, B_PATH)
    rng = random.Random(2)
    for text in [t for t in more_texts() if t and "▁" not in t]:
        whole = [t.encode([" " + text])[0] for t in tok]
        ends = [np.cumsum(t.lengths[ids]) for t, ids in zip(tok, whole, strict=True)]
        starts = [e - t.lengths[ids] for t, ids, e in zip(tok, whole, ends, strict=True)]
        size = int(ends[0][-1])
        cuts = sorted({0, size, *(rng.randrange(size + 1) for _ in range(rng.randrange(12)))})
        parts = []
        for lo, hi in zip(cuts, cuts[1:]):
            (i, j), (k, m) = (np.searchsorted(s, [lo, hi]) for s in starts)
            parts.append(align.fragment(align.Tokens(whole[0][i:j], ends[0][i:j], whole[1][k:m], ends[1][k:m])))
        parts = [align.nothing(at_start=True), *parts, align.nothing()]
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [align.Fragment.read(align.compose(parts[i], parts[i + 1]).write())]
        one = align.compose(align.nothing(at_start=True), align.fragment(align.Tokens(whole[0], ends[0], whole[1], ends[1])))
        assert (parts[0].groups, parts[0].n.tolist()) == (one.groups, one.n.tolist())
        assert parts[0].codes.tolist() == one.codes.tolist() and parts[0].many.tolist() == one.many.tolist()
        assert not len(parts[0].suffix.a) and not len(parts[0].prefix.a) and parts[0].bounded


def test_ranges_end_within_words_and_cover_the_text():
    text = "alpha beta gammadelta " * 50 + "x" * 500 + " end of it"
    found = list(align.ranges(text, 64, 32, True))
    assert [r[0] for r in found[1:]] == [r[1] for r in found[:-1]] and found[0][0] == 0 and found[-1][1] == len(text) + 1
    assert any((" " + text)[r[1]] != " " for r in found[:-1])
    for lo, hi, at, stretch in found:
        assert at <= lo and at + len(stretch.encode()) >= hi and (" " + text)[at] == " "
    assert len(list(align.ranges(text, 64, 32, False))) == 1


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    out = queries.QUERIES["op11_align"](spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(r.doc_id, *w) for r, w in zip(rows, brute_force([r.text for r in rows]), strict=True)]


def test_empty_tables(spark):
    assert align.align(documents(spark, ["x"]).limit(0), A_PATH, B_PATH, id_col="doc_id").count() == 0
    (row,) = align.align(documents(spark, [None]), A_PATH, B_PATH, id_col="doc_id").collect()
    assert tuple(row) == (0, 0, 0, 0, 0, 0, 0, "")
