import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docwarden.llm import bpe, chat, components, html, pack, pii, quality, simhash, tokenfile, tokens

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, fp string, spans string"
ODD_TEXTS = [
    None, "", " ", "\n", "a", "a b", "A B c", "a  b\tc", "x\r\ny", " z", "é ü ß", "it's don't", "tail ", "\nhead", "<|endoftext|> x",
    "日本語 テキスト", "a\x1cb", "word " * 700, "😀 😀😀", "1 2 33 444", "a\n\nb", "Ünïcode-ẞ",
]


def documents(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "clash", "clash") for i, t in enumerate(texts)], DOCS).repartition(3)


# ------------------------------------------------------------------ near duplicates


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0D]+", text)
    sh = [" ".join(w[j : j + 3]) for j in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def linked(fps):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    base = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(40)) for _ in range(12)]
    texts = ODD_TEXTS + base * 3 + [b + " more" for b in base] + [b.upper() for b in base]
    out = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    fps = [fingerprint(t) for t in texts]
    roots = linked(fps)
    assert len(out) == len(texts)
    for i, f in enumerate(fps):
        assert out[i].fp & (2**64 - 1) == f and out[i].component_id == roots[i]
    monkeypatch.setattr(simhash, "WORDS_AT_ONCE", 50)
    assert [simhash.fingerprint(t) for t in texts] == fps


@pytest.mark.parametrize("group", [2048, 8])
def test_links_of_crowded_fingerprints(spark, group):
    rng = random.Random(group)
    fps = {0}
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(160):
            fps.add(centre ^ sum(1 << b for b in {rng.randrange(64) for _ in range(rng.randrange(7))}))
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, group)
    pairs = [(r.u & (2**64 - 1), r.v & (2**64 - 1)) for r in found.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    component = {r.node: r.component for r in components.connected_components(found).collect()}
    roots = linked(fps)
    mine = [component.get(s, s) for s in signed]
    assert len(set(zip(mine, roots))) == len(set(mine)) == len(set(roots))


def test_components_of_a_chain_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (201, 200), (200, 201)]
    out = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(out[i] == 0 for i in range(61)) and out[201] == out[200] == 200 and 100 not in out
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_group_stays(spark):
    texts = ["same words are here now", "same words are here now", None, "", "other words stand in this one", "other words stand in this one"]
    kept = simhash.keep_one(documents(spark, texts, ids=[5, 2, 7, None, 9, 9]))
    assert kept.columns == ["doc_id", "text", "fp", "spans"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(2, texts[0]), (7, None), (9, texts[4])]
    assert [r.doc_id for r in simhash.keep_one(documents(spark, ["x y z"] * 2, ids=[None, None])).collect()] == [None]
    assert simhash.keep_one(documents(spark, [])).count() == simhash.near_duplicates(documents(spark, [])).count() == 0


# ------------------------------------------------------------------ tokens


def expected_ids(texts):
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_encoder_equals_the_library(monkeypatch):
    texts = ODD_TEXTS + ["the of and " * 9, "Wörter, und mehr!\nund noch%%% eins***", "x" * 3000]
    want = expected_ids(texts)
    got = [np.frombuffer(b, "<u4").tolist() for b in tokens.Encoder(JSON)(texts)]
    assert got == want
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    monkeypatch.setattr(tokens, "REMEMBERED_PIECES", 5)
    monkeypatch.setattr(tokens, "AT_ONCE", 20)
    small = tokens.Encoder(JSON)
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in small(texts)] == want
        small.rest()


def test_texts_are_cut_as_by_the_library():
    library = Tokenizer.from_file(JSON).pre_tokenizer
    cut = tokens.Pieces(library)
    rng = random.Random(3)
    parts = [*" \n\t'strevlmdSaZ9!|", "\u00a0", "\u2003", "\u3000", "\x1c", "\x85", "é", "日", "😀", "\u0301", "½", "'s", "'re", "'ll", "  "]
    texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(3000)]
    data = [t.encode() for t in texts]
    starts = np.cumsum([0, *map(len, data)])
    joined = b"".join(data)
    at = cut(np.frombuffer(joined, np.uint8), starts).tolist()
    got = [joined[i:j].decode() for i, j in zip(at, [*at[1:], len(joined)], strict=True)]
    assert got == [t[i:j] for t in texts for _, (i, j) in library.pre_tokenize_str(t)]


def test_the_library_encodes_a_piece_once(monkeypatch):
    encoder, asked = tokens.Encoder(JSON), []
    learn = encoder._learned
    monkeypatch.setattr(encoder, "_learned", lambda pieces: asked.extend(pieces) or learn(pieces))
    monkeypatch.setattr(encoder, "_whole", lambda text: pytest.fail(f"encoded as a whole: {text!r}"))
    texts = ["one  two\tthree's", "", None, "\u2019one\u2019  two 😀\r\n\r\n "] * 50
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder(texts)] == expected_ids(texts)
    assert [len(b) for b in encoder([None, ""])] == [0, 0] and list(encoder([])) == []
    assert len(asked) == len(set(asked))


def check_packing(rows, texts, ids, capacity, end):
    want = sorted(((ids[i], np.array(e + [end], "<u4").tobytes()) for i, e in enumerate(expected_ids(texts))), key=str)
    whole = {}
    for r in rows:
        assert r.length * 4 == len(r.ids) and 0 < r.length <= capacity
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    for r in sorted(rows, key=lambda r: (str(r.id), r.piece)):
        whole.setdefault(r.id, []).append(r)
    if len(set(ids)) == len(ids):
        assert sorted(((k, b"".join(bytes(r.ids) for r in v)) for k, v in whole.items()), key=str) == want
        for v in whole.values():
            assert [r.piece for r in v] == list(range(len(v))) and all(r.length == capacity for r in v[1:])
    return len(bins)


def test_packing(spark):
    rng = random.Random(1)
    texts = ODD_TEXTS + [" ".join(rng.choice("one two three four five".split()) for _ in range(rng.randrange(1, 200))) for _ in range(200)]
    ids = [*range(len(texts) - 1), None]
    rows = pack.pack_documents(documents(spark, texts, ids), JSON, 128, 0).collect()
    n = check_packing(rows, texts, ids, 128, 0)
    assert n <= pack.lower_bound(np.array([r.length for r in rows]), 128) + 1
    again = pack.pack_documents(documents(spark, ["a b", "a b"], [1, 1]), JSON, 128, 0).collect()
    assert len(again) == 2 and pack.pack_documents(documents(spark, []), JSON).count() == 0


def test_small_blocks_pack_as_well(spark, monkeypatch):
    texts = ["w " * n for n in list(range(1, 60)) * 3]
    monkeypatch.setattr(pack, "BLOCK_PIECES", 16)
    rows = pack.pack_documents(documents(spark, texts), JSON, 64, 0).collect()
    check_packing(rows, texts, list(range(len(texts))), 64, 0)


def test_local_search_empties_bins():
    lengths = np.array([6, 5, 5, 4, 4, 3, 3])
    bound = pack.lower_bound(lengths, 10)
    assert bound == 3
    spread = [[0, 5], [1, 3], [2, 4], [6]]
    assert len(pack.local_search(spread, lengths, 10, bound)) == 3
    # Two for one: 4 and 3 make room by going where a 6 stood.
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = rng.integers(1, 60, 120)
        bins = pack.pack(lengths, 60)
        assert sorted(x for b in bins for x in b) == list(range(120)) and all(lengths[b].sum() <= 60 for b in bins)
        assert pack.lower_bound(lengths, 60) <= len(bins) <= pack.lower_bound(lengths, 60) + 1
        worse = [[i] for i in range(120)]
        found = pack.local_search(worse, lengths, 60, pack.lower_bound(lengths, 60))
        assert sorted(x for b in found for x in b) == list(range(120)) and all(lengths[b].sum() <= 60 for b in found)


def test_search_goes_on_while_exchanges_are_left():
    # Best fit misses the bound by far on these: three pieces a bin leave little room.
    lengths = np.random.default_rng(2).integers(650, 760, 4000)
    first = pack.best_fit(lengths, 2048)
    found = pack.pack(lengths, 2048)
    assert len(first) == 1694 and len(found) <= 1635
    assert sorted(x for b in found for x in b) == list(range(4000)) and all(lengths[b].sum() <= 2048 for b in found)


def test_no_exchange_is_left():
    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths = rng.integers(1, 40, 40)
        found = pack.local_search([[i] for i in range(40)], lengths, 61, 0)
        fill = [int(lengths[b].sum()) for b in found]
        under = [i for i, f in enumerate(fill) if f < 61]
        assert sorted(x for b in found for x in b) == list(range(40))
        for a in under:
            for b in under:
                for i, x in enumerate(found[a]):
                    for y in found[a][i:]:
                        s = int(lengths[x] + (lengths[y] if y != x else 0))
                        for t in (0, *lengths[found[b]].tolist()):
                            assert a == b or s <= t or s - t > 61 - fill[b] or fill[b] - fill[a] + s - t <= 0


def test_token_files(spark):
    texts = ODD_TEXTS + ["same", "same"]
    ids = [50 - i for i in range(len(ODD_TEXTS))] + [None, 50]
    out = tokenfile.stored_documents(documents(spark, texts, ids), JSON, end_id=2).collect()
    rows = sorted(((-(10**9) if i is None else i), e + [2]) for i, e in zip(ids, expected_ids(texts)))
    out.sort(key=lambda r: (-(10**9) if r.id is None else r.id, r.start))
    assert len(out) == len(rows)
    at = 0
    for r, (i, e) in zip(out, rows):
        if i != 50:
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(e), zlib.crc32(np.array(e, "<u4").tobytes()))
        else:
            assert r.n_tokens in [len(x) for j, x in rows if j == 50]
        at += r.n_tokens
    assert tokenfile.stored_documents(documents(spark, []), JSON).count() == 0


@pytest.mark.parametrize("width", [2, 4])
def test_keyed_access(tmp_path, width):
    writer = tokenfile.ShardWriter(f"file://{tmp_path}/s.tokens", width)
    ids = [None, *range(-5, 3000, 3), 3000, 3000]
    for k, i in enumerate(ids):
        writer.add(i, np.arange(k % 7, dtype="<u4").tobytes())
    writer.close()
    reader = tokenfile.ShardReader(f"file://{tmp_path}/s.tokens")
    for k, i in enumerate(ids[:-1]):
        assert reader.get(i).tolist() == list(range(k % 7))
    assert reader.get(3000, 1).tolist() == list(range((len(ids) - 1) % 7)) and reader.get(3000, 2) is None
    assert sum(reader.get(i) is not None for i in range(10**6, 10**6 + 500)) == 0
    assert len(list(tmp_path.iterdir())) == 1


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000)).astype(np.uint64)
    assert sorted(tokenfile.PerfectHash.built(keys).slots(keys)) == list(range(len(keys)))


def test_byte_pairs_equal_tiktoken(spark, monkeypatch):
    texts = ODD_TEXTS + ["Wörter, und mehr!\nund noch%%% eins***", "x" * 3000, "\u0000­"]
    ranks = {t: r for r, t in enumerate(bpe.read_ranks(RANKS))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [enc.encode_ordinary(t or "") for t in texts]
    out = bpe.encode_texts(documents(spark, texts), RANKS, public_tokenizers.PATTERN)
    out = bpe.decode_ids(out, RANKS, public_tokenizers.PATTERN)
    for r in bpe.digests(out, RANKS, public_tokenizers.PATTERN).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id] and bytes(r.decoded) == (texts[r.doc_id] or "").encode()
        assert r.n_tokens == len(want[r.doc_id]) and r.ids_sha256 == hashlib.sha256(np.array(want[r.doc_id], "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    small = bpe.BytePairs(RANKS, public_tokenizers.PATTERN)
    assert [np.frombuffer(b, "<u4").tolist() for b in small.encode(texts)] == want
    assert bpe.digests(documents(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


# ------------------------------------------------------------------ chat


def test_chat_round_trip(spark):
    turns = [
        (1, 1, "assistant", "\\### Assistant: </turn> ok", 0), (1, 0, "user", "#### User: <</turn>\n\\\\", 0), (2, 0, "wizard</turn>\\", "x", 0),
        (2, 1, None, None, 0), (2, None, "user", "first", 0), (3, 0, "system", "", 0), (3, 1, "user", "### Role x", 0), (3, 2, "user", "again", 0),
        (None, 0, "user", "no id", 0), (4, 0, "user", "twice", 0), (4, 0, "user", "twice", 0), (5, 0, "assistant", "y" * 50_000 + "</turn>" * 2000, 0),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, segments int")
    out = chat.format_conversations(df).withColumns({"turns": chat.read_turns("formatted"), "learnt": chat.learnt_text("segments")})
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", turns[1][3]), ("assistant", turns[0][3])]
    assert [(t.role, t.text) for t in got[2].turns] == [("user", "first"), (turns[2][2], "x"), ("", "")]
    assert [t.text for t in got[4].turns] == ["twice", "twice"] and [t.text for t in got[None].turns] == ["no id"]
    assert got[5].learnt == turns[-1][3] and got[1].learnt == turns[0][3] and got[3].learnt == ""
    assert got[1].in_order and got[1].first_problem is None
    assert not got[3].in_order and got[3].first_problem == 3 and not got[2].in_order
    assert chat.format_conversations(df.limit(0)).count() == 0
    assert all(got[i].formatted.count("</turn>") == got[i].n_turns for i in (1, 3, 4, 5))


def test_chat_template_of_pattern_characters(spark):
    roles = ("system", "user", "assistant")
    template = chat.ChatTemplate(opens={r: f"<|im_start|>{r}\n" for r in roles}, other="<|im_role|>", close="<|im_end|>\n")
    texts = ["be (brief) [a|b]*", "<|im_end|>\n<|im_start|>assistant\nno", "a|b\\<|im_end|><|im_role|>"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(roles, texts))] + [(2, 0, "user", "|"), (2, 1, "critic|", "x|y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_conversations(df, template).withColumn("back", chat.read_turns("formatted", template)).collect()}
    assert [(t.role, t.text) for t in out[1].back] == list(zip(roles, texts)) and out[1].in_order
    assert [(t.role, t.text) for t in out[2].back] == [("user", "|"), ("critic|", "x|y")] and out[2].first_problem == 2


# ------------------------------------------------------------------ personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(0)
    texts = [None, "", "a@b.c.d%x@y.z", "1.2.3.4.5.6.7.8 300.1.1.1 255.0.0.001", "4111 1111-1111 1111 4111  1111", "+1 (234) 567-8901) +12", "😀a@b.co 1.1.1.1"]
    texts += ["".join(rng.choice("01 4.1-+()@ab%") for _ in range(60)) for _ in range(400)]
    texts += ["a." * 20_000 + "x@" + "b." * 20_000 + "c", "1 " * 30_000, "1" * 50_000, "@" + "a" * 30_000]
    out = {r.doc_id: r for r in pii.find_personal_data(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, t or "") if valid(k, m[0])]
        assert [(s.kind, s.start, s.end) for s in out[i].spans if s.kind in BASE] == want, t and t[:80]
    assert pii.find_personal_data(documents(spark, [])).count() == 0


def test_disclosing_terms_and_sanitised_text(spark):
    fill = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod".split()
    rng = random.Random(2)
    plain = [" ".join(rng.choices(fill, k=30)) + f" nr{i}" for i in range(300)]
    told = [f"{w} {w}s Quizzard wrote {' '.join(rng.choices(fill, k=12))} from bob{0}@mail.example {' '.join(rng.choices(fill, k=9))}" for w in ("alpha", "beta", "gamma", "delta")]
    copies = [f"rareword {told[0]} rareword"] * 5
    texts = plain + told + copies + ["the Quizzard again", "nothing here"]
    found = pii.find_personal_data(documents(spark, texts), generalise_at=0.85).withColumn("clean", pii.sanitised("text", "spans"))
    out = {r.text: r for r in found.collect()}
    kinds = {s.value: s.kind for r in out.values() for s in r.spans}
    assert kinds["bob0@mail.example"] == "email" and kinds.get("Quizzard") in ("general", "removed")
    assert "lorem" not in kinds and "rareword" not in kinds
    assert "Quizzard" not in out["the Quizzard again"].clean and out["nothing here"].clean == "nothing here"
    assert "[EMAIL]" in out[told[1]].clean and "bob0" not in out[told[1]].clean


def test_terms_behind_one_template_and_in_near_copies(spark):
    fill = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod".split()
    rng = random.Random(3)
    said = lambda n: " ".join(rng.choices(fill, k=n))
    plain = [f"{said(20)} nr{i}" for i in range(300)]
    # Different texts, the same 24 characters on either side of the address.
    footer = [f"{said(15)} Quizzard {said(9)} nr{i} -- for questions write to the desk at help@mail.example or come to the office at noon" for i in range(20)]
    near = [f"Brimwald {said(12)} {w} tell ann@corp.example about it" for w in ("alpha", "beta", "gamma", "delta")]
    near.append(f"{near[0]} again")
    texts = plain + footer + near + ["a Quizzard alone"]
    found = pii.find_personal_data(documents(spark, texts + near * 3)).collect()
    kinds = {s.value: s.kind for r in found for s in r.spans}
    # In 20 of 21 texts: ln(20 N / (20 * 21)) / ln(N / 20) of N = 326 is 0.983; always together is 1.
    assert kinds.get("Quizzard") == "general" and kinds.get("Brimwald") == "removed"
    assert "lorem" not in kinds and "alpha" not in kinds


def test_words_of_the_entity_outside_its_span_are_terms(spark):
    fill = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod".split()
    rng = random.Random(4)
    said = lambda n: " ".join(rng.choices(fill, k=n))
    plain = [f"{said(20)} nr{i}" for i in range(300)]
    told = [f"😀 {said(9)} Jane Doe {said(5)} jane.doe@corp.example, nr{i}" for i in range(10)]
    bare = "Jane Doe was at the corp"
    found = pii.find_personal_data(documents(spark, plain + told + [bare])).withColumn("clean", pii.sanitised("text", "spans"))
    out = {r.text: r for r in found.collect()}
    assert [(s.kind, s.value, s.start, s.end) for s in out[bare].spans] == [("general", "Jane", 0, 4), ("general", "Doe", 5, 8)]
    assert out[bare].clean == "[NAME] [NAME] was at the corp"
    for t in told:
        assert [s.value for s in sorted(out[t].spans, key=lambda s: s.start)] == ["Jane", "Doe", "jane.doe@corp.example"]
        assert out[t].clean == t.replace("Jane Doe", "[NAME] [NAME]").replace("jane.doe@corp.example", "[EMAIL]")
    odd = "x 1.2.3.4.5.6.7.8 +1 (234) 567-8901 4111 1111-1111 1111 😀a@b.co é"
    row = pii.base_spans(documents(spark, [odd]), "text").withColumn("s", pii.all_base()).select("s", F.expr(pii.bare("text", "s")).alias("b")).first()
    inside = {i for s in row.s for i in range(s.start, s.end)}
    assert row.b == "".join(" " if i in inside else c for i, c in enumerate(odd))


# ------------------------------------------------------------------ quality


def test_quality_learns_and_keeps_labels_out(spark):
    rng = random.Random(5)
    good = [" ".join(rng.choices("the plain words of a calm text go on here".split(), k=40)) + "." for _ in range(150)]
    bad = [" ".join(w + "%%%" for w in rng.choices("buy now cheap deal".split(), k=40)) for _ in range(150)]
    texts = good + bad + [None, "", "x" * 10_000]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    out = {r.doc_id: r for r in quality.score(docs, model).withColumns({"held": quality.held_out(), "p": quality.predicted()}).collect()}
    assert all(0 <= r.score <= 1 for r in out.values()) and len(out) == len(texts)
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in range(300) if out[i].held} == set(held)
    assert all(out[i].p == int(i < 150) for i in held)
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, flipped) == model
    # A repeated id is fitted on once, and fit_rows bounds rows.
    more = docs.union(docs.where("doc_id = 3").withColumn("many", F.explode(F.sequence(F.lit(1), F.lit(50)))).drop("many"))
    assert quality.fit(more, labels) == model
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(documents(spark, []), model).count() == 0


def test_pairs_in_linear_time():
    rng = np.random.default_rng(0)
    size = (1 << quality.WORD_BITS) + len(quality.STRUCTURE)
    m = quality.FactorisationMachine(0.3, rng.normal(size=size), rng.normal(size=(size, quality.FACTORS)))
    i, x = np.array([3, 70, 500, size - 1]), rng.normal(size=4)
    want = 0.3 + (m.w[i] * x).sum() + sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(4) for b in range(a))
    assert m.raw([(i, x), (i, x)])[0] == pytest.approx([want, want])


# ------------------------------------------------------------------ pages


def page(main, extra=""):
    return (
        f"<html><head><title>t</title><style>p{{}}</style><script>var x='</p>'</script></head><body><nav><a href='/'>Home</a></nav>{extra}"
        f"<article><h1>Head line</h1>{''.join(f'<p>{m}</p>' for m in main)}</article><footer>&copy; foot</footer></body>"
    )


def test_pages(spark):
    rng = random.Random(1)
    words = "calm text goes on here and then some more words follow".split()
    mains = [[" ".join(rng.choices(words, k=rng.randrange(5, 40))).capitalize() + "." for _ in range(rng.randrange(1, 7))] for _ in range(80)]
    pages = [page(m, "<div class='ad'>Buy this</div>" * rng.randrange(3)) for m in mains]
    odd = [None, "", "   ", "<p", "no tags at all &amp; more", "<div><!-- open", "<article><p>A &lt;b&gt;\n\t x<br>y<p>B<b>c</b></article>", "<p>" * 300]
    df = spark.createDataFrame([(i, h, "clash") for i, h in enumerate(pages + odd)], "page_id long, html string, text string")
    model = html.fit(df)
    out = {r.page_id: r.text for r in html.extract(df.drop("text"), model).collect()}
    assert len(out) == len(pages) + len(odd)
    for i, m in enumerate(mains):
        assert out[i] == "\n\n".join(["Head line", *m])
    n = len(pages)
    assert out[n] == out[n + 1] == out[n + 2] == out[n + 3] == out[n + 5] == ""
    assert [b.text for b in html.blocks_of(odd[6])] == ["A <b> x y", "Bc"]
    assert html.extract(df.drop("text").limit(0), model).count() == 0


def test_hidden_elements_end_where_they_must():
    texts = lambda p: [b.text for b in html.blocks_of(p)]
    assert texts("<html><head><title>x</title><meta charset=u><script>a</script>\n<body><p>one<p>two</body>") == ["one", "two"]
    assert texts("<head><title>x</title><div>one</div>") == texts("<head><title>x</title>one") == ["one"]
    assert texts("<head><head><html><style>s</style></head>one") == ["one"] and texts("<head><title>x</title><img src=i>one") == ["one"]
    assert texts("<head><template><p>no</template><noscript><p>no</noscript></head><p>one") == ["one"]
    assert [b.path for b in html.blocks_of("<html><head><title>x</title><body><p>one")] == [("html", "body", "p")]
    for name in ("svg", "math"):
        for a in ("/", " /", " width='1'/", " a=b /", " a/"):
            assert texts(f"<body><p>one<{name}{a}> two<p>three") == ["one two", "three"], a
        assert texts(f"<div>one<{name} a=b/>no</{name}></div>") == ["one"]
        assert texts(f"<div>one<{name}><script/><style/><g/>no</{name}> two</div>") == ["one two"]


def test_marked_pages_are_found_wherever_they_stand(spark, monkeypatch):
    rng = random.Random(6)
    words = "calm text goes on here and then some more words follow".split()
    few = [page([" ".join(rng.choices(words, k=20)) for _ in range(3)]) for _ in range(6)]
    plain = [f"<body><div>{i} no mark<!-- <article> --></div><p>{i}</p></body>" for i in range(300)]
    plain += [f"<body><aside><main>{i} named otherwise</main></aside></body>" for i in range(100)]
    seen = spark.createDataFrame([(i, h) for i, h in enumerate(plain + few + few[:1] * 200)], "page_id long, html string").repartition(3)
    only = spark.createDataFrame([(0, h) for h in few], "page_id long, html string")
    assert html.fit(seen, fit_pages=5) == html.fit(only, fit_pages=5) != html.fit(only, fit_pages=4)
    # Without any marked page all is kept.
    none = seen.where("page_id < 400")
    model = html.fit(none)
    assert html.main_texts([plain[0], few[0], None], html.Labeller.from_bytes(model))[0] == "0 no mark\n\n0"
    assert html.fit(none.limit(0)) == model
    # Blocks beyond the first window are learnt, and the same whether vectors are kept or not.
    nav = "".join(f"<div class='nav'>{i}</div>" for i in range(200))
    model = html.fitted([page(["late text."] * 3, nav)])
    assert model.to_bytes() != html.fitted([]).to_bytes()
    monkeypatch.setattr(html, "KEPT_BLOCKS", 0)
    assert model.to_bytes() == html.fitted([page(["late text."] * 3, nav)]).to_bytes()


def test_gradients_of_the_labeller():
    rng = np.random.default_rng(3)
    m = html.Labeller.new(rng)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, mask = html.padded([html.vectors(html.blocks_of(page(["a b", "c d e"][:k]))) for k in (1, 2)])
    x, mask = x.astype(np.float64), mask.astype(np.float64)
    y = (rng.random(mask.shape) < 0.5) * mask

    def loss():
        z = m.logits(x, mask)
        return (mask * (np.logaddexp(0, z) - y * z)).sum() / mask.sum()

    g = m.gradients(x, mask, y)
    for k in g:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        m.p[k][at] += 1e-4
        up = loss()
        m.p[k][at] -= 2e-4
        down = loss()
        m.p[k][at] += 1e-4
        assert (up - down) / 2e-4 == pytest.approx(g[k][at], rel=1e-3)
