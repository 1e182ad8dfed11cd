"""The operators as queries over the given tables, with the SQL they must agree with where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.llm import align, ann, bpe, chat, html, pack, phrases, pii, quality, simhash, tokenfile, topk, treebpe
from docwarden.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return keep


@query(
    "op1_topk",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    WHERE rank <= 5
    """,
)
def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, k=5)


@query("op6_ann")
def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors.where(F.col("vec_id") % 20 == 0), vectors, k=20)


@query("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.listed("spans", base_only=True), 256).alias("base_sha256"), pii.listed("spans").alias("spans")
    )


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, most=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)
    return packed.select(
        F.col("id").alias("doc_id"),
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "sequence_id",
        F.col("offset").cast("long").alias("offset"),
    )


@query("op5_tokenfile")
def op5_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tokenfile.stored_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return stored.withColumnRenamed("id", "doc_id")


@query("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(docs, path, public_tokenizers.PATTERN).drop("text")


@query(
    "op2_chat",
    r"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    e AS (
      SELECT *, replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '### System: ', '#\## System: '),
        '### User: ', '#\## User: '), '### Assistant: ', '#\## Assistant: '), '### Tool: ', '#\## Tool: '),
        '### Role ', '#\## Role '), '</turn>', '<\/turn>') AS escaped,
        row_number() OVER o AS n, lag(role) OVER o AS previous FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
    m AS (
      SELECT *, CASE WHEN n = 1 THEN role IN ('system', 'user') WHEN previous = 'system' THEN role = 'user'
        WHEN previous IN ('user', 'tool') THEN role = 'assistant' WHEN previous = 'assistant' THEN role IN ('user', 'tool') ELSE false END AS fits FROM e)
    SELECT conv_id, bool_and(fits) AND max_by(role, n) <> 'system' AS in_order, CAST(min(n) FILTER (NOT fits) AS INTEGER) AS first_problem, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(length(escaped) + 8 + CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 WHEN 'tool' THEN 10
        ELSE 17 + length(role) END) AS BIGINT) AS formatted_chars
    FROM m GROUP BY conv_id
    """,
)
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    more = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))))).alias("t"))
    more = more.select(F.lit(-7).cast("long").alias("conv_id"), "t.turn", "t.role", F.lit(tricky).alias("text"))
    formatted = chat.format_conversations(turns.union(more))
    back = formatted.withColumns({"turns": chat.read_turns("formatted"), "learnt": chat.learnt_text("segments")})
    told = F.expr("array_join(transform(turns, t -> concat(t.role, '\n', t.text, '\n')), '')")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "in_order",
        "first_problem",
    )


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), "score", quality.predicted().alias("predicted")
    )


@query("op10_html")
def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html.extract(pages, html.fit(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op13_treebpe")
def op13_treebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return treebpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


@query("op11_align")
def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align.align(docs, a, b, id_col="doc_id")


@query(
    "op12_phrases",
    r"""
    WITH d AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
    s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
    g AS (SELECT lang, w[i : i + k - 1] AS words, k FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)),
    f AS (SELECT lang, array_to_string(words, ' ') AS phrase, any_value(words) AS words, any_value(k) AS k, count(*) AS f FROM g GROUP BY 1, 2
      HAVING count(*) >= 100),
    t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY 1),
    held AS (
      SELECT lang, array_to_string(words[i : i + m - 1], ' ') AS phrase, max(f) AS more
      FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2)) GROUP BY 1, 2),
    kept AS (SELECT f.* FROM f LEFT JOIN held USING (lang, phrase) WHERE k > 1 AND (more IS NULL OR 100 * more < 100 * f.f)),
    c AS (
      SELECT kept.lang, kept.phrase, cut, kept.f::HUGEINT AS a, l.f::HUGEINT AS l, r.f::HUGEINT AS r, n, (1000 * kept.f::HUGEINT * n) // (l.f::HUGEINT * r.f) AS score
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept) kept JOIN t USING (lang)
      JOIN f l ON l.lang = kept.lang AND l.phrase = array_to_string(kept.words[1 : cut], ' ')
      JOIN f r ON r.lang = kept.lang AND r.phrase = array_to_string(kept.words[cut + 1 :], ' ')),
    b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
    SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000
    """,
)
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))
