"""Queries over files, requests, tasks, models and audit records."""

from __future__ import annotations

import datetime
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.functions.mime import mime_family
from docwarden.functions.templates import RESTRICTED_PROMPT, STEP_PROMPT, STEPS, SYSTEM_PROMPT, TEMPLATES
from docwarden.operators import admission as A
from docwarden.operators import documents as DO
from docwarden.operators import models as MO
from docwarden.operators import run as RU
from docwarden.operators import tasks as TA
from docwarden.operators import verdict as V
from docwarden.operators.admission_split import admit_requests_sliced
from docwarden.plans.screening import audit_screened, process_tasks, screen_requests
from docwarden.rules import AuditOptions, InputLimits, RateLimits, Settings
from docwarden.sources import audit as AU
from docwarden.sources import documents as SD
from docwarden.sources.contents import store_contents
from docwarden.sources import dimensions as D
from docwarden.streaming.admission import admit_stream, closing_mark
from docwarden.streaming.guard import guard_stream
from docwarden.workspace import work_folder

from . import views as W
from .text_queries import ORACLES, QUERIES, _filter_sql, _verdict_sql, query
from .views import quoted

# ---------------------------------------------------------------- sources and predicates


@query("source_files")
def source_files(spark: SparkSession, sf: str) -> DataFrame:
    """The files of the tables as documents, validated; none is of an allowed type. Those over the limit are not opened."""
    limits = InputLimits()
    read = SD.read_files(spark, sf, glob="*.parquet", recursive=True, max_bytes=int(limits.max_document_size_mb * 2**20))
    found = DO.validate_documents(read, mime_col=None, limits=limits, size_col="size_bytes")
    return found.select("filename", "doc_type", "size_bytes", "is_url", F.md5("content").alias("digest"), "is_valid")


@query(
    "source_urls",
    "SELECT page_id, url AS uri, url AS source, true AS is_url, 'text/html' AS doc_type, CAST(NULL AS BIGINT) AS size_bytes FROM pages",
)
def source_urls(spark: SparkSession, sf: str) -> DataFrame:
    out = SD.from_url_table(W.table(spark, sf, "pages"), ["page_id"], "url", F.lit("text/html"))
    return out.select("page_id", "uri", "source", "is_url", "doc_type", "size_bytes")


@query(
    "source_bytes",
    f"WITH {W.FILES_CTE} SELECT doc_id, 'bytes' AS source, strlen(c) AS size_bytes, 'application/pdf' AS doc_type, filename FROM files",
)
def source_bytes(spark: SparkSession, sf: str) -> DataFrame:
    out = SD.from_bytes_table(W.files(spark, sf), ["doc_id"], "content", F.lit("application/pdf"), F.col("filename"))
    return out.select("doc_id", "source", "size_bytes", "doc_type", "filename")


@query("source_texts", "SELECT doc_id, 'text' AS source, length(text) AS size_chars, 'text/plain' AS doc_type FROM documents")
def source_texts(spark: SparkSession, sf: str) -> DataFrame:
    out = SD.from_text_table(W.documents(spark, sf), ["doc_id"], "text")
    return out.select("doc_id", "source", "size_chars", "doc_type")


_DOCS = (
    f"d AS (SELECT doc_id, {W.DOC_TYPE} AS doc_type, CASE WHEN doc_id % 5 > 1 THEN text END AS text,"
    " CASE WHEN doc_id % 5 = 0 THEN 'http://d/' || doc_id END AS uri, CASE WHEN doc_id % 5 = 1 THEN text END AS content, n_chars FROM documents)"
)


@query(
    "document_facts",
    f"WITH {_DOCS} SELECT doc_id, coalesce(strlen(content), strlen(text), strlen(uri), 0) AS document_size, doc_id % 5 = 0 AS is_url,"
    " doc_type IN ('text/plain', 'text/markdown', 'text/html', 'text/csv', 'application/json') AS is_text_based,"
    " doc_type IN ('image/png', 'image/jpeg', 'image/webp', 'image/gif') AS is_image,"
    " doc_type IN ('audio/mpeg', 'audio/wav') AS is_audio, doc_type IN ('video/mp4', 'video/webm') AS is_video FROM d",
)
def document_facts(spark: SparkSession, sf: str) -> DataFrame:
    out = DO.with_document_facts(W.document_table(spark, sf))
    return out.select("doc_id", "document_size", "is_url", "is_text_based", "is_image", "is_audio", "is_video")


# ---------------------------------------------------------------- validation

# Byte 1001 continues a character (10xxxxxx): the cut at 1000 bytes falls inside it.
_SPLIT = "(strlen(c) > 1000 AND substr(hex(encode(c)), 2001, 1) IN ('8', '9', 'A', 'B'))"
_DETECT = (
    "CASE WHEN starts_with(c, '%PDF') THEN 'application/pdf' WHEN starts_with(c, 'GIF87a') OR starts_with(c, 'GIF89a')"
    " THEN 'image/gif' WHEN starts_with(c, 'RIFF') THEN 'audio/wav' WHEN starts_with(c, 'ID3') THEN 'audio/mpeg'"
    f" WHEN {_SPLIT} THEN 'application/octet-stream' ELSE 'text/plain' END"
)
_GUESS = (
    "CASE WHEN filename ILIKE '%.pdf' THEN 'application/pdf' WHEN filename ILIKE '%.json' THEN 'application/json'"
    " WHEN filename ILIKE '%.exe' THEN 'application/octet-stream' END"
)
_RESOLVED = f"coalesce(mime_type, {_GUESS}, {_DETECT})"
# Limit of 8 KiB, so that real texts cross it.
SMALL = InputLimits(max_document_size_mb=0.0078125)
_MB = "(strlen(c) / 1048576.0::DOUBLE)"
_SIZE_ERROR = (
    f"CASE WHEN {_MB} > 0.0078125::DOUBLE THEN 'Document size (' || format('{{:.2f}}', {_MB}) || 'MB) exceeds limit (0.0078125MB)' END"
)
_ALLOWED = "(" + ", ".join(quoted(m) for m in SMALL.allowed_mime_types) + ")"
_MIME_ERROR = f"CASE WHEN mime NOT IN {_ALLOWED} THEN 'MIME type ''' || mime || ''' is not allowed' END"
_CONTENT_WARNING = (
    "CASE WHEN mime = 'application/pdf' AND NOT starts_with(c, '%PDF') THEN 'File claims to be PDF but lacks PDF header'"
    " WHEN mime = 'application/json' AND NOT json_valid(c) THEN 'File claims to be JSON but is not valid JSON' END"
)
_CHECKED = (
    f"{W.FILES_CTE}, m AS (SELECT *, {_RESOLVED} AS mime FROM files), v AS (SELECT *,"
    f" list_filter([{_SIZE_ERROR}, {_MIME_ERROR}], lambda x: x IS NOT NULL) AS errors,"
    f" list_filter([{_CONTENT_WARNING}], lambda x: x IS NOT NULL) AS warnings FROM m)"
)


@query("validate_detect_mime", f"WITH {W.FILES_CTE} SELECT doc_id, {_DETECT} AS mime FROM files")
def validate_detect_mime(spark: SparkSession, sf: str) -> DataFrame:
    return W.files(spark, sf).select("doc_id", DO.detect_mime(F.col("content")).alias("mime"))


@query("validate_resolve_mime", f"WITH {W.FILES_CTE} SELECT doc_id, {_RESOLVED} AS mime FROM files")
def validate_resolve_mime(spark: SparkSession, sf: str) -> DataFrame:
    mime = DO.resolve_mime(F.col("content"), F.col("filename"), F.col("mime_type"))
    return W.files(spark, sf).select("doc_id", mime.alias("mime"))


@query("validate_size", f"WITH {W.FILES_CTE} SELECT doc_id, {_SIZE_ERROR} AS error FROM files")
def validate_size(spark: SparkSession, sf: str) -> DataFrame:
    return W.files(spark, sf).select("doc_id", DO.size_error("octet_length(content)", SMALL).alias("error"))


@query("validate_allow_list", f"WITH {_CHECKED} SELECT doc_id, {_MIME_ERROR} AS error FROM m")
def validate_allow_list(spark: SparkSession, sf: str) -> DataFrame:
    mime = DO.resolve_mime(F.col("content"), F.col("filename"), F.col("mime_type"))
    found = W.files(spark, sf).select("doc_id", mime.alias("mime"))
    return found.select("doc_id", DO.mime_error(F.col("mime")).alias("error"))


@query("validate_content", f"WITH {_CHECKED} SELECT doc_id, {_CONTENT_WARNING} AS warning FROM m")
def validate_content(spark: SparkSession, sf: str) -> DataFrame:
    mime = DO.resolve_mime(F.col("content"), F.col("filename"), F.col("mime_type"))
    found = W.files(spark, sf).withColumn("mime", mime)
    warned = DO.content_warnings(F.col("content"), F.col("mime"))
    return found.select("doc_id", F.try_element_at(warned, F.lit(1)).alias("warning"))


@query(
    "validate_documents",
    f"WITH {_CHECKED} SELECT doc_id, mime AS resolved_mime, len(errors) = 0 AS is_valid, array_to_string(errors, '|') AS errors,"
    " array_to_string(warnings, '|') AS warnings FROM v",
)
def validate_documents(spark: SparkSession, sf: str) -> DataFrame:
    out = DO.validate_documents(W.files(spark, sf), limits=SMALL)
    return out.select(
        "doc_id", "resolved_mime", "is_valid", F.array_join("errors", "|").alias("errors"),
        F.array_join("warnings", "|").alias("warnings"),
    )


def _one_batching(name: str, size: int) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        docs = W.files(spark, sf).withColumns(
            {"request_id": F.floor(F.col("doc_id") / size), "doc_index": (F.col("doc_id") % size).cast("int")}
        )
        out = DO.validate_batches(docs, limits=SMALL)
        return out.select(
            "request_id", "n_documents", "is_valid", F.array_join("errors", "|").alias("errors"),
            F.array_join("warnings", "|").alias("warnings"),
        )

    def listed(field: str, sep: str) -> str:
        return (
            f"coalesce(string_agg(array_to_string(list_transform({field}, lambda e: 'Document ' || place || '{sep}' || e), '|'), '|' ORDER BY place)"
            f" FILTER (WHERE len({field}) > 0), '')"
        )

    query(
        name,
        f"WITH {_CHECKED}, r AS (SELECT doc_id // {size} AS request_id, doc_id % {size} + 1 AS place, errors, warnings FROM v),"
        f" g AS (SELECT request_id, count(*) AS n_documents, {listed('errors', ':  ')} AS e, {listed('warnings', ': ')} AS w FROM r GROUP BY 1)"
        " SELECT request_id, n_documents, n_documents <= 20 AND e = '' AS is_valid, CASE WHEN n_documents > 20 THEN"
        " 'Number of documents (' || n_documents || ') exceeds limit (20)' ELSE e END AS errors,"
        " CASE WHEN n_documents > 20 THEN '' ELSE w END AS warnings FROM g",
    )(run)


_one_batching("validate_batches_oversized", 23)
_one_batching("validate_batches_at_limit", 20)

# ---------------------------------------------------------------- rate limiting

TIGHT = RateLimits(requests_per_minute=3, tokens_per_minute=12_000, concurrent_requests=4)


@query(
    "offered_load",
    f"WITH {W.REQUESTS_CTE} SELECT request_id, user_id, count(*) OVER w AS requests_last_minute, sum(tokens) OVER w AS tokens_last_minute"
    " FROM requests WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)",
)
def offered_load(spark: SparkSession, sf: str) -> DataFrame:
    out = A.offered_load(W.requests(spark, sf))
    return out.select("request_id", "user_id", "requests_last_minute", "tokens_last_minute")


def _admission_sql(limits: RateLimits, user: str = "user_id") -> str:
    """Sequential replay: one recursion step per position in a user's history, the state in a list."""
    recent = "list_filter(log, lambda x: x.us > q.us - 60000000)"
    hourly = "false" if limits.requests_per_hour is None else f"len(list_filter(log, lambda x: x.us > q.us - 3600000000)) >= {limits.requests_per_hour}"
    code = (
        f"CASE WHEN q.kind = 'release' THEN 0 WHEN s.active >= {limits.concurrent_requests} THEN 2"
        f" WHEN len({recent}) >= {limits.requests_per_minute} THEN 3 WHEN {hourly} THEN 4"
        f" WHEN coalesce(list_sum(list_transform({recent}, lambda x: x.tokens)), 0) + q.tokens > {limits.tokens_per_minute} THEN 5 ELSE 1 END"
    )
    keep = recent if limits.requests_per_hour is None else "list_filter(log, lambda x: x.us > q.us - 3600000000)"
    return (
        f"WITH RECURSIVE {W.REQUESTS_CTE}, q AS (SELECT *, {user} AS u, row_number() OVER (PARTITION BY {user} ORDER BY us, kind, request_id) AS k"
        " FROM (SELECT * REPLACE (CASE kind WHEN 'release' THEN 'release' ELSE 'request' END AS kind) FROM requests)),"
        " s AS (SELECT DISTINCT u, 0::BIGINT AS k, NULL::BIGINT AS request_id, 0 AS code, 0 AS active,"
        " []::STRUCT(us BIGINT, tokens BIGINT)[] AS log FROM q UNION ALL"
        " SELECT u, k, request_id, code, CASE code WHEN 0 THEN greatest(active - 1, 0) WHEN 1 THEN active + 1 ELSE active END,"
        " CASE WHEN code = 1 THEN list_append(kept, {'us': us, 'tokens': tokens}) ELSE kept END FROM"
        f" (SELECT q.u, q.k, q.request_id, q.us, q.tokens, s.active, {keep} AS kept, {code} AS code FROM s JOIN q ON q.u = s.u AND q.k = s.k + 1))"
    )


_ADMISSION_COLUMNS = (
    " SELECT request_id, CASE code WHEN 0 THEN NULL ELSE code = 1 END AS allowed, CASE code"
    " WHEN 2 THEN 'Concurrent request limit ({c}) exceeded' WHEN 3 THEN 'Rate limit ({m}/min) exceeded'"
    " WHEN 4 THEN 'Rate limit ({h}/hour) exceeded' WHEN 5 THEN 'Token limit ({t}/min) exceeded' END AS message FROM s WHERE k > 0"
)


def _admission(name: str, limits: RateLimits, user: str = "user_id") -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = W.requests(spark, sf).withColumn("u", F.expr(user))
        out = A.admit_requests(rows, user_col="u", kind_col="kind", limits=limits)
        return out.select("request_id", "allowed", "message")

    said = _ADMISSION_COLUMNS.format(
        c=limits.concurrent_requests, m=limits.requests_per_minute, h=limits.requests_per_hour, t=limits.tokens_per_minute
    )
    # ``release`` sorts before ``request``, as it must.
    query(name, _admission_sql(limits, user) + said)(run)


_admission("admit_requests", TIGHT)
_admission("admit_requests_hourly", RateLimits(requests_per_minute=3, concurrent_requests=1000, requests_per_hour=20))
# One user owns a third of the rows.
_admission(
    "admit_requests_hot_user",
    RateLimits(requests_per_minute=30, tokens_per_minute=140_000, concurrent_requests=2000),
    "CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END",
)


_SPLIT = RateLimits(requests_per_minute=30, tokens_per_minute=140_000, concurrent_requests=12)


@query(
    "admit_requests_split",
    _admission_sql(_SPLIT).replace(W.REQUESTS_CTE, W.BURSTS_CTE) + _ADMISSION_COLUMNS.format(c=12, m=30, h=None, t=140_000),
)
def admit_requests_split(spark: SparkSession, sf: str) -> DataFrame:
    """One user owns nine tenths of the rows, in bursts; the user's slices are decided by tasks of their own."""
    out = admit_requests_sliced(W.bursts(spark, sf), kind_col="kind", limits=_SPLIT)
    return out.select("request_id", "allowed", "message")


def _stateful(spark: SparkSession) -> SparkSession:
    """A session of its own, because state of this kind needs another store than the default."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


@query(
    "admit_stream",
    _admission_sql(TIGHT) + " SELECT request_id, CASE code WHEN 0 THEN NULL ELSE code = 1 END AS allowed FROM s WHERE k > 0",
)
def admit_stream_query(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream, closed by a mark behind the last one, so that every row is decided when the run ends."""
    out = work_folder(spark, "stream")
    own = _stateful(spark)
    events = W.table(own, sf, "events")
    W.as_requests(events).agg(F.max("ts").alias("ts")).select(
        (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts")
    ).write.parquet(f"{out}/closing")
    stream = W.as_requests(own.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*"))
    closing = closing_mark(own.readStream.schema("ts timestamp").parquet(f"{out}/closing"), stream)
    decided = admit_stream(stream.unionByName(closing), kind_col="kind", delay="1 minute", limits=TIGHT)
    started = (
        decided.writeStream.format("parquet").option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    started.awaitTermination()
    return spark.read.schema(decided.schema).parquet(f"{out}/rows").select(F.col("seq").alias("request_id"), "allowed")


@query("admit_disabled", f"WITH {W.REQUESTS_CTE} SELECT request_id, true AS allowed FROM requests")
def admit_disabled(spark: SparkSession, sf: str) -> DataFrame:
    out = A.admit_requests(W.requests(spark, sf), kind_col="kind", limits=RateLimits(enabled=False))
    return out.select("request_id", "allowed")


# ---------------------------------------------------------------- verdict and audit


_GUARD_SETTINGS = Settings(limits=SMALL, rates=TIGHT)
_FILES_SQL = (
    f"WITH {_CHECKED} SELECT doc_id, len(errors) = 0 AS is_valid, array_to_string(errors, '|') AS errors, array_to_string(warnings, '|') AS warnings FROM v"
)


def _guarded_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as the text and the answer of the event of its number, whose user all events limit; marked bytes come with it."""
    return W.documents(spark, sf).selectExpr(
        "doc_id AS request_id", f"{W.PLANTED} AS t", "source AS user_id", f"{W.ACTION} AS action",
        f"CAST({W.MARKED} AS BINARY) AS content", f"{W.FILENAME} AS filename", f"{W.MIME} AS mime_type",
        "timestamp_micros(1704067200000000 + doc_id * 3600000000) AS ts",
    )


def _screened(spark: SparkSession, sf: str) -> DataFrame:
    rows = _guarded_rows(spark, sf)
    return screen_requests(rows, "t", "t", _GUARD_SETTINGS, W.requests(spark, sf), content_col="content", kind_col="kind")


_GUARD_CTES = (
    f"{_admission_sql(TIGHT)}, adm AS (SELECT request_id AS doc_id, coalesce(code = 1 OR code = 0, true) AS allowed,"
    " CASE code WHEN 2 THEN 'Concurrent request limit (4) exceeded' WHEN 3 THEN 'Rate limit (3/min) exceeded'"
    " WHEN 5 THEN 'Token limit (12000/min) exceeded' END AS deny FROM s WHERE k > 0),"
    f" {W.PLANTED_CTE}, v AS (SELECT * FROM ({_verdict_sql(0.4, 0.2)})), o AS (SELECT * FROM ({_filter_sql('planted', 'doc_id', 't', W.PLANTED_CTE + ', ')})),"
    f" fv AS (SELECT * FROM ({_FILES_SQL})),"
    f" g AS (SELECT d.doc_id, d.source AS user_id, {W.ACTION.replace('doc_id', 'd.doc_id')} AS action, p.t, v.risk_score, v.is_safe,"
    " string_split(nullif(o.blocked_patterns, ''), '|') AS blocked, coalesce(adm.allowed, true) AS allowed, adm.deny, fv.is_valid AS file_ok,"
    " CASE WHEN fv.errors = '' THEN [] ELSE string_split(fv.errors, '|') END AS file_errors,"
    " CAST(CASE WHEN length(p.t) > 10000 THEN 1 ELSE 0 END + CASE WHEN v.warnings = '' THEN 0 ELSE len(string_split(v.warnings, '|')) END"
    " + o.n_warnings + CASE WHEN fv.warnings = '' THEN 0 ELSE len(string_split(fv.warnings, '|')) END AS INT) AS n_warnings,"
    " TIMESTAMP '2024-01-01' + to_hours(CAST(d.doc_id AS INT)) AS ts FROM documents d JOIN planted p USING (doc_id) JOIN v USING (doc_id) JOIN o USING (doc_id)"
    " JOIN fv USING (doc_id) LEFT JOIN adm USING (doc_id)),"
    " e AS (SELECT * REPLACE (coalesce(blocked, []) AS blocked), list_concat(list_concat(list_concat(file_errors, CASE WHEN is_safe THEN [] ELSE"
    " ['Prompt injection risk above the blocking threshold'] END), coalesce(blocked, [])), CASE WHEN allowed THEN [] ELSE [deny] END) AS errors FROM g),"
    " x AS (SELECT *, file_ok AND is_safe AND allowed AND len(blocked) = 0 AS passed FROM e)"
)


_GUARD_SQL = (
    f"{_GUARD_CTES} SELECT doc_id, passed, NOT allowed AS rate_limited, array_to_string(errors, '|') AS errors, n_warnings,"
    " CASE WHEN NOT allowed THEN deny WHEN NOT file_ok THEN 'Input validation failed' WHEN NOT is_safe THEN 'Prompt injection detected'"
    " WHEN len(blocked) > 0 THEN 'Output blocked' ELSE 'OK' END AS message, risk_score FROM x"
)


def _verdicts(guarded: DataFrame) -> DataFrame:
    return guarded.select(
        F.col("request_id").alias("doc_id"), F.size("all_warnings").alias("n_warnings"), "passed", "rate_limited", F.array_join("all_errors", "|").alias("errors"), "message",
        F.round("risk_score", 6).alias("risk_score"),
    )


@query("guard_requests", _GUARD_SQL)
def guard_requests(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(_screened(spark, sf))


@query("guard_stream", _GUARD_SQL)
def guard_stream_query(spark: SparkSession, sf: str) -> DataFrame:
    """The requests of ``guard_requests`` as they arrive, with all events as their traffic, each stream closed by a mark."""
    out = work_folder(spark, "guard")
    own = _stateful(spark)
    events = W.requests(own, sf)
    ends = events.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"))
    ends.write.parquet(f"{out}/closing")
    # A request comes at the time of its event; those without one before all others.
    times = events.select("request_id", "ts", "kind")
    arriving = _guarded_rows(own, sf).drop("ts").join(times, "request_id", "left")
    first = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    arriving.withColumns({"ts": F.coalesce("ts", first), "kind": F.lit("request")}).write.parquet(f"{out}/requests")
    requests = own.readStream.schema(own.read.parquet(f"{out}/requests").schema).parquet(f"{out}/requests")
    source = W.table(own, sf, "events")
    traffic = W.as_requests(own.readStream.schema(source.schema).parquet(f"{sf}/events.parquet*"))
    marks = own.readStream.schema("ts timestamp").parquet(f"{out}/closing")
    guarded = guard_stream(
        requests.unionByName(closing_mark(marks, requests)), "t", "t", _GUARD_SETTINGS, traffic.unionByName(closing_mark(marks, traffic)),
        kind_col="kind", content_col="content",
    )
    rows = _verdicts(guarded)
    started = (
        rows.writeStream.format("parquet").option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    started.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    return audit_screened(_screened(spark, sf), _GUARD_SETTINGS, input_col="t")


_AUDIT_COLUMNS = (
    "doc_id AS request_id, left(user_id, 2) || '***' AS user_id, action,"
    " md5(CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '...' ELSE t END) AS preview, passed,"
    " n_warnings AS warnings_count, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, len(errors) AS errors_count, risk_score, CASE WHEN NOT passed THEN array_to_string(errors, '|') END AS block_reasons,"
    " CASE WHEN passed THEN 'REQUEST' ELSE 'BLOCKED' END AS level, strftime(ts, '%Y-%m-%d') AS audit_date"
)


@query("audit_records", f"{_GUARD_CTES} SELECT {_AUDIT_COLUMNS} FROM x")
def audit_records(spark: SparkSession, sf: str) -> DataFrame:
    return _audited(spark, sf).select(
        "request_id", "user_id", "action", F.md5("input_preview").alias("preview"), "passed", "errors_count", "warnings_count",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.round("risk_score", 6).alias("risk_score"), F.array_join("block_reasons", "|").alias("block_reasons"), "level",
        F.col("audit_date").cast("string").alias("audit_date"),
    )


@query("audit_written", f"{_GUARD_CTES} SELECT doc_id AS request_id, passed, n_warnings AS warnings_count, strftime(ts, '%Y-%m-%d') AS day FROM x")
def audit_written(spark: SparkSession, sf: str) -> DataFrame:
    """Audit records written by day and read back."""
    path = work_folder(spark, "audit")
    AU.write_audit(_audited(spark, sf), path)
    back = spark.read.parquet(path)
    return back.select("request_id", "passed", "warnings_count", F.col("audit_date").cast("string").alias("day"))


_SUMMARY_SQL = (
    f"{_GUARD_CTES} SELECT strftime(ts, '%Y-%m-%d') AS audit_date, action, CASE WHEN passed THEN 'REQUEST' ELSE 'BLOCKED' END AS level,"
    " count(*) AS requests, CAST(sum(n_warnings) AS BIGINT) AS warnings, CAST(sum(len(errors)) AS BIGINT) AS errors, max(risk_score) AS max_risk FROM x GROUP BY ALL"
)


def _summary(days: DataFrame) -> DataFrame:
    return days.select(
        F.col("audit_date").cast("string").alias("audit_date"), "action", "level", "requests", "warnings", "errors",
        F.round("max_risk", 6).alias("max_risk"),
    )


@query("audit_summary", _SUMMARY_SQL)
def audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(V.audit_summary(_audited(spark, sf)))


def _arriving_audit(spark: SparkSession, sf: str, out: str):
    """The audit records in two halves: writes the next one, closed by a record far ahead, and gives the stream of all."""
    _audited(spark, sf).write.parquet(f"{out}/records")
    records = spark.read.parquet(f"{out}/records")
    middle = F.timestamp_micros(F.lit(int(records.agg(F.avg(F.unix_micros("ts"))).first()[0] or 0)))
    for late in (False, True):
        half = records.where(F.col("ts") >= middle if late else F.col("ts") < middle)
        if late:
            ends = half.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 9 DAYS")).alias("ts"))
            half = half.unionByName(ends, allowMissingColumns=True)
        half.write.mode("append").parquet(f"{out}/arriving")
        yield spark.readStream.schema(half.schema).parquet(f"{out}/arriving")


@query("audit_summary_stream", _SUMMARY_SQL)
def audit_summary_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The roll-up of a stream of records that is stopped after the first half and started again."""
    out = work_folder(spark, "summary")
    for stream in _arriving_audit(spark, sf, out):
        days = _summary(AU.summarize_stream(stream))
        writer = days.writeStream.format("parquet").option("path", f"{out}/days").option("checkpointLocation", f"{out}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(days.schema).parquet(f"{out}/days")


@query(
    "audit_sink",
    f"{_GUARD_CTES} SELECT doc_id AS request_id, passed, n_warnings AS warnings_count, strftime(ts, '%Y-%m-%d') AS day FROM x",
)
def audit_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Records as they arrive, through the sink that writes a batch once however often it is run."""
    out = work_folder(spark, "sink")
    for stream in _arriving_audit(spark, sf, out):
        AU.audit_sink(stream, f"{out}/audit", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    kept = AU.read_audit(spark, f"{out}/audit").where(F.col("request_id").isNotNull())
    return kept.select("request_id", "passed", "warnings_count", F.col("audit_date").cast("string").alias("day"))


@query(
    "audit_expired",
    "SELECT event_id, event_type, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day FROM events WHERE CAST(ts AS DATE) >= DATE '2024-04-10' - 90",
)
def audit_expired(spark: SparkSession, sf: str) -> DataFrame:
    """Events as an audit table on storage, whose expired days are dropped as folders."""
    path = work_folder(spark, "expired")
    AU.write_audit(W.table(spark, sf, "events").select("event_id", "event_type", F.to_date("ts").alias("audit_date")), path)
    AU.drop_expired_days(spark, path, datetime.date(2024, 4, 10))
    return AU.read_audit(spark, path).select("event_id", "event_type", F.col("audit_date").cast("string").alias("day"))


@query(
    "audit_switches",
    f"{_GUARD_CTES} SELECT doc_id AS request_id, user_id, NULL AS preview, NULL AS block_reasons, passed, len(errors) AS errors_count, n_warnings AS warnings_count FROM x",
)
def audit_switches(spark: SparkSession, sf: str) -> DataFrame:
    off = AuditOptions(log_inputs=False, log_blocked_requests=False, sensitive_field_masking=False)
    out = audit_screened(_screened(spark, sf), replace(_GUARD_SETTINGS, audit=off), input_col="t")
    return out.select(
        "request_id", "user_id", F.col("input_preview").alias("preview"), F.array_join("block_reasons", "|").alias("block_reasons"),
        "passed", "errors_count", "warnings_count",
    )


@query("mask_users", "SELECT doc_id, left(source, 2) || '***' AS masked, sha256(source) AS digest FROM documents")
def mask_users(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("source")
    return W.documents(spark, sf).select(
        "doc_id", V.mask_user(user).alias("masked"), V.mask_user(user, hashed=True).alias("digest")
    )


@query(
    "audit_retention",
    "SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) >= DATE '2024-04-10' - 90",
)
def audit_retention(spark: SparkSession, sf: str) -> DataFrame:
    log = W.table(spark, sf, "events").withColumn("audit_date", F.to_date("ts"))
    kept = AU.audit_retention(log, F.lit("2024-04-10").cast("date"))
    return kept.select("event_id", "event_type")


# ---------------------------------------------------------------- tasks and prompts

_TASK_FILLED = (
    f"{W.TASKS_CTE}, {W.LINKS_CTE}, n AS (SELECT task_id, count(*) AS n FROM links GROUP BY 1),"
    " f AS (SELECT t.* REPLACE (coalesce(session_id, substr(sha256(task_id || '|salt|session'), 1, 16)) AS session_id,"
    " coalesce(boundary_token, substr(sha256(task_id || '|salt|boundary'), 1, 32)) AS boundary_token), coalesce(n, 0) AS document_count,"
    " CASE WHEN n IS NULL THEN 'At least one document is required' END AS task_error FROM tasks t LEFT JOIN n USING (task_id))"
)


@query("task_identity", f"WITH {_TASK_FILLED} SELECT task_id, session_id, boundary_token, document_count, task_error FROM f")
def task_identity(spark: SparkSession, sf: str) -> DataFrame:
    out = TA.make_tasks(W.tasks(spark, sf), W.task_documents(spark, sf), "salt")
    return out.select("task_id", "session_id", "boundary_token", "document_count", "task_error")


def _prompt_sql(templates: dict[str, str]) -> str:
    """DuckDB expression of the prompt: the template cut at its placeholders."""
    from string import Formatter

    values = {
        "action": "action",
        "boundary_token": "coalesce(boundary_token, '')",
        "session_id": "coalesce(session_id, '')",
        "additional_context": "coalesce(additional_context, '')",
        "output_format": "coalesce(nullif(output_format, ''), 'markdown')",
    }

    def filled(template: str) -> str:
        parts = []
        for text, name, _, _ in Formatter().parse(template):
            parts += ([quoted(text)] if text else []) + ([values[name]] if name else [])
        return " || ".join(parts)

    default = filled("\nTask: {action}\n\n{additional_context}\n\nPlease provide the output in {output_format} format. \n")
    arms = " ".join(f"WHEN {quoted(a)} THEN {filled(t)}" for a, t in templates.items())
    base = f"CASE action {arms} ELSE {default} END" if arms else default
    return f"({base}) || CASE WHEN prompt <> '' THEN chr(10) || chr(10) || 'Additional instructions:  ' || prompt ELSE '' END"


def _rendered(name: str, templates: dict[str, str]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return TA.render_prompt(W.tasks(spark, sf), templates).select("task_id", "action", "full_prompt")

    query(name, f"WITH {W.TASKS_CTE} SELECT task_id, action, {_prompt_sql(templates)} AS full_prompt FROM tasks")(run)


_rendered("prompt_templates", TEMPLATES)
_rendered("prompt_default", {})


_SYSTEM_SQL = (
    f"replace(replace({quoted(SYSTEM_PROMPT)}, '{{session_id}}', coalesce(session_id, '')), '{{boundary_token}}', coalesce(boundary_token, ''))"
)


@query(
    "prompt_system",
    f"WITH {W.TASKS_CTE} SELECT task_id, {_SYSTEM_SQL} AS base, {_SYSTEM_SQL} || CASE WHEN action = 'ocr' THEN chr(10) || {quoted(RESTRICTED_PROMPT)} ELSE '' END"
    " AS restricted FROM tasks",
)
def prompt_system(spark: SparkSession, sf: str) -> DataFrame:
    sensitive = F.col("action") == "ocr"
    out = TA.system_prompt(TA.system_prompt(W.tasks(spark, sf)).withColumnRenamed("system_prompt", "base"), sensitive)
    return out.select("task_id", "base", F.col("system_prompt").alias("restricted"))


@query(
    "prompt_output_format",
    f"WITH {W.TASKS_CTE}, o AS (SELECT * FROM (VALUES {', '.join(str(tuple(f)) for f in D.OUTPUT_FORMATS)}) o(fmt, format_instruction, format_hint))"
    " SELECT task_id, format_instruction, format_hint FROM tasks LEFT JOIN o ON fmt = coalesce(nullif(output_format, ''), 'markdown')",
)
def prompt_output_format(spark: SparkSession, sf: str) -> DataFrame:
    return TA.with_output_format(W.tasks(spark, sf)).select("task_id", "format_instruction", "format_hint")


def _families(types: list[str] | None) -> str:
    return "NULL::VARCHAR[]" if types is None else "[" + ", ".join(quoted(t) for t in types) + "]"


_RULES_VALUES = ", ".join(
    f"({quoted(a)}, {t}, {_families(f)}, {str(c).lower()}, {lo or 'NULL'}::INT, {hi or 'NULL'}::INT)"
    for a, t, f, c, lo, hi, _ in D.ACTION_RULES
)
_FAMILY = (
    "CASE WHEN doc_type = 'application/pdf' THEN 'pdf' WHEN doc_type = 'text/csv' THEN 'csv' WHEN doc_type = 'application/json' THEN 'json'"
    " ELSE string_split(doc_type, '/')[1] END"
)


@query(
    "task_rules",
    f"WITH {W.TASKS_CTE}, {W.LINKS_CTE}, {_DOCS}, a AS (SELECT * FROM (VALUES {_RULES_VALUES}) a(action, max_t, fam, ctx, lo, hi)),"
    f" s AS (SELECT task_id, count(*) AS n, CAST(sum((n_chars + 3) // 4) AS BIGINT) AS tok, list_sort(list(DISTINCT {_FAMILY})) AS have"
    " FROM links JOIN d USING (doc_id) GROUP BY 1), j AS (SELECT t.*, coalesce(n, 0) AS n_documents, coalesce(tok, 0) AS input_tokens,"
    " list_filter(have, lambda x: NOT list_contains(fam, x)) AS odd, max_t, ctx, lo, hi FROM tasks t LEFT JOIN s USING (task_id) LEFT JOIN a USING (action))"
    " SELECT task_id, n_documents, input_tokens, array_to_string(list_filter(["
    "CASE WHEN n_documents = 0 THEN 'At least one document is required' END,"
    " CASE WHEN input_tokens > max_t THEN 'Input tokens (' || input_tokens || ') exceed limit (' || max_t || ')' END,"
    " CASE WHEN len(odd) > 0 THEN 'Document types not accepted: ' || array_to_string(odd, ', ') END,"
    " CASE WHEN ctx AND coalesce(additional_context, '') = '' THEN 'Additional context is required' END,"
    " CASE WHEN n_documents < lo THEN 'At least ' || lo || ' documents are required' END,"
    " CASE WHEN n_documents > hi THEN 'At most ' || hi || ' documents are allowed' END], lambda x: x IS NOT NULL), '|') AS errors FROM j",
)
def task_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = W.document_table(spark, sf).select("doc_id", "doc_type", F.ceil(F.col("n_chars") / 4).alias("tokens"))
    links = W.task_documents(spark, sf).join(docs, "doc_id")
    out = TA.validate_tasks(W.tasks(spark, sf), links)
    return out.select("task_id", "n_documents", "input_tokens", F.array_join("errors", "|").alias("errors"))


_PARAMS = (
    "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'warm' WHEN 1 THEN NULL ELSE CAST(value / 40 AS {s}) END AS temperature,"
    " CASE event_id % 4 WHEN 0 THEN '12.5' WHEN 1 THEN NULL ELSE CAST(event_id * 9 - 9 AS {s}) END AS max_output_tokens,"
    " CASE event_id % 5 WHEN 0 THEN 'JSON' WHEN 1 THEN NULL WHEN 2 THEN 'Xml' ELSE 'html' END AS output_format FROM {e}"
)


@query(
    "sanitize_parameters",
    f"WITH p AS ({_PARAMS.format(s='VARCHAR', e='events')}), c AS (SELECT *, TRY_CAST(temperature AS DOUBLE) AS temp,"
    " CASE WHEN regexp_full_match(max_output_tokens, '-?[0-9]+') THEN max_output_tokens::BIGINT END AS tok, lower(output_format) AS fmt FROM p)"
    " SELECT event_id, round(temp, 6) AS temperature_value, tok AS token_value, CASE WHEN fmt IN ('json', 'markdown', 'text', 'csv', 'html') THEN fmt WHEN fmt IS NOT NULL"
    " THEN 'text' END AS format_value, array_to_string(list_filter([CASE WHEN temperature IS NOT NULL AND coalesce(temp NOT BETWEEN 0 AND 2, true)"
    " THEN 'Temperature must be a number between 0 and 2' END, CASE WHEN max_output_tokens IS NOT NULL AND coalesce(tok NOT BETWEEN 1 AND 65536, true)"
    " THEN 'max_output_tokens must be between 1 and 65536' END], lambda x: x IS NOT NULL), '|') AS errors,"
    " CASE WHEN fmt NOT IN ('json', 'markdown', 'text', 'csv', 'html') THEN 'Unknown output format ''' || fmt || ''', using ''text''' ELSE '' END AS warnings FROM c",
)
def sanitize_parameters(spark: SparkSession, sf: str) -> DataFrame:
    events = W.table(spark, sf, "events")
    out = TA.sanitize_parameters(spark.sql(_PARAMS.format(s="STRING", e="{events}"), events=events))
    return out.select(
        "event_id", F.round("sanitized_temperature", 6).alias("temperature_value"),
        F.col("sanitized_max_output_tokens").alias("token_value"), F.col("sanitized_output_format").alias("format_value"),
        F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"),
    )


# ---------------------------------------------------------------- models

_TASK_ROWS = list(D.TASK_CONFIGS) + [(a, *dict((r[0], r[1:]) for r in D.TASK_CONFIGS)[n]) for a, n in D.TASK_ALIASES.items()]
_CONFIG_CTE = (
    f"c AS (SELECT * FROM (VALUES {', '.join(str(r) for r in _TASK_ROWS)}) c(action, m, t, k)), g AS (SELECT task_id, action,"
    " coalesce(m, 'gemini-2.5-flash') AS model, coalesce(t, 0.7)::DOUBLE AS temperature, coalesce(k, 8192) AS max_output_tokens,"
    " 0.95::DOUBLE AS top_p, 40 AS top_k FROM tasks LEFT JOIN c USING (action))"
)


@query("model_config", f"WITH {W.TASKS_CTE}, {_CONFIG_CTE} SELECT task_id, model, temperature, max_output_tokens, top_p, top_k FROM g")
def model_config(spark: SparkSession, sf: str) -> DataFrame:
    out = MO.model_config_for_task(W.tasks(spark, sf), "action")
    return out.select("task_id", "model", "temperature", "max_output_tokens", "top_p", "top_k")


_PRESET = "CASE doc_id % 4 WHEN 0 THEN 'conservative' WHEN 1 THEN 'creative' WHEN 2 THEN 'balanced' ELSE 'none' END"


@query(
    "model_presets",
    f"WITH p AS (SELECT doc_id, {_PRESET} AS preset FROM documents) SELECT doc_id, preset, CASE WHEN preset <> 'none' THEN 'gemini-pro' END AS model,"
    " CASE preset WHEN 'conservative' THEN 0.2 WHEN 'creative' THEN 1.2 WHEN 'balanced' THEN 0.7 END::DOUBLE AS temperature,"
    " CASE preset WHEN 'conservative' THEN 4096 WHEN 'creative' THEN 8192 WHEN 'balanced' THEN 8192 END AS max_output_tokens FROM p",
)
def model_presets(spark: SparkSession, sf: str) -> DataFrame:
    out = MO.config_from_preset(W.documents(spark, sf).selectExpr("doc_id", f"{_PRESET} AS preset"))
    other = out.withColumn("model", F.when(F.col("model").isNotNull(), F.lit("gemini-pro")))
    return other.select("doc_id", "preset", "model", "temperature", "max_output_tokens")


_SETTINGS = (
    "SELECT event_id, value / 40 AS temperature, CAST(event_id % 3 AS INT) AS max_output_tokens,"
    " value / 80 - 0.05 AS top_p, CAST(event_id % 5 AS INT) AS top_k FROM {e}"
)


@query(
    "model_config_errors",
    f"WITH s AS ({_SETTINGS.format(e='events').replace('0.05', '0.05::DOUBLE')}) SELECT event_id, array_to_string(list_filter(["
    "CASE WHEN temperature NOT BETWEEN 0 AND 2 THEN 'Temperature must be between 0.0 and 2.0' END,"
    " CASE WHEN max_output_tokens < 1 THEN 'max_output_tokens must be at least 1' END,"
    " CASE WHEN top_p NOT BETWEEN 0 AND 1 THEN 'top_p must be between 0.0 and 1.0' END,"
    " CASE WHEN top_k < 1 THEN 'top_k must be at least 1' END], lambda x: x IS NOT NULL), '|') AS errors FROM s",
)
def model_config_errors(spark: SparkSession, sf: str) -> DataFrame:
    settings = spark.sql(_SETTINGS.format(e="{events}").replace("0.05", "0.05D"), events=W.table(spark, sf, "events"))
    return MO.config_errors(settings).select("event_id", F.array_join("config_errors", "|").alias("errors"))


@query(
    "model_generation_json",
    f"WITH {W.TASKS_CTE}, {_CONFIG_CTE} SELECT task_id, '{{\"temperature\":' || temperature || ',\"max_output_tokens\":' || max_output_tokens ||"
    " ',\"top_p\":0.95,\"top_k\":40' || CASE WHEN action = 'ocr' THEN ',\"stop_sequences\":[\"END\"]' ELSE '' END || '}' AS config FROM g",
)
def model_generation_json(spark: SparkSession, sf: str) -> DataFrame:
    stops = F.when(F.col("action") == "ocr", F.array(F.lit("END")))
    out = MO.model_config_for_task(W.tasks(spark, sf), "action")
    return out.select("task_id", MO.generation_config(stops).alias("config"))


_NAMES = [m[0] for m in D.MODELS] + ["gemini-unknown"]
_NAME = "CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END"


def _in(names) -> str:
    return "(" + ", ".join(quoted(n) for n in names) + ")"


@query(
    "model_lookup",
    f"WITH m AS (SELECT doc_id, {_NAME} AS name FROM documents) SELECT doc_id, CASE WHEN name <> 'gemini-unknown' THEN name END AS model,"
    f" name IN {_in(m[0] for m in D.MODELS if m[1] == 'flash')} AS is_flash, name IN {_in(m[0] for m in D.MODELS if m[1] == 'pro')} AS is_pro,"
    " name IN ('gemini-2.5-flash', 'gemini-2.5-pro') AS is_latest_of_tier FROM m",
)
def model_lookup(spark: SparkSession, sf: str) -> DataFrame:
    named = W.documents(spark, sf).selectExpr("doc_id", f"{_NAME} AS model_name")
    return MO.lookup_models(named).select("doc_id", "model", "is_flash", "is_pro", "is_latest_of_tier")


def _capabilities(source: str, rows) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        named = W.documents(spark, sf).selectExpr("doc_id", f"{_NAME} AS model")
        out = MO.with_capabilities(named, source=source)
        return out.select("doc_id", "context_window", "output_token_limit", "supports_vision", "cost_tier")

    query(
        f"model_capabilities_{source}",
        f"WITH m AS (SELECT doc_id, {_NAME} AS name FROM documents), c AS (SELECT * FROM (VALUES {', '.join(map(str, rows))}) c(name, w, k, cost))"
        " SELECT doc_id, coalesce(w, 1000000) AS context_window, coalesce(k, 8192) AS output_token_limit, true AS supports_vision,"
        " coalesce(cost, 'medium') AS cost_tier FROM m LEFT JOIN c USING (name)",
    )(run)


_capabilities("code", D.CAPABILITIES_CODE)
_capabilities("config", D.CAPABILITIES_CONFIG)

# ---------------------------------------------------------------- assembling and running


@query(
    "task_parts",
    f"WITH {W.LINKS_CTE}, {_DOCS} SELECT task_id, doc_index, doc_id, CASE WHEN content IS NOT NULL THEN 'bytes' WHEN uri IS NOT NULL THEN 'url' WHEN text IS NOT NULL"
    " THEN 'text' END AS part_kind, doc_type AS mime, length(text) AS n_chars, strlen(content) AS n_bytes, CASE WHEN content IS NOT NULL THEN 'bytes' ELSE uri END AS uri"
    " FROM links LEFT JOIN d USING (doc_id)",
)
def task_parts(spark: SparkSession, sf: str) -> DataFrame:
    out = TA.task_parts(W.task_documents(spark, sf), W.document_table(spark, sf))
    return out.select(
        "task_id", "doc_index", "doc_id", "part_kind", "mime", F.length("text").alias("n_chars"), F.octet_length("content").alias("n_bytes"), "uri"
    )


_ASSEMBLED = (
    f"{W.TASKS_CTE}, {W.LINKS_CTE}, {_DOCS}, a AS (SELECT l.task_id, count(*) AS n, count(*) FILTER (d.doc_id IS NULL) AS gone,"
    " string_agg(d.doc_id || CASE WHEN d.content IS NOT NULL THEN 'b' || strlen(d.content) WHEN d.uri IS NOT NULL THEN 'u' ELSE 't' || length(d.text) END, ',' ORDER BY doc_index) AS ids"
    " FROM links l LEFT JOIN d USING (doc_id) GROUP BY 1),"
    " b AS (SELECT t.*, coalesce(n, 0) AS n_documents, ids, CASE WHEN n IS NULL THEN 'At least one document is required'"
    " WHEN gone > 0 THEN 'Documents not found: ' || gone END AS task_error FROM tasks t LEFT JOIN a USING (task_id))"
)


@query("task_assembly", f"WITH {_ASSEMBLED} SELECT task_id, n_documents, task_error FROM b")
def task_assembly(spark: SparkSession, sf: str) -> DataFrame:
    out = TA.assemble_tasks(W.tasks(spark, sf), W.task_documents(spark, sf), W.document_table(spark, sf))
    return out.select("task_id", "n_documents", "task_error")


def _measure():
    """A stand-in for a model: tells what it got, in order, leaks now and then, and fails on translations."""

    def generate(task: dict):
        if "Task: translate" in task["prompt"] or "Task:  translate" in task["prompt"]:
            raise RuntimeError("model refused")
        seen = []
        for p in task["parts"]:
            size = {"bytes": f"b{len(p['content'] or b'')}", "url": "u", "text": f"t{len(p['text'] or '')}"}[p["part_kind"]]
            seen.append(f"{p['doc_id']}{size}")
        return f"{','.join(seen)}; prompt of {len(task['prompt'])}", 5

    return generate


def _leaking():
    """Its answers hold personal data, and for compact prompts a leaked credential."""
    inner = _measure()

    def generate(task: dict):
        said, used = inner(task)
        return said + " 123-45-6789" + (" password: hunter22" if len(task["prompt"]) % 2 else ""), used

    return generate


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    return store_contents(W.document_table(spark, sf), work_folder(spark, "contents"))


def _ready(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    tasks = W.tasks(spark, sf).withColumn("model", F.lit("gemini-pro"))
    links, docs = W.task_documents(spark, sf), _stored(spark, sf)
    return TA.render_prompt(TA.assemble_tasks(tasks, links, docs), None), TA.task_parts(links, docs)


_RAN = (
    f"{_ASSEMBLED}, r AS (SELECT *, {_prompt_sql({})} AS full_prompt FROM b), o AS (SELECT task_id, action, session_id, n_documents,"
    " task_error IS NULL AND action <> 'translate' AS success, CASE WHEN task_error IS NULL AND action <> 'translate' THEN"
    " ids || '; prompt of ' || length(full_prompt) END AS content, coalesce(task_error, CASE WHEN action = 'translate'"
    " THEN 'model refused' END) AS error FROM r)"
)


@query(
    "run_tasks",
    f"WITH {_RAN} SELECT task_id, success, content, 'gemini-pro' AS model_used, CASE WHEN success THEN 5 END AS tokens_used, error, action,"
    " CASE WHEN success THEN n_documents END AS document_count FROM o",
)
def run_tasks(spark: SparkSession, sf: str) -> DataFrame:
    ready, parts = _ready(spark, sf)
    out = RU.run_batch(ready, _measure, {}, "unregistered", parts)
    return out.select(
        "task_id", "success", "content", "model_used", "tokens_used", "error",
        F.col("metadata.action").alias("action"), F.col("metadata.document_count").alias("document_count"),
    )


def _measure_all():
    """The same for a list of requests; refusals stand among the answers."""
    one = _measure()

    def generate(requests: list[dict]) -> list:
        answers = []
        for r in requests:
            try:
                answers.append(one(r))
            except RuntimeError as refusal:
                answers.append(refusal)
        return answers

    return generate


@query(
    "run_batched",
    f"WITH {_RAN} SELECT hook, task_id, success, content, CASE WHEN success THEN 5 END AS tokens_used, error"
    " FROM o, (SELECT unnest(['lists', 'threads']) AS hook)",
)
def run_batched(spark: SparkSession, sf: str) -> DataFrame:
    """Eight calls in flight: as lists of requests, and side by side in threads."""
    ready, parts = _ready(spark, sf)
    columns = ("task_id", "success", "content", "tokens_used", "error")
    lists = RU.run_tasks(ready, RU.Batched(_measure_all), parts, window=8).select(F.lit("lists").alias("hook"), *columns)
    return lists.unionByName(RU.run_tasks(ready, _measure, parts, window=8).select(F.lit("threads").alias("hook"), *columns))


def _half():
    """A model that answers every other task."""
    inner = _measure()

    def generate(task: dict):
        if len(task["prompt"]) % 2:
            raise RuntimeError("model is down")
        return inner(task)

    return generate


@query(
    "run_resumed",
    f"WITH {_RAN} SELECT task_id, success, content, error, CASE WHEN success AND length(full_prompt) % 2 = 0 THEN 1 ELSE 2 END AS n_asked FROM o JOIN r USING (task_id)",
)
def run_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """A model that is down for half of the tasks, then a run that asks for the rest only."""
    ready, parts = _ready(spark, sf)
    folder = work_folder(spark, "answers")
    RU.run_saved(ready, _half, folder, parts)
    out = RU.run_saved(ready, _measure, folder, parts)
    asked = RU.saved_answers(ready, folder).groupBy("task_id").agg(F.count(F.lit(1)).alias("n_asked"))
    return out.join(asked, "task_id").select("task_id", "success", "content", "error", "n_asked")


def _step_length(i: int, previous: str) -> str:
    name, instruction = STEPS[i]
    fixed = len(STEP_PROMPT.format(step=name, instruction=instruction, action="", additional_context="", previous="", output_format=""))
    return f"({fixed} + length(action) + length(coalesce(additional_context, '')) + length({previous}) + length(coalesce(nullif(output_format, ''), 'markdown')))"


@query(
    "run_multistep",
    f"WITH {_ASSEMBLED}, s1 AS (SELECT *, ids || '; prompt of ' || {_step_length(0, quoted('None'))} AS r1 FROM b),"
    f" s2 AS (SELECT *, ids || '; prompt of ' || {_step_length(1, 'r1')} AS r2 FROM s1),"
    f" s3 AS (SELECT *, ids || '; prompt of ' || {_step_length(2, 'r2')} AS r3 FROM s2)"
    " SELECT task_id, task_error IS NULL AND action <> 'translate' AS success, CASE WHEN task_error IS NULL AND action <> 'translate' THEN r3 END AS content,"
    " CASE WHEN task_error IS NOT NULL THEN NULL WHEN action = 'translate' THEN 1 ELSE 3 END AS n_steps,"
    f" CASE WHEN task_error IS NOT NULL THEN NULL WHEN action = 'translate' THEN {quoted(STEPS[0][0] + '=model refused')}"
    f" ELSE {quoted(STEPS[0][0] + '=')} || r1 || {quoted('|' + STEPS[1][0] + '=')} || r2 || {quoted('|' + STEPS[2][0] + '=')} || r3 END AS steps FROM s3",
)
def run_multistep(spark: SparkSession, sf: str) -> DataFrame:
    out = RU.run_multistep(*_with_parts(spark, sf))
    steps = F.col("metadata.steps")
    said = F.array_join(F.transform(steps, lambda s: F.concat(s["step"], F.lit("="), F.coalesce(s["result"], s["error"]))), "|")
    return out.select("task_id", "success", "content", F.when(steps.isNotNull(), F.size(steps)).alias("n_steps"), said.alias("steps"))


def _with_parts(spark: SparkSession, sf: str) -> tuple:
    ready, parts = _ready(spark, sf)
    return ready, _measure, parts


@query(
    "result_json",
    f"WITH {_RAN} SELECT task_id, '{{\"success\":' || success || ',\"content\":' || coalesce('\"' || content || '\"', 'null') ||"
    " ',\"model_used\":\"gemini-pro\",\"tokens_used\":' || CASE WHEN success THEN '5' ELSE 'null' END || ',\"error\":' ||"
    " coalesce('\"' || error || '\"', 'null') || ',\"metadata\":{\"action\":\"' || action || '\",\"session_id\":' ||"
    " CASE WHEN success AND session_id IS NOT NULL THEN '\"' || session_id || '\"' ELSE 'null' END || ',\"document_count\":' ||"
    " CASE WHEN success THEN n_documents::VARCHAR ELSE 'null' END || ',\"steps\":null,\"multi_step\":null}}' AS result FROM o",
)
def result_json(spark: SparkSession, sf: str) -> DataFrame:
    return RU.run_tasks(*_with_parts(spark, sf)).select("task_id", RU.result_json().alias("result"))


@query(
    "process_tasks",
    f"WITH {_RAN}, y AS (SELECT o.*, length(full_prompt) % 2 = 1 AS leaks FROM o JOIN r USING (task_id))"
    " SELECT task_id, success, CASE WHEN success AND leaks THEN '[OUTPUT BLOCKED:  Security policy violation detected]'"
    " ELSE content || ' [SSN REDACTED]' END AS content, error, NOT (success AND leaks) AS output_is_safe, success AS output_was_modified FROM y",
)
def process_all_tasks(spark: SparkSession, sf: str) -> DataFrame:
    tasks = W.tasks(spark, sf).withColumn("model", F.lit("gemini-pro"))
    out = process_tasks(tasks, W.task_documents(spark, sf), _stored(spark, sf), _leaking, "salt")
    return out.select("task_id", "success", "content", "error", "output_is_safe", "output_was_modified")
