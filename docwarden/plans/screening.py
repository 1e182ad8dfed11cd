"""End-to-end paths: screen inputs, filter outputs, run tasks.

Each is one chain of narrow operators over a row that carries its text once; a shuffle occurs only where
tasks meet their documents and where a user's requests are decided in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.admission import admit_requests
from ..operators.detect import detect_injection
from ..operators.documents import validate_documents
from ..operators.outfilter import filter_output
from ..operators.run import GenerateFactory, run_tasks
from ..operators.sanitize import sanitize_text
from ..operators.tasks import assemble_tasks, make_tasks, render_prompt, task_parts
from ..operators.verdict import audit_records, guard_requests
from ..rules import Settings


def screen_inputs(df: DataFrame, text_col: str, settings: Settings = Settings(), low_col: str | None = None) -> DataFrame:
    """Sanitize and check incoming texts. The check sees the original text, because escaping would hide
    tags from it; what goes on is ``input_sanitized_value``."""
    clean = sanitize_text(df, text_col, limits=settings.limits, prefix="input_")
    return detect_injection(
        clean, text_col, settings.rules, settings.sensitivity, settings.detect_enabled, prefix="injection_", low_col=low_col
    )


def screen_texts(df: DataFrame, text_col: str, output_col: str | None, settings: Settings, content_col: str | None = None) -> DataFrame:
    """What the rows of requests tell by themselves: input, injection, file and output checks. Works on streams as well."""
    # Files are checked first: Spark evaluates Python functions of a row together and for that writes whatever stands between
    # them into each place that names it, and the detector's findings are named often.
    if content_col:
        names = {f"{c}_col": c if c in df.columns else None for c in ("filename", "mime")}
        names["mime_col"] = "mime_type" if "mime_type" in df.columns else None
        df = validate_documents(df, content_col, **names, limits=settings.limits, prefix="__file_")
    low = "__lowered" if output_col == text_col else None
    if low:
        df = df.withColumn(low, F.lower(F.col(text_col)))
    screened = screen_inputs(df, text_col, settings, low)
    if content_col:
        found = {f"file_{c}": F.col(f"__file_{c}") for c in ("resolved_mime", "errors", "warnings", "is_valid")}
        screened = screened.withColumns(found).drop(*(f"__{c}" for c in found))
    if output_col:
        screened = filter_output(
            screened, output_col, rules=settings.rules, enabled=settings.filter_enabled, prefix="output_", low_col=low
        )
    return screened.drop("__lowered")


def screen_requests(
    df: DataFrame,
    text_col: str,
    output_col: str | None = None,
    settings: Settings = Settings(),
    traffic: DataFrame | None = None,
    request_col: str = "request_id",
    content_col: str | None = None,
    **traffic_columns: str,
) -> DataFrame:
    """Screen requests, and their answers if there are any, and give the combined verdict.

    ``traffic`` holds all requests and releases of the users (columns as ``admit_requests`` takes them, named otherwise by
    ``traffic_columns``); its decisions under ``settings.rates`` are joined by ``request_col``. ``content_col`` names the bytes
    of a file that comes with the request and is validated too.
    """
    screened = screen_texts(df, text_col, output_col, settings, content_col)
    if traffic is not None:
        decided = admit_requests(traffic, seq_col=request_col, limits=settings.rates, **traffic_columns)
        decided = decided.select(request_col, "allowed", F.col("message").alias("deny_message"))
        screened = screened.drop("allowed", "deny_message").join(decided, request_col, "left")
    return guard_requests(screened)


def audit_screened(df: DataFrame, settings: Settings = Settings(), **columns: str) -> DataFrame:
    """Audit records of screened requests, as ``settings.audit`` says."""
    return audit_records(df, options=settings.audit, **columns)


def process_tasks(
    tasks: DataFrame,
    task_documents: DataFrame,
    documents: DataFrame,
    factory: GenerateFactory,
    salt: str,
    settings: Settings = Settings(),
) -> DataFrame:
    """Tasks with their documents through the model function and the output filter. One row per task:
    the result and ``output_*`` columns; ``content`` is only the filtered text."""
    ready = make_tasks(assemble_tasks(tasks, task_documents, documents), None, salt)
    results = run_tasks(render_prompt(ready, None), factory, task_parts(task_documents, documents))
    safe = filter_output(
        results, "content", rules=settings.rules, enabled=settings.filter_enabled, prefix="output_"
    )
    return safe.withColumn("content", F.col("output_filtered_output"))
