"""Combined verdicts and audit records.

The combining engine and the masking rule have no definition to follow; the rules here are ours:
``passed`` = input valid, injection check safe, not rate limited, and no unsafe output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import AuditOptions

PREVIEW_CHARS = 200


def _strings(df: DataFrame, name: str) -> Column:
    none = F.array().cast("array<string>")
    return F.coalesce(F.col(name), none) if name in df.columns else none


def guard_requests(df: DataFrame) -> DataFrame:
    """Add ``passed``, ``rate_limited``, ``message``, ``all_warnings`` and ``all_errors``.

    Reads whichever component columns are there: ``input_is_valid/_errors/_warnings`` (sanitizer), the same of ``file_``
    (file validation),
    ``injection_is_safe/_risk_score/_warnings`` (detector), ``output_is_safe/_blocked_patterns/_warnings``
    (filter), ``allowed`` and ``deny_message`` (admission; null means not limited). All of them sit in
    the request's own row, so this adds no shuffle; decisions made elsewhere are joined on the request
    key beforehand. Warnings and errors are listed in the order input, file, injection, output.
    """

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(True)) if name in df.columns else F.lit(True)

    valid, safe = flag("input_is_valid"), flag("injection_is_safe")
    valid = valid & flag("file_is_valid")
    clean, allowed = flag("output_is_safe"), flag("allowed")
    deny = F.col("deny_message") if "deny_message" in df.columns else F.lit(None).cast("string")
    score = (
        F.col("injection_risk_score") if "injection_risk_score" in df.columns else F.lit(None)
    ).cast("double")
    injection_error = F.when(
        ~safe, F.array(F.lit("Prompt injection risk above the blocking threshold"))
    ).otherwise(F.array().cast("array<string>"))
    limit_error = F.when(
        ~allowed, F.array(F.coalesce(deny, F.lit("Rate limit exceeded")))
    ).otherwise(F.array().cast("array<string>"))
    message = (
        F.when(~allowed, F.coalesce(deny, F.lit("Rate limit exceeded")))
        .when(~valid, F.lit("Input validation failed"))
        .when(~safe, F.lit("Prompt injection detected"))
        .when(~clean, F.lit("Output blocked"))
        .otherwise(F.lit("OK"))
    )
    return df.withColumns(
        {
            "passed": valid & safe & allowed & clean,
            "rate_limited": ~allowed,
            "message": message,
            "risk_score": score,
            "all_warnings": F.concat(
                _strings(df, "input_warnings"),
                _strings(df, "file_warnings"),
                _strings(df, "injection_warnings"),
                _strings(df, "output_warnings"),
            ),
            "all_errors": F.concat(
                _strings(df, "input_errors"),
                _strings(df, "file_errors"),
                injection_error,
                _strings(df, "output_blocked_patterns"),
                limit_error,
            ),
        }
    )


def mask_user(user: Column, hashed: bool = False) -> Column:
    """First two characters and ``***``; or a SHA-256 digest. Null stays null."""
    text = user.cast("string")
    return F.sha2(text, 256) if hashed else F.concat(F.left(text, F.lit(2)), F.lit("***"))


def audit_records(
    df: DataFrame,
    request_col: str = "request_id",
    user_col: str = "user_id",
    action_col: str = "action",
    ts_col: str = "ts",
    input_col: str | None = "text",
    options: AuditOptions = AuditOptions(),
) -> DataFrame:
    """One record per request that was guarded (columns of ``guard_requests``; null ``passed`` means the
    request has no result yet). Nothing is recorded when auditing is switched off."""
    user = F.col(user_col)
    has_result = F.col("passed").isNotNull()
    denied = has_result & ~F.col("passed")
    none = F.lit(None).cast("string")
    preview = none
    if input_col and options.log_inputs:
        text = F.col(input_col)
        cut = F.concat(F.substring(text, 1, PREVIEW_CHARS), F.lit("..."))
        preview = F.when(
            F.length(text) > 0, F.when(F.length(text) > PREVIEW_CHARS, cut).otherwise(text)
        )
    reasons = F.lit(None).cast("array<string>")
    if options.log_blocked_requests:
        reasons = F.when(denied, F.col("all_errors"))
    elapsed = F.col("processing_time_ms") if "processing_time_ms" in df.columns else F.lit(0.0)
    records = df.select(
        F.col(request_col).alias("request_id"),
        (mask_user(user) if options.sensitive_field_masking else user.cast("string")).alias(
            "user_id"
        ),
        F.col(action_col).alias("action"),
        F.col(ts_col).cast("timestamp").alias("ts"),
        preview.alias("input_preview"),
        F.col("passed"),
        F.when(has_result, F.size("all_warnings")).alias("warnings_count"),
        F.when(has_result, F.size("all_errors")).alias("errors_count"),
        F.when(has_result, elapsed).cast("double").alias("processing_time_ms"),
        F.when(has_result, F.col("risk_score")).alias("risk_score"),
        reasons.alias("block_reasons"),
        F.when(denied, F.lit("BLOCKED")).otherwise(F.lit("REQUEST")).alias("level"),
        F.to_date(F.col(ts_col)).alias("audit_date"),
    )
    return records if options.enabled else records.where(F.lit(False))


def audit_summary(audit: DataFrame) -> DataFrame:
    """Requests, warnings, errors and highest risk by day, action and level; combined on the map side."""
    return audit.groupBy("audit_date", "action", "level").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("warnings_count").alias("warnings"),
        F.sum("errors_count").alias("errors"),
        F.max("risk_score").alias("max_risk"),
    )
