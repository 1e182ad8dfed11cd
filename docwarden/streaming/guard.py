"""The guard over requests that arrive: screening, rate limits and the combined verdict on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.verdict import guard_requests
from ..plans.screening import screen_texts
from ..rules import Settings
from .admission import CLOSING, admit_stream


def guard_stream(
    requests: DataFrame,
    text_col: str,
    output_col: str | None = None,
    settings: Settings = Settings(),
    traffic: DataFrame | None = None,
    request_col: str = "request_id",
    ts_col: str = "ts",
    kind_col: str | None = None,
    content_col: str | None = None,
    delay: str = "1 minute",
    **traffic_columns: str,
) -> DataFrame:
    """What ``screen_requests`` gives, for a stream of requests: each with its verdict, once.

    ``traffic`` is the stream of all requests and releases of the users, which holds each request under the same id and
    time; without it the requests are their own traffic, and releases (``kind_col``) among them only open the way for
    others. Decisions come out when the watermark has passed them, and a request is joined with its own by id and time, so the
    state of the join goes with the watermark as well. A request without a decision (no traffic, no user) is not limited; one without a time cannot
    be put in order, and comes out at once, not limited. Ids are integral and unique. A closing mark (``closing_mark``) must be in both streams.
    """
    kind = F.coalesce(F.col(kind_col), F.lit("request")) if kind_col else F.lit("request")
    timed = requests.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, delay)
    asked = ~kind.isin("release", CLOSING)
    # One expression over the time, which Spark leaves above the watermark: the rows it drops must move that too.
    due = screen_texts(timed.where(F.when(F.col(ts_col).isNull(), F.lit(False)).otherwise(asked)), text_col, output_col, settings, content_col)
    none = {"allowed": F.lit(None).cast("boolean"), "deny_message": F.lit(None).cast("string")}
    untimed = screen_texts(requests.where(asked & F.col(ts_col).isNull()), text_col, output_col, settings, content_col).withColumns(none)
    if not settings.rates.enabled:
        return guard_requests(due.withColumns(none).unionByName(untimed))
    decided = admit_stream(
        requests if traffic is None else traffic, ts_col=ts_col, seq_col=request_col, kind_col=kind_col, delay=delay, limits=settings.rates, **traffic_columns
    )
    decided = decided.select(F.col("seq").alias("__seq"), F.col("ts").alias("__at"), "allowed", F.col("message").alias("deny_message"))
    due = due.drop("allowed", "deny_message")
    same = (F.col(request_col).cast("bigint") == F.col("__seq")) & (F.col(ts_col) == F.col("__at"))
    return guard_requests(due.join(decided, same, "left").drop("__seq", "__at").unionByName(untimed))
