"""Rate limiting: which requests a per-user sliding window admits, and the load offered to it.

Only admitted requests count against the limits, so each decision depends on the user's decisions before it.
``admit_requests`` shuffles once, by user, and streams the rows of a partition in order of time with the log of one user in
memory, whose size is bounded by the limits. A user's rows are decided by one task, one after the other: that much
is sequential by definition. Such a task holds no more than the others, and rows in which a user stands at a limit are
denied together, so a flooding user costs little more than the reading of their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.admission import ADMITTED, RELEASED, WINDOW_US, UserLog, messages
from ..rules import RateLimits


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def offered_load(
    df: DataFrame,
    user_col: str = "user_id",
    ts_col: str = "ts",
    tokens_col: str = "tokens",
    slice_seconds: int = 300,
) -> DataFrame:
    """Add ``requests_last_minute`` and ``tokens_last_minute``: what the user asked for in the 60 seconds
    up to and including the row, admitted or not.

    A request enters the load at its time and leaves it 60 seconds later, so the load is a running sum
    over entries and departures: linear in the rows, where a sliding frame costs a pass over the last
    minute for each row. The sum runs per user and time slice, which spreads a hot user over slices;
    entries of the last minute of a slice are repeated in the next one.
    """
    width = slice_seconds * 1_000_000
    if width < WINDOW_US:
        raise ValueError("slice_seconds must be at least 60")
    tokens = F.coalesce(F.col(tokens_col), F.lit(0)).cast("bigint")
    row = F.struct(*df.columns)

    def change(part: Column, at: Column, sign: int, carried: Column) -> Column:
        return F.struct(
            part.alias("part"),
            at.alias("at"),
            F.lit(sign).alias("n"),
            (tokens * sign).alias("tokens"),
            carried.alias("row"),
        )

    at = F.col("__at")
    home, leaves = F.floor(at / width), at + WINDOW_US
    nothing = F.lit(None).cast(df.select(row.alias("row")).schema["row"].dataType)
    here = change(home, at, 1, row)
    within = F.array(here, change(home, leaves, -1, nothing))
    beyond = F.array(here, change(home + 1, at, 1, nothing), change(home + 1, leaves, -1, nothing))
    changes = (
        df.withColumn("__at", micros(F.col(ts_col)))
        .select(
            F.col(user_col).alias("__user"),
            F.explode(F.when(leaves < (home + 1) * width, within).otherwise(beyond)).alias("c"),
        )
        .select("__user", "c.*")
    )
    so_far = (
        Window.partitionBy("__user", "part")
        .orderBy("at")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = changes.withColumns(
        {
            "requests_last_minute": F.sum("n").over(so_far),
            "tokens_last_minute": F.sum("tokens").over(so_far),
        }
    )
    return summed.where(F.col("row").isNotNull()).select(
        "row.*", "requests_last_minute", "tokens_last_minute"
    )


def _simulate(limits: RateLimits):
    """Decisions over rows sorted by user and time. Rows without a user get none."""
    said = messages(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user = log = None
        for batch in batches:
            users, ts, turns, tokens = (batch[c].to_pylist() for c in ("user", "ts_us", "turn", "tokens"))
            codes: list[int | None] = []
            i, n = 0, len(users)
            while i < n:
                j = i + 1
                while j < n and users[j] == users[i]:
                    j += 1
                if users[i] is None:
                    codes += [None] * (j - i)
                else:
                    if users[i] != user:
                        user, log = users[i], UserLog(limits)
                    codes += log.decide(ts[i:j], [t == 0 for t in turns[i:j]], tokens[i:j])
                i = j
            yield pa.record_batch(
                {
                    "user": batch["user"],
                    "seq": batch["seq"],
                    "allowed": pa.array([None if c is None or c == RELEASED else c == ADMITTED for c in codes], pa.bool_()),
                    "message": pa.array([said.get(c) for c in codes], pa.string()),
                }
            )

    return run


def admit_requests(
    df: DataFrame,
    user_col: str = "user_id",
    ts_col: str = "ts",
    tokens_col: str = "tokens",
    kind_col: str | None = None,
    seq_col: str = "request_id",
    limits: RateLimits = RateLimits(),
) -> DataFrame:
    """One row per input row: user, ``seq_col``, ``allowed`` and the ``message`` of a denial.

    A request is denied when the user has too many open requests, too many admitted in the last minute
    (hour, if a limit is given), or too many tokens with this request's estimate, tested in this order.
    Rows of kind ``release`` close an open request and get null as their decision, and so do rows without a
    user, to whom no limit belongs. At equal times releases come first, then rows by ``seq_col``, which must be unique.
    """
    if not limits.enabled:
        return df.select(
            user_col,
            seq_col,
            F.lit(True).alias("allowed"),
            F.lit(None).cast("string").alias("message"),
        )
    kind = F.col(kind_col) if kind_col else F.lit("request")
    rows = df.select(
        F.col(user_col).alias("user"),
        micros(F.col(ts_col)).alias("ts_us"),
        F.when(kind == "release", 0).otherwise(1).alias("turn"),
        F.col(seq_col).alias("seq"),
        F.coalesce(F.col(tokens_col).cast("bigint"), F.lit(0)).alias("tokens"),
    )
    # Rows without a user need not meet, so they are spread.
    home = F.when(F.col("user").isNull(), F.xxhash64("seq")).otherwise(F.xxhash64("user"))
    ordered = rows.repartition(home).sortWithinPartitions("user", "ts_us", "turn", "seq")
    user_type, seq_type = (dict(rows.dtypes)[c] for c in ("user", "seq"))
    decided = ordered.mapInArrow(_simulate(limits), f"user {user_type}, seq {seq_type}, allowed boolean, message string")
    return decided.select(F.col("user").alias(user_col), F.col("seq").alias(seq_col), "allowed", "message")
