"""Rate limiting where one user may own most rows: a user's time is cut at lulls and the slices are decided side by side.

After a lull longer than the window nothing is left of a user's past but the number of open requests. So a slice is a map from
open requests before it to open requests behind it. Each slice's map is worked out on its own; a user's maps are applied one
after the other, one short row a slice; and then each slice is decided from the number it opens with.

A map has two parts. Up to some number of open requests the limit on them is never met: decisions are the same
for all of these, and the number behind the slice follows from sums over its rows. From there on every number is
tried. A slice in which too many numbers would have to be tried, or that is too long to be tried more than once, is known only up to there; a user who
comes to it with more is decided from it on by one task, as all users are without slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.admission import ADMITTED, HOUR_US, RELEASED, WINDOW_US, UserLog, messages
from ..rules import RateLimits
from .admission import micros

#: Parts of a window in which time is looked at; a lull is more than a window's worth of empty parts.
PARTS = 4
#: Numbers of open requests that are tried in a slice at most, and rows of a slice that is tried.
TRIES, TRIED_ROWS = 64, 100_000

_MAP = "user {user}, slice bigint, rows bigint, safe bigint, net bigint, least bigint, tried array<bigint>"


def _slice_map(limits: RateLimits, ts: list[int], released: list[bool], tokens: list[int], tries: int = TRIES) -> tuple[int, int, int, list[int]]:
    """``safe``: the most open requests with which the limit on them is never met (-1: none); up to there ``max(open + net, least)`` are
    open behind the slice. ``tried``: the numbers behind the slice for ``safe + 1`` and so on up to the limit; empty if there are too many."""
    limit = limits.concurrent_requests
    codes = UserLog(replace(limits, concurrent_requests=1 << 62)).decide(ts, released, tokens)
    step = np.array([1 if c == ADMITTED else -1 if c == RELEASED else 0 for c in codes])
    walk = np.concatenate([[0], np.cumsum(step)])
    from_none = walk - np.minimum(np.minimum.accumulate(walk), 0)
    asked = ~np.array(released)
    safe = limit
    if asked.any():
        safe = -1 if from_none[:-1][asked].max() >= limit else limit - 1 - max(int(walk[:-1][asked].max()), 0)
    tried = []
    if limit - safe <= tries:
        for opening in range(safe + 1, limit + 1):
            log = UserLog(limits)
            log.active = opening
            log.decide(ts, released, tokens)
            tried.append(log.active)
    return safe, int(walk[-1]), int(from_none[-1]), tried


def _maps(limits: RateLimits, tries: int, tried_rows: int):
    """The map of each slice, of rows sorted by user, slice and time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, held, schema = None, 0, ([], [], []), None

        def done() -> pa.RecordBatch:
            safe, net, least, tried = _slice_map(limits, *held, tries) if n <= tried_rows else (-1, 0, 0, [])
            made = {"slice": [key[1]], "rows": [n], "safe": [safe], "net": [net], "least": [least]}
            return pa.record_batch(
                {"user": pa.array([key[0]], schema.field("user").type), **{k: pa.array(v, pa.int64()) for k, v in made.items()}, "tried": pa.array([tried], pa.list_(pa.int64()))}
            )

        for batch in batches:
            schema = batch.schema
            columns = (batch[c].to_pylist() for c in ("user", "slice", "ts_us", "turn", "tokens"))
            for user, slice_, ts, turn, tokens in zip(*columns, strict=True):
                if (user, slice_) != key:
                    if key is not None:
                        yield done()
                    key, n, held = (user, slice_), 0, ([], [], [])
                n += 1
                if n <= tried_rows:
                    for values, v in zip(held, (ts, turn == 0, tokens), strict=True):
                        values.append(v)
        if key is not None:
            yield done()

    return run


def _openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of maps sorted by user and slice: what each slice opens with, and the first slice of the run that one task decides with it."""
    user, active, run = None, 0, None
    for batch in batches:
        openings, runs = [], []
        columns = (batch[c].to_pylist() for c in ("user", "slice", "safe", "net", "least", "tried"))
        for this, slice_, safe, net, least, tried in zip(*columns, strict=True):
            if this != user:
                user, active, run = this, 0, None
            openings.append(active)
            runs.append(slice_ if run is None else run)
            if run is None:
                if active <= safe:
                    active = max(active + net, least)
                elif active - safe <= len(tried):
                    active = tried[active - safe - 1]
                else:
                    run = slice_
        yield pa.record_batch({"user": batch["user"], "slice": batch["slice"], "opening": pa.array(openings, pa.int64()), "run": pa.array(runs, pa.int64())})


def _decide(limits: RateLimits):
    """Decisions over rows sorted by user, run and time, each run from its opening."""
    said = messages(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = log = None
        for batch in batches:
            users, runs, openings, ts, turns, tokens = (batch[c].to_pylist() for c in ("user", "run", "opening", "ts_us", "turn", "tokens"))
            codes: list[int] = []
            i, n = 0, len(users)
            while i < n:
                here, j = (users[i], runs[i]), i + 1
                while j < n and (users[j], runs[j]) == here:
                    j += 1
                if here != key:
                    key, log = here, UserLog(limits)
                    log.active = openings[i]
                codes += log.decide(ts[i:j], [t == 0 for t in turns[i:j]], tokens[i:j])
                i = j
            yield pa.record_batch(
                {
                    "user": batch["user"], "seq": batch["seq"],
                    "allowed": pa.array([None if c == RELEASED else c == ADMITTED for c in codes], pa.bool_()),
                    "message": pa.array([said.get(c) for c in codes], pa.string()),
                }
            )

    return run


def sliced(rows: DataFrame, window_us: int) -> DataFrame:
    """``rows`` (``user``, ``ts_us``) with ``slice``: the part of time with which a run without a lull begins.

    Lulls are found among the parts of time in which a user has rows, of which there are few, whatever the rows.
    """
    rows = rows.withColumn("part", F.expr(f"ts_us div {window_us // PARTS}"))
    seen = rows.select("user", "part").distinct()
    time = Window.partitionBy("user").orderBy("part")
    before = F.lag("part").over(time)
    begins = F.when(before.isNull() | (F.col("part") - before > PARTS), F.col("part"))
    parts = seen.withColumn("begins", begins).withColumn("slice", F.max("begins").over(time)).select("user", "part", "slice")
    return rows.join(parts, ["user", "part"]).drop("part")


def admit_requests_sliced(
    df: DataFrame,
    user_col: str = "user_id",
    ts_col: str = "ts",
    tokens_col: str = "tokens",
    kind_col: str | None = None,
    seq_col: str = "request_id",
    limits: RateLimits = RateLimits(),
    tries: int = TRIES,
    tried_rows: int = TRIED_ROWS,
) -> DataFrame:
    """The decisions of ``admit_requests``, with the rows of one user spread over tasks wherever a lull cuts the user's time.

    For tables in which few users own most rows; each row is read and decided twice or more. Rows without a user get no
    decision. ``tries`` and ``tried_rows`` bound the work on a slice's map, not the result.
    """
    if not limits.enabled:
        return df.select(user_col, seq_col, F.lit(True).alias("allowed"), F.lit(None).cast("string").alias("message"))
    kind = F.col(kind_col) if kind_col else F.lit("request")

    rows = df.select(
        F.col(user_col).alias("user"),
        F.coalesce(micros(F.col(ts_col)), F.lit(-(1 << 62))).alias("ts_us"),
        F.when(kind == "release", 0).otherwise(1).alias("turn"),
        F.col(seq_col).alias("seq"),
        F.coalesce(F.col(tokens_col).cast("bigint"), F.lit(0)).alias("tokens"),
    )
    user_type, seq_type = (dict(rows.dtypes)[c] for c in ("user", "seq"))
    window = WINDOW_US if limits.requests_per_hour is None else HOUR_US
    owned = sliced(rows.where("user IS NOT NULL"), window).repartition("user", "slice")
    maps = owned.sortWithinPartitions("user", "slice", "ts_us", "turn", "seq").mapInArrow(_maps(limits, tries, tried_rows), _MAP.format(user=user_type))
    chain = maps.repartition("user").sortWithinPartitions("user", "slice").mapInArrow(_openings, f"user {user_type}, slice bigint, opening bigint, run bigint")
    told = owned.join(chain, ["user", "slice"]).repartition("user", "run").sortWithinPartitions("user", "run", "slice", "ts_us", "turn", "seq")
    decided = told.mapInArrow(_decide(limits), f"user {user_type}, seq {seq_type}, allowed boolean, message string")
    none = rows.where("user IS NULL").select("user", "seq", F.lit(None).cast("boolean").alias("allowed"), F.lit(None).cast("string").alias("message"))
    return decided.union(none).select(F.col("user").alias(user_col), F.col("seq").alias(seq_col), "allowed", "message")
