"""Rate limiting on a stream of requests, in event time."""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.admission import ADMITTED, RELEASED, UserLog, messages
from ..operators.admission import micros
from ..rules import RateLimits

# Kind of a row that closes a stream: it only moves the watermark.
CLOSING = "closing"
#: Waiting rows lie in chunks, each kept under the bucket of time of its first row.
BUCKET_US = 5_000_000
CHUNK_ROWS = 512
OUTPUT = "user string, seq long, ts timestamp, allowed boolean, message string"


class AdmissionProcessor(StatefulProcessor):
    """Holds a user's rows until the watermark has passed them, then decides them in time order, so that
    rows may come in any order within the watermark delay. State: the rows waiting, in chunks by time, of which a trigger
    reads those that are due or whose first bucket gets rows and no others; and a log bounded by the limits, dropped once it is blank.
    Every call to the state is a round trip, so rows that come together are kept together."""

    def __init__(self, limits: RateLimits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", "rows string")
        self.log = handle.getValueState("log", "state string")

    def _held(self, bucket: int) -> list[list[int]]:
        return json.loads(self.waiting.getValue((bucket,))[0])

    def _keep(self, rows: list[list[int]], buckets: set[int]) -> None:
        """Put rows, in order of time, by; ``buckets`` are those under which something lies, and grow."""
        i = 0
        while i < len(rows):
            bucket = rows[i][0] // BUCKET_US
            taken = bucket in buckets
            # What lies there already gets the rows of its own bucket only, or it would grow without end.
            j = bisect_left(rows, [(bucket + 1) * BUCKET_US], i)
            if not taken:
                j = max(j, min(i + CHUNK_ROWS, len(rows)))
            some = (self._held(bucket) if taken else []) + rows[i:j]
            self.waiting.updateValue((bucket,), (json.dumps(some),))
            buckets.add(bucket)
            i = j

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: list[list[int]] = []
        for batch in rows:
            some = batch.loc[batch["turn"] < 2, ["ts_us", "turn", "seq", "tokens"]]
            new += [[int(v) for v in row] for row in some.itertuples(index=False)]
        return self._decide(key, timerValues, sorted(new))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._decide(key, timerValues)

    def _decide(self, key, timer_values, new: list[list[int]] = []) -> Iterator[pd.DataFrame]:
        mark = timer_values.getCurrentWatermarkInMs() * 1000
        buckets = {k[0] for k in self.waiting.keys()}
        due = list(new)
        for bucket in sorted(buckets):
            if bucket * BUCKET_US > mark:
                break
            due += self._held(bucket)
            self.waiting.removeKey((bucket,))
            buckets.remove(bucket)
        due.sort()
        # A row at the watermark is due: Spark takes it for late from now on.
        at = bisect_right(due, mark, key=itemgetter(0))
        due, later = due[:at], due[at:]
        self._keep(later, buckets)
        first = [later[0][0]] if later else []
        next_at = min(first + [b * BUCKET_US for b in buckets if b * BUCKET_US > mark], default=None)
        saved = self.log.get()
        log = UserLog(self.limits, saved[0] if saved else None)
        codes = log.decide([r[0] for r in due], [r[1] == 0 for r in due], [r[3] for r in due])
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        log.forget(mark)
        if log.is_blank():
            self.log.clear()
        else:
            self.log.update((log.save(),))
        wake = (0 if log.is_blank() else log.expires_at()) if next_at is None else max(next_at, 1)
        if wake:
            # It fires in the batch in which the watermark reaches ``wake``; what came out later would be late.
            self.handle.registerTimer(max(-(-wake // 1000) - 1, mark // 1000))
        if due:
            said = messages(self.limits)
            yield pd.DataFrame(
                {
                    "user": key[0],
                    "seq": [r[2] for r in due],
                    "ts": pd.to_datetime([r[0] for r in due], unit="us"),
                    "allowed": pd.array(
                        [None if c == RELEASED else c == ADMITTED for c in codes], dtype="boolean"
                    ),
                    "message": [said.get(c) for c in codes],
                }
            )

    def close(self) -> None:
        pass


def closing_mark(times: DataFrame, like: DataFrame, ts_col: str = "ts", kind_col: str = "kind") -> DataFrame:
    """Rows of kind ``closing`` at the given times, in the columns of ``like``.

    United with the stream, one that lies further behind the last row than the delay lets every row be decided when a
    run over what is available ends. It has no decision itself.
    """
    kinds = {f.name: f.dataType for f in like.schema}
    given = {ts_col: F.col("ts"), kind_col: F.lit(CLOSING)}
    return times.select(*(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))


def admit_stream(
    stream: DataFrame,
    user_col: str = "user_id",
    ts_col: str = "ts",
    tokens_col: str = "tokens",
    kind_col: str | None = None,
    seq_col: str = "request_id",
    delay: str = "1 minute",
    limits: RateLimits = RateLimits(),
) -> DataFrame:
    """Decisions for a stream: ``user``, ``seq``, ``ts``, ``allowed``, ``message``, as the batch operator
    gives them; ``user`` is text. A decision comes out once the watermark has passed its row; rows later than ``delay`` are
    dropped and counted by Spark. Rows without a user belong to no limit: they come out at once, undecided. ``seq_col`` must be
    integral. The session needs the RocksDB state store. ``ts`` is an event time for operators that follow.
    """
    kind = F.col(kind_col) if kind_col else F.lit("request")
    rows = stream.select(
        F.col(user_col).cast("string").alias("user"),
        F.col(ts_col).cast("timestamp").alias("at"),
        micros(F.col(ts_col)).alias("ts_us"),
        F.when(kind == "release", 0).when(kind == CLOSING, 2).otherwise(1).alias("turn"),
        F.col(seq_col).cast("bigint").alias("seq"),
        F.coalesce(F.col(tokens_col).cast("bigint"), F.lit(0)).alias("tokens"),
    ).withWatermark("at", delay)
    # Closing marks of no user go to a user of their own, so that they reach the watermark here as well.
    owned = rows.withColumn("user", F.when(F.col("turn") == 2, F.coalesce("user", F.lit(""))).otherwise(F.col("user")))
    decided = owned.where(_not_null("user", "at")).groupBy("user").transformWithStateInPandas(
        statefulProcessor=AdmissionProcessor(limits),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="EventTime",
        eventTimeColumnName="ts",
    )
    unowned = rows.where(F.col("user").isNull() & (F.col("turn") < 2) & F.col("at").isNotNull())
    none = {"allowed": F.lit(None).cast("boolean"), "message": F.lit(None).cast("string")}
    return decided.union(unowned.select("user", "seq", F.col("at").alias("ts"), *(c.alias(n) for n, c in none.items())))


def _not_null(column: str, event_time: str) -> Column:
    """A condition that Spark does not move below the watermark on ``event_time``, which all rows must reach."""
    return F.when(F.col(event_time).isNull(), F.lit(False)).otherwise(F.col(column).isNotNull())
