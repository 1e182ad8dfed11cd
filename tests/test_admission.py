import random
from dataclasses import replace
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docwarden.operators import admission as A
from docwarden.operators import admission_split as S
from docwarden.rules import RateLimits
from docwarden.streaming.admission import AdmissionProcessor, admit_stream

from . import row_models as M

SCHEMA = "user_id string, us long, kind string, request_id long, tokens long"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("us"))


def decisions(df, **kw):
    out = A.admit_requests(df, kind_col="kind", **kw)
    return {r.request_id: (r.allowed, r.message) for r in out.collect()}


def expected(rows, limits):
    return M.admitted(
        rows, limits.requests_per_minute, limits.tokens_per_minute, limits.concurrent_requests, limits.requests_per_hour
    )


def traffic(seed, n=3000, span=1_500, hot=0.5, releases=0.4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = "hot" if rng.random() < hot else f"u{rng.randrange(6)}"
        kind = "release" if rng.random() < releases else "request"
        rows.append((user, rng.randrange(span) * 1_000_000 // rng.choice([1, 2, 4]), kind, i, rng.choice([0, 5, 40, 300])))
    return rows


@pytest.mark.parametrize(
    "seed,limits",
    [
        (1, RateLimits(requests_per_minute=12, tokens_per_minute=900, concurrent_requests=6)),
        (2, RateLimits(requests_per_minute=5, tokens_per_minute=10_000, concurrent_requests=10**6)),
        (3, RateLimits(requests_per_minute=9, tokens_per_minute=300, concurrent_requests=10**6, requests_per_hour=40)),
        (4, RateLimits()),
    ],
)
def test_batch_equals_sequential_model(spark, seed, limits):
    rows = traffic(seed)
    assert decisions(table(spark, rows).repartition(5), limits=limits) == expected(rows, limits)


def bursts(seed, n=4000, releases=0.4, lull=100):
    """Traffic of a hot user with lulls in it."""
    return [(u, us + us // 90_000_000 * lull * 1_000_000, *rest) for u, us, *rest in traffic(seed, n, 2_000, 0.9, releases)]


@pytest.mark.parametrize(
    "seed,limits,tries",
    [
        (1, RateLimits(requests_per_minute=12, tokens_per_minute=900, concurrent_requests=6), 64),
        (2, RateLimits(requests_per_minute=5, tokens_per_minute=10_000, concurrent_requests=10**6), 64),
        (3, RateLimits(requests_per_minute=9, tokens_per_minute=300, concurrent_requests=40), 3),
        (4, RateLimits(requests_per_minute=9, tokens_per_minute=1000, concurrent_requests=30), 64),
        (5, RateLimits(requests_per_minute=3, tokens_per_minute=300, concurrent_requests=0), 64),
        (6, RateLimits(), 64),
        (7, RateLimits(requests_per_minute=4, tokens_per_minute=300, concurrent_requests=9, requests_per_hour=60), 64),
    ],
)
def test_slices_equal_sequential_model(spark, seed, limits, tries):
    rows = bursts(seed, releases=0.2 + seed % 3 * 0.15, lull=100 if limits.requests_per_hour is None else 4000)
    out = S.admit_requests_sliced(table(spark, rows).repartition(5), kind_col="kind", limits=limits, tries=tries, tried_rows=tries * 30)
    got = {r.request_id: (r.allowed, r.message) for r in out.collect()}
    assert len(got) == len(rows) and got == expected(rows, limits)


def test_maps_of_slices():
    rng = random.Random(8)
    for _ in range(200):
        limits = RateLimits(requests_per_minute=rng.randrange(1, 9), tokens_per_minute=200, concurrent_requests=rng.randrange(0, 9))
        ts = sorted(rng.randrange(100_000_000) for _ in range(rng.randrange(1, 40)))
        released, tokens = [rng.random() < 0.5 for _ in ts], [rng.choice([0, 30, 90]) for _ in ts]
        safe, net, least, tried = S._slice_map(limits, ts, released, tokens)
        for opening in range(limits.concurrent_requests + 1):
            log = S.UserLog(limits)
            log.active = opening
            log.decide(ts, released, tokens)
            assert log.active == (max(opening + net, least) if opening <= safe else tried[opening - safe - 1])


def test_a_hot_user_is_decided_by_many_tasks(spark):
    rows = bursts(9)
    df = table(spark, rows)
    parts = S.sliced(df.select(F.col("user_id").alias("user"), F.col("us").alias("ts_us")), 60_000_000)
    assert parts.where("user = 'hot'").select("slice").distinct().count() >= 8
    odd = [(None, 5, "request", -1, 0), ("u", None, None, -2, None)]
    out = S.admit_requests_sliced(df.union(table(spark, odd)), kind_col="kind")
    assert {r.request_id: r.allowed for r in out.where("request_id < 0").collect()} == {-1: None, -2: True}
    assert S.admit_requests_sliced(df.limit(0), kind_col="kind").count() == 0


def test_saturated_hot_user(spark):
    """A user always at the limit, decided in one stream over many batches."""
    limits = RateLimits(requests_per_minute=7, tokens_per_minute=10**9, concurrent_requests=10**9)
    rows = [("hot", i * 900_001, "request", i, 1) for i in range(2400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert decisions(table(spark, rows).repartition(4), limits=limits) == expected(rows, limits)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_without_a_user_and_keys_in_their_own_type(spark):
    rows = [(7, 0, "request", 1, 0), (None, 0, "request", 2, 0), (None, 1, "release", 3, 0), (8, 0, None, 4, None)]
    df = spark.createDataFrame(rows, SCHEMA.replace("user_id string", "user_id bigint")).withColumn("ts", F.timestamp_micros("us"))
    out = A.admit_requests(df, kind_col="kind")
    assert dict(out.dtypes)["user_id"] == "bigint"
    assert {r.request_id: (r.user_id, r.allowed) for r in out.collect()} == {1: (7, True), 2: (None, None), 3: (None, None), 4: (8, True)}
    assert A.admit_requests(df.limit(0), kind_col="kind").count() == 0


def test_one_shuffle(spark):
    df = table(spark, [("a", 0, "request", 1, 0)])
    plan = A.admit_requests(df, kind_col="kind")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_limits_at_their_edges(spark):
    s = 1_000_000
    rows = [("a", i, "request", i, 0) for i in range(10)]  # 10 open
    rows += [("a", 10, "request", 10, 0), ("a", 11, "release", 11, 0), ("a", 12, "request", 12, 0)]
    rows += [("b", 0, "release", 20, 0), ("b", 5, "request", 22, 60_000), ("b", 5, "release", 23, 0)]
    rows += [("b", 6, "request", 24, 40_000), ("b", 7, "request", 25, 1), ("b", 60 * s + 5, "request", 26, 60_001), ("b", 60 * s + 6, "request", 27, 39_999)]
    got = decisions(table(spark, rows))
    assert got == expected(rows, RateLimits())
    assert got[10] == (False, "Concurrent request limit (10) exceeded") and got[12] == (True, None)
    assert got[24] == (True, None) and got[25] == (False, "Token limit (100000/min) exceeded")
    many = [("c", i, "request", 2 * i, 0) for i in range(61)] + [("c", i, "release", 2 * i + 1, 0) for i in range(1, 61)]
    many += [("c", 60 * s - 1, "request", 900, 0), ("c", 60 * s, "request", 901, 0)]
    got = decisions(table(spark, many))
    assert got == expected(many, RateLimits())
    assert got[118] == (True, None) and got[120] == (False, "Rate limit (60/min) exceeded")
    assert got[900][0] is False and got[901][0] is True


def test_disabled(spark):
    rows = [("a", i, "request", i, 10**7) for i in range(30)]
    out = A.admit_requests(table(spark, rows), limits=RateLimits(enabled=False))
    assert out.where("allowed").count() == 30


def test_offered_load_equals_brute_force(spark):
    rows = traffic(9, n=1500)
    df = A.offered_load(table(spark, rows), slice_seconds=120).collect()
    assert len(df) == 1500
    for r in df:
        near = [x for x in rows if x[0] == r.user_id and r.us - 60_000_000 < x[1] <= r.us]
        assert (r.requests_last_minute, r.tokens_last_minute) == (len(near), sum(x[4] for x in near))


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    limits = RateLimits(requests_per_minute=12, tokens_per_minute=900, concurrent_requests=6)
    # Spark counts rows at the initial watermark, the epoch, as late
    rows = [(u, us + 10**9, *rest) for u, us, *rest in traffic(5, n=600, span=600)]
    src = tmp_path / "in"
    ordered = sorted(rows, key=lambda r: r[1])
    for i in range(0, 600, 200):
        chunk = ordered[i : i + 200]
        random.Random(i).shuffle(chunk)
        table(spark, chunk).coalesce(1).write.mode("append").parquet(str(src))
    # far in the future, to move the watermark past everything
    table(spark, [("zz", 10**13, "request", 9999, 0)]).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(table(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    out = admit_stream(stream, kind_col="kind", delay="20 minutes", limits=limits)
    query = (
        out.writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    got = {r.seq: (r.allowed, r.message) for r in spark.table("admitted").collect()}
    assert got == expected(rows, limits)


class _State(dict):
    """A map state, a value state and a handle with timers in one; counts calls."""

    def __init__(self):
        super().__init__()
        self.calls, self.value, self.timers = 0, None, set()
        self.updateValue = lambda k, v: self._call(self.__setitem__, k[0], v)
        self.getValue = lambda k: self._call(dict.get, self, k[0])
        self.removeKey = lambda k: self._call(self.pop, k[0])
        self.containsKey = lambda k: self._call(self.__contains__, k[0])
        self.getMapState = self.getValueState = lambda *_: self
        self.registerTimer, self.deleteTimer, self.listTimers = self.timers.add, self.timers.discard, lambda: list(self.timers)
        self.get, self.update, self.clear = lambda: self.value, lambda v: setattr(self, "value", v), lambda: setattr(self, "value", None)

    def _call(self, what, *given):
        self.calls += 1
        return what(*given)

    def keys(self):
        self.calls += 1
        return [(k,) for k in dict.keys(self)]


@pytest.mark.parametrize("spread", [1_000_000, 20_000_000])
def test_waiting_rows_take_few_calls_to_the_state(spread):
    """Rows that come together are kept and read together, however far apart in time, and decided as in a batch."""
    limits = RateLimits(requests_per_minute=12, tokens_per_minute=900, concurrent_requests=6)
    rng = random.Random(3)
    rows = [("u", 10**9 + i * spread + rng.randrange(spread), rng.choice(["request", "request", "release"]), i, rng.choice([0, 50, 300])) for i in range(3000)]
    times = sorted(r[1] for r in rows)
    processor, waiting, log = AdmissionProcessor(limits), _State(), _State()
    processor.init(waiting)
    processor.log = log
    got, arriving = {}, rng.sample(rows, len(rows))
    parts = [arriving[:1500], arriving[1500:1510], arriving[1510:], []]
    for part, mark in zip(parts, (0, 0, times[700], times[-1])):
        frame = pd.DataFrame([(us, 0 if kind == "release" else 1, seq, tokens) for _, us, kind, seq, tokens in part], columns=["ts_us", "turn", "seq", "tokens"])
        timer = SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: -(-mark // 1000))
        for out in processor.handleInputRows(("u",), iter([frame]), timer):
            got |= {r.seq: (None if pd.isna(r.allowed) else r.allowed, r.message) for r in out.itertuples()}
    assert got == expected(rows, limits)
    assert not dict.keys(waiting) and waiting.calls < 120
