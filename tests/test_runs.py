"""Runs that resume, calls in flight, contents by reference."""

import hashlib
import shutil
import threading
import time

import pytest
from pyspark.sql import functions as F

from docwarden.operators import tasks as TA
from docwarden.operators.run import Batched, run_multistep, run_saved, run_tasks, saved_answers
from docwarden.sources.contents import read_content, store_contents

from .test_tasks import DOCS, LINK, tasks_df

N = 40


def ready(spark, documents=None):
    docs = spark.createDataFrame([(i, "text/plain", f"text {i}", None, None, "text") for i in range(N)], DOCS) if documents is None else documents
    links = spark.createDataFrame([(i, k, (i + k) % N) for i in range(N) for k in range(1 + i % 3)], LINK)
    tasks = tasks_df(spark, [(i, "ocr", None, None, f"number {i}.") for i in range(N)])
    ready = TA.make_tasks(TA.assemble_tasks(tasks, links, docs), None, "s")
    return TA.render_prompt(ready, None).withColumn("model", F.lit("m")), TA.task_parts(links, docs)


def say(task):
    texts = [p["text"] for p in task["parts"]]
    assert texts == [p["text"] for p in task["parts"]]
    if "number 7." in task["prompt"]:
        raise RuntimeError("no sevens")
    return f"{texts} {len(task['prompt'])}", 3


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_windows_and_lists_give_the_same(spark, tmp_path):
    tasks, parts = ready(spark)
    plain = rows(run_tasks(tasks, lambda: say, parts))
    assert len(plain) == N and sum(r[1] for r in plain) == N - 1
    assert rows(run_tasks(tasks, lambda: say, parts, window=8)) == plain

    def listed():
        def generate(requests):
            (tmp_path / f"{len(requests)}-{time.monotonic_ns()}-{threading.get_ident()}").touch()
            out = []
            for r in requests:
                try:
                    out.append(say(r))
                except RuntimeError as e:
                    out.append(e)
            return out

        return generate

    assert rows(run_tasks(tasks.coalesce(1), Batched(listed), parts, window=8)) == plain
    sizes = [int(f.name.split("-")[0]) for f in tmp_path.iterdir()]
    assert sum(sizes) == N and max(sizes) > 1 and max(sizes) <= 8
    steps = rows(run_multistep(tasks, lambda: say, parts))
    assert rows(run_multistep(tasks, lambda: say, parts, window=8)) == steps
    assert rows(run_multistep(tasks, Batched(listed), parts, window=8)) == steps


def test_lists_that_fail(spark):
    tasks, parts = ready(spark)
    short = run_tasks(tasks, Batched(lambda: lambda requests: ["x"] * (len(requests) + 1)), parts, window=4).collect()
    assert len(short) == N and all(not r.success and "answers to" in r.error for r in short)

    def down():
        def generate(requests):
            raise RuntimeError("down")

        return generate

    assert {r.error for r in run_tasks(tasks, Batched(down), parts, window=4).collect()} == {"down"}


def test_calls_are_in_flight_together(spark):
    tasks, _ = ready(spark)

    def meeting():
        barrier = threading.Barrier(4, timeout=20)

        def generate(task):
            barrier.wait()
            return "met"

        return generate

    out = run_tasks(tasks.repartition(1), meeting, window=4).collect()
    assert len(out) == N and all(r.content == "met" for r in out)


def counting(folder, fails):
    """A model that leaves a file for each call."""

    def factory():
        def generate(task):
            number = task["prompt"].partition("number ")[2].partition(".")[0]
            kind = task["prompt"].partition("Step: ")[2].partition("\n")[0]
            (folder / f"{number}~{kind}~{time.monotonic_ns()}-{threading.get_ident()}").touch()
            if fails(int(number), kind):
                raise RuntimeError("down")
            return f"answer {number}", 2

        return generate

    return factory


def calls(folder):
    return sorted(f.name.rsplit("~", 1)[0] for f in folder.iterdir())


def test_a_run_resumes(spark, tmp_path):
    tasks, parts = ready(spark)
    asked, store = tmp_path / "asked", f"file://{tmp_path}/store"
    asked.mkdir()
    assert saved_answers(tasks, store).count() == 0
    first = run_saved(tasks, counting(asked, lambda n, _: n >= N // 2), store, parts, save_rows=3)
    assert first.where("success").count() == N // 2 and first.count() == N
    again = run_saved(tasks, counting(asked, lambda n, _: False), store, parts, window=4)
    assert again.where("success").count() == N == again.count()
    names = [c.split("~")[0] for c in calls(asked)]
    assert all(names.count(str(i)) == (1 if i < N // 2 else 2) for i in range(N))
    third = run_saved(tasks, counting(asked, lambda n, _: True), store, parts)
    assert len(calls(asked)) == len(names) and rows(third) == rows(again)
    assert run_saved(tasks.limit(0), counting(asked, lambda n, _: False), f"{store}-2", parts).count() == 0


def test_a_run_that_dies_keeps_what_it_has(spark, tmp_path):
    tasks, parts = ready(spark)
    asked, store = tmp_path / "asked", f"file://{tmp_path}/store"
    asked.mkdir()

    def dying():
        inner = counting(asked, lambda n, _: False)()

        def generate(task):
            if "number 20." in task["prompt"]:
                raise SystemExit(3)
            return inner(task)

        return generate

    with pytest.raises(Exception):
        run_saved(tasks, dying, store, parts)
    kept = {r.task_id for r in saved_answers(tasks, store).collect()}
    assert {int(c.split("~")[0]) for c in calls(asked)} == kept and len(kept) < N
    assert run_saved(tasks, counting(asked, lambda n, _: False), store, parts).where("success").count() == N
    names = [c.split("~")[0] for c in calls(asked)]
    assert sorted(map(int, names)) == list(range(N))


def test_a_run_leaves_one_file_a_partition(spark, tmp_path):
    tasks, parts = ready(spark)
    store = f"file://{tmp_path}/store"
    out = run_saved(tasks, lambda: lambda task: "said", store, parts, save_rows=1)
    files = list((tmp_path / "store/answers/run=1").iterdir())
    assert out.count() == N == saved_answers(tasks, store).count()
    assert len(files) == len({f.name.split("-")[1] for f in files}) < N
    # A task that died while it deleted the files that it had put together.
    whole = next(f for f in files if f.name.endswith("-all.parquet"))
    shutil.copy(whole, whole.with_name(whole.name.replace("-all", "-0")))
    assert out.count() == N == saved_answers(tasks, store).count()
    again = run_saved(tasks, lambda: lambda task: "other", store, parts)
    assert {r.content for r in again.collect()} == {"said"} and again.count() == N


def test_steps_resume(spark, tmp_path):
    tasks, parts = ready(spark)
    tasks = tasks.withColumn("additional_context", F.concat(F.lit("number "), "task_id", F.lit(".")))
    asked, store = tmp_path / "asked", f"file://{tmp_path}/store"
    asked.mkdir()
    first = run_saved(tasks, counting(asked, lambda n, step: n % 2 == 1 and "extract" in step), store, parts, multistep=True)
    assert first.where("success").count() == N // 2
    again = run_saved(tasks, counting(asked, lambda n, step: False), store, parts, multistep=True)
    done = {r.task_id: r for r in again.collect()}
    assert all(done[i].success and [s.step for s in done[i].metadata.steps] == ["analyze", "extract", "synthesize"] for i in range(N))
    # Of an odd task only the failed step is asked twice.
    assert all(sum(c.startswith(f"{i}~") for c in calls(asked)) == 3 + i % 2 for i in range(N))


def shuffled(df):
    """What the exchanges of a plan carry, as schemas."""
    out, nodes = [], [df._jdf.queryExecution().executedPlan().initialPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Exchange":
            out.append(node.schema().simpleString())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_contents_by_reference(spark, tmp_path):
    data = [bytes([i % 5]) * (i % 5) * 1000 for i in range(N)]
    docs = spark.createDataFrame([(i, "image/png", None, None, bytearray(data[i]), f"/f{i}") if i % 2 else (i, "text/plain", f"t{i}", None, None, "text") for i in range(N)], DOCS)
    stored = store_contents(docs, f"file://{tmp_path}/store")
    assert "content" not in stored.columns and stored.count() == N
    for r in stored.where("doc_id % 2 = 1").collect():
        assert r.content_ref.sha256 == hashlib.sha256(data[r.doc_id]).hexdigest() and read_content(r.content_ref.asDict()) == data[r.doc_id]
    assert stored.where("doc_id % 2 = 0 AND content_ref IS NULL AND text_ref IS NOT NULL").count() == N // 2 and "text" not in stored.columns

    def sizes(task):
        for _ in range(2):
            seen = [f"{p['doc_id']}:{len(p['content'] or b'')}:{len(p.get('content') or b'')}:{p['text']}:{p.get('text')}:{p.get('uri')}" for p in task["parts"]]
        return " ".join(seen), 1

    tasks, parts = ready(spark, stored)
    by_ref = run_tasks(tasks, lambda: sizes, parts)
    assert len(shuffled(by_ref)) >= 3 and not any("binary" in s for s in shuffled(by_ref))
    tasks, parts = ready(spark, docs)
    assert rows(by_ref) == rows(run_tasks(tasks, lambda: sizes, parts)) == rows(run_tasks(tasks, lambda: sizes, parts, window=5))
    assert any("binary" in s for s in shuffled(run_tasks(tasks, lambda: sizes, parts)))
    assert store_contents(docs.limit(0), f"file://{tmp_path}/none").count() == 0
    ref = stored.where("doc_id = 1").first().content_ref.asDict()
    with pytest.raises(ValueError):
        read_content(ref | {"sha256": "0" * 64})
