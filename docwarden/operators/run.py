"""Running tasks through a caller's model function.

The function is the only Python in the path: it is built once per partition (clients, connections), gets one task at a time
or, as ``Batched``, several, and what it raises becomes a failed result. Up to ``window`` calls of a partition are in flight at
once; results keep the order of the tasks. A retried Spark task calls the function again for its rows, but not in ``run_saved``,
which writes results as they come and asks only for what is not answered.

A task and its documents come as neighbouring rows, the task first. The function gets its documents as an iterable
that reads them as they stream by; what has been read is kept for a second pass, beyond some MB in a temporary file
of the task, so that no number of documents fills the memory. With a window over one, a task's documents are
kept before its call, since the stream moves on to the next task.
"""

from __future__ import annotations

import pickle
import tempfile
import time
from collections import Counter, deque
from collections.abc import Callable, Generator, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial
from itertools import islice

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.templates import STEP_PROMPT, STEPS
from ..sources.contents import place, read_content

# A model function takes a dict with ``prompt``, ``parts`` (an iterable of dicts: doc_index, doc_id, part_kind, mime, text,
# uri, content), ``model`` and ``config``, and returns the text, or the text and the number of tokens used.
Generate = Callable[[dict], "str | tuple[str, int]"]
GenerateFactory = Callable[[], Generate]


@dataclass(frozen=True)
class Batched:
    """Builds a function that takes a list of requests, at most a window's, and returns as many answers in their order.

    An answer may be an exception, which fails that task; what the function raises fails all tasks of the list.
    """

    factory: Callable[[], Callable[[list[dict]], list]]

    def __call__(self) -> Callable[[list[dict]], list]:
        return self.factory()


SPOOL_BYTES = 16 << 20
GATHER_BYTES = 16 << 20
GATHERED = "-all.parquet"
_TASK_COLUMNS = (
    "action", "full_prompt", "session_id", "additional_context", "output_format", "model", "generation_config", "task_error", "n_documents",
    "steps_done",
)
_PART_COLUMNS = ("doc_index", "doc_id", "part_kind", "mime", "text", "uri", "content", "content_ref", "text_ref")

RESULT = (
    "task_id {key}, success boolean, content string, model_used string, tokens_used bigint, error string,"
    " metadata struct<action:string,session_id:string,document_count:int,"
    "steps:array<struct<step:string,result:string,error:string>>,multi_step:boolean>"
)


class _Part(dict):
    """A document; ``content`` or ``text`` that is stored elsewhere is read when it is asked for, and not kept."""

    def __missing__(self, name: str):
        if name not in ("content", "text"):
            raise KeyError(name)
        ref = self[f"{name}_ref"]
        data = None if ref is None else read_content(ref)
        return data.decode() if data is not None and name == "text" else data

    def get(self, name: str, default=None):
        return self[name] if name in ("content", "text") or name in self else default


class _Parts:
    """The documents of one task, read from the stream on the first pass and from the spool on later ones; none that is not asked for is unpacked."""

    def __init__(self, stream: Iterator[pa.Scalar], memory: int = SPOOL_BYTES):
        self.stream, self.memory, self.spool, self.kept = stream, memory, None, 0

    def __iter__(self) -> Iterator[dict]:
        at, done = 0, 0
        while True:
            if done < self.kept:
                self.spool.seek(at)
                part = pickle.load(self.spool)
                at = self.spool.tell()
            else:
                told = next(self.stream, None)
                if told is None:
                    return
                part = _Part(told.as_py())
                self.spool = self.spool or tempfile.SpooledTemporaryFile(self.memory)
                self.spool.seek(0, 2)
                pickle.dump(part, self.spool)
                at = self.spool.tell()
                self.kept += 1
            done += 1
            yield part

    def keep(self) -> None:
        for _ in self:
            pass

    def close(self) -> None:
        for _ in self.stream:
            pass
        if self.spool:
            self.spool.close()


# What a task does is a conversation: it yields prompts, is sent (text, tokens) or thrown what the call raised, and returns its result.
Talk = Generator[str, "tuple[str, int | None]", dict]


def _request(task: dict, prompt: str) -> dict:
    return {"prompt": prompt, "parts": task["parts"], "model": task.get("model"), "config": task.get("generation_config")}


def _answer(said) -> tuple[str, int | None]:
    return said if isinstance(said, tuple) else (said, None)


def _result(task: dict, success: bool, content=None, tokens=None, error=None, **metadata) -> dict:
    facts = {"action": task["action"], "session_id": None, "document_count": None, "steps": None, "multi_step": None}
    return {
        "task_id": task["task_id"],
        "success": success,
        "content": content,
        "model_used": task.get("model"),
        "tokens_used": tokens,
        "error": error,
        "metadata": facts | metadata,
    }


def _single(task: dict) -> Talk:
    if isinstance(task.get("task_error"), str):
        return _result(task, False, error=task["task_error"])
    try:
        text, tokens = yield task["full_prompt"]
    except Exception as failure:  # noqa: BLE001 - any failure of the caller's function is a result
        return _result(task, False, error=str(failure))
    return _result(task, True, text, tokens, session_id=task["session_id"], document_count=task.get("n_documents"))


def _stepwise(task: dict) -> Talk:
    if isinstance(task.get("task_error"), str):
        return _result(task, False, error=task["task_error"], multi_step=True)
    known = {s["step"]: s["result"] for s in task.get("steps_done") or () if s["error"] is None}
    steps: list[dict] = []
    previous = "None"
    for name, instruction in STEPS:
        prompt = STEP_PROMPT.format(
            step=name,
            instruction=instruction,
            action=task["action"],
            additional_context=task.get("additional_context") or "",
            previous=previous,
            output_format=task.get("output_format") or "markdown",
        )
        try:
            previous = known[name] if name in known else (yield prompt)[0]
        except Exception as failure:  # noqa: BLE001
            # Later steps build on this one, so they are not run.
            steps.append({"step": name, "result": None, "error": str(failure)})
            return _result(task, False, steps=steps, multi_step=True)
        steps.append({"step": name, "result": previous, "error": None})
    return _result(task, True, previous, steps=steps, multi_step=True)


def _alone(generate: Generate, talk: Talk, task: dict) -> dict:
    """A task from its first prompt to its result."""
    try:
        prompt = next(talk)
        while True:
            try:
                said = _answer(generate(_request(task, prompt)))
            except Exception as failure:  # noqa: BLE001
                prompt = talk.throw(failure)
            else:
                prompt = talk.send(said)
    except StopIteration as end:
        return end.value


def _together(generate: Callable[[list[dict]], list], talks: list[Talk], tasks: list[dict]) -> list[dict]:
    """Several tasks side by side: the prompts that are open go to the function as one list."""
    results: list = [None] * len(tasks)
    asked: dict[int, str] = {}

    def move(i: int, step: Callable[[], str]) -> None:
        try:
            asked[i] = step()
        except StopIteration as end:
            asked.pop(i, None)
            results[i] = end.value

    for i, talk in enumerate(talks):
        move(i, partial(next, talk))
    while asked:
        order = list(asked)
        try:
            said = list(generate([_request(tasks[i], asked[i]) for i in order]))
            if len(said) != len(order):
                raise ValueError(f"{len(said)} answers to {len(order)} requests")
        except Exception as failure:  # noqa: BLE001
            said = [failure] * len(order)
        for i, s in zip(order, said, strict=True):
            move(i, partial(talks[i].throw, s) if isinstance(s, Exception) else partial(talks[i].send, _answer(s)))
    return results


def _results(factory: GenerateFactory | Batched, told: Iterator[dict], make: Callable[[dict], Talk], window: int) -> Iterator[dict]:
    """Results in the order of the tasks, with at most ``window`` of them in the works."""
    generate = factory()
    if isinstance(factory, Batched):
        while some := list(islice(told, window)):
            yield from _together(generate, [make(t) for t in some], some)
            for t in some:
                t["parts"].close()
    elif window == 1:
        for t in told:
            yield _alone(generate, make(t), t)
            t["parts"].close()
    else:
        with ThreadPoolExecutor(window) as pool:
            flying: deque = deque()
            for t in told:
                flying.append((t, pool.submit(_alone, generate, make(t), t)))
                if len(flying) == window:
                    yield _landed(flying)
            while flying:
                yield _landed(flying)


def _landed(flying: deque) -> dict:
    task, call = flying.popleft()
    result = call.result()
    task["parts"].close()
    return result


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            some = batch.slice(i, 64)
            yield from zip(some["task_id"].to_pylist(), some["task"].to_pylist(), some["part"], strict=True)


def _told(rows: Iterator[tuple], window: int, answered: set) -> Iterator[dict]:
    """Tasks that are not answered, each with its documents; whoever gets one closes them."""
    row = next(rows, None)
    while row is not None:
        key, task, _ = row
        row = next(rows, None)
        if task is None:
            # Documents of a task that is not there.
            continue

        def own(key=key) -> Iterator[pa.Scalar]:
            nonlocal row
            while row is not None and row[1] is None and row[0] == key:
                part, row = row[2], next(rows, None)
                yield part

        held = _Parts(own(), SPOOL_BYTES // window)
        if key in answered:
            held.close()
            continue
        if window > 1:
            held.keep()
        yield task | {"task_id": key, "parts": held}


def _neighbours(tasks: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Rows of tasks and documents, a task's own row first, then its documents in order."""
    told = tasks.select("task_id", F.struct(*(c for c in _TASK_COLUMNS if c in tasks.columns)).alias("task"))
    if parts is None:
        return told.withColumn("part", F.lit(None).cast("struct<doc_index:int>"))
    part = parts.where(F.col("part_kind").isNotNull()).select("task_id", F.struct(*(c for c in _PART_COLUMNS if c in parts.columns)).alias("part"))
    kinds = {"task": told.schema["task"].dataType, "part": part.schema["part"].dataType}
    rows = told.withColumn("part", F.lit(None).cast(kinds["part"])).unionByName(part.withColumn("task", F.lit(None).cast(kinds["task"])))
    # One shuffle, and nothing is gathered.
    rows = rows.repartition("task_id").sortWithinPartitions("task_id", F.col("part").isNotNull(), "part.doc_index", "part.doc_id")
    return rows.select("task_id", "task", "part")


def _schema(tasks: DataFrame) -> pa.Schema:
    return pa.schema({"task_id": to_arrow_type(tasks.schema["task_id"].dataType)} | _RESULT_TYPES)


def _run(tasks: DataFrame, parts: DataFrame | None, factory: GenerateFactory | Batched, make: Callable[[dict], Talk], window: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        results = _results(factory, _told(_rows(batches), window, set()), make, window)
        while done := list(islice(results, 256)):
            yield pa.RecordBatch.from_pylist(done, schema)

    schema = _schema(tasks)
    return _neighbours(tasks, parts).mapInArrow(work, RESULT.format(key=dict(tasks.dtypes)["task_id"]))


_METADATA = pa.struct(
    {
        "action": pa.string(),
        "session_id": pa.string(),
        "document_count": pa.int32(),
        "steps": pa.list_(pa.struct({"step": pa.string(), "result": pa.string(), "error": pa.string()})),
        "multi_step": pa.bool_(),
    }
)
_RESULT_TYPES = {
    "success": pa.bool_(), "content": pa.string(), "model_used": pa.string(), "tokens_used": pa.int64(), "error": pa.string(), "metadata": _METADATA,
}


_RESULT_COLUMNS = tuple(c for c in _RESULT_TYPES if c != "success")


def run_tasks(tasks: DataFrame, factory: GenerateFactory | Batched, parts: DataFrame | None = None, window: int = 1) -> DataFrame:
    """One model call per task with its documents, the rows of ``task_parts``; ``task_id`` must be unique in ``tasks``."""
    return _run(tasks, parts, factory, _single, window)


def run_multistep(tasks: DataFrame, factory: GenerateFactory | Batched, parts: DataFrame | None = None, window: int = 1) -> DataFrame:
    """Three calls per task (analyze, extract, synthesize), each prompt holding the answer before it.
    The task succeeds if all steps do; its content is the last answer."""
    return _run(tasks, parts, factory, _stepwise, window)


def run_batch(
    tasks: DataFrame,
    default: GenerateFactory | Batched,
    agents: dict[str, GenerateFactory | Batched] | None = None,
    agent_name: str | None = None,
    parts: DataFrame | None = None,
    window: int = 1,
) -> DataFrame:
    """Run all tasks with the named agent; an unknown or missing name means the default one. Partitions
    run side by side; ``task_id`` ties a result to its task."""
    return run_tasks(tasks, (agents or {}).get(agent_name, default), parts, window)


def saved_answers(tasks: DataFrame, folder: str) -> DataFrame:
    """All results that ``run_saved`` has written to ``folder``, with the ``run`` they are from; none if there are none yet."""
    spark = tasks.sparkSession
    schema = RESULT.format(key=dict(tasks.dtypes)["task_id"]) + ", run int"
    if not _runs(tasks, folder):
        return spark.createDataFrame([], schema)
    saved = spark.read.schema(schema).parquet(f"{folder}/answers")
    return saved.dropDuplicates(["run", "task_id"]) if _doubled(folder) else saved


def _doubled(folder: str) -> bool:
    """Whether a task died after it had gathered its files and before all of them were deleted: results stand there twice."""
    fs, base = place(f"{folder}/answers")
    files, gathered = Counter(), set()
    for f in fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True)):
        if f.is_file and f.base_name.startswith("part-"):
            part = f.path.rpartition("/")[0], f.base_name.split("-")[1]
            files[part] += 1
            if f.base_name.endswith(GATHERED):
                gathered.add(part)
    return any(files[p] > 1 for p in gathered)


def _gather(files: list[str], to: str, schema: pa.Schema, fs: pyarrow.fs.FileSystem) -> None:
    """One file in place of many of a few rows each, which cost a reader more than the rows in them; each result once."""
    if len(files) < 2:
        return
    base, _, name = to.rpartition("/")
    seen: set = set()
    held: list[pa.Table] = []
    size = 0
    with pyarrow.parquet.ParquetWriter(f"{base}/_{name}", schema, filesystem=fs) as out:
        for f in files:
            some = pyarrow.parquet.read_table(f, schema=schema, filesystem=fs, partitioning=None)
            keys = some["task_id"].to_pylist()
            held.append(some.filter(pa.array([k not in seen for k in keys], pa.bool_())))
            seen.update(keys)
            size += some.nbytes
            if size > GATHER_BYTES:
                out.write_table(pa.concat_tables(held))
                held, size = [], 0
        if held:
            out.write_table(pa.concat_tables(held))
    fs.move(f"{base}/_{name}", to)
    for f in files:
        fs.delete_file(f)


def _runs(tasks: DataFrame, folder: str) -> list[int]:
    context = tasks.sparkSession.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/answers")
    files = root.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [f.getPath().getName() for f in files.listStatus(root)]
    return [int(n[4:]) for n in names if n.startswith("run=")]


def _latest(tasks: DataFrame, folder: str) -> DataFrame:
    """The result that counts of each task: one that succeeded, if there is one, else that of the last run."""
    names = ("success", *_RESULT_COLUMNS)
    kept = F.max_by(F.struct(*names), F.struct("success", "run")).alias("r")
    return saved_answers(tasks, folder).groupBy("task_id").agg(kept).select("task_id", *(F.col(f"r.{c}").alias(c) for c in names))


def run_saved(
    tasks: DataFrame,
    factory: GenerateFactory | Batched,
    folder: str,
    parts: DataFrame | None = None,
    multistep: bool = False,
    window: int = 1,
    save_rows: int = 64,
    save_seconds: float = 5.0,
) -> DataFrame:
    """Run what ``folder`` has no successful result for; the results of all ``tasks``, one each.

    Results are written as they come: after ``save_rows`` of them, or when one comes more than ``save_seconds`` after the last
    writing. A run that ends early, or a Spark task that is repeated, leaves them there; the next one asks only for the
    rest, so that at most the calls since the last writing of a lost executor are made twice. Failed tasks are asked
    again; of a task of several steps only those from the failed step on. A Spark task that comes to its end puts its results into
    one file. ``folder`` is shared by driver and executors and belongs to these tasks, prompts and
    this kind of run, one run at a time; ``task_id`` must be unique and not null.
    """
    make = _stepwise if multistep else _single
    schema = _schema(tasks)
    number = max(_runs(tasks, folder), default=0) + 1
    target = f"{folder}/answers/run={number}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = place(target)
        fs.create_dir(base)
        mine = f"part-{TaskContext.get().partitionId()}-"
        earlier = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(base)) if f.base_name.startswith(mine)]
        answered = {k for f in earlier for k in pyarrow.parquet.read_table(f, filesystem=fs, columns=["task_id"], partitioning=None)["task_id"].to_pylist()}
        told = _told(_rows(batches), window, answered)
        held: list[dict] = []
        written: list[str] = []

        def save() -> None:
            if held:
                name = f"{mine}{TaskContext.get().taskAttemptId()}-{len(written)}.parquet"
                # Whole files only: a name that begins with an underscore is not read.
                pyarrow.parquet.write_table(pa.Table.from_pylist(held, schema), f"{base}/_{name}", filesystem=fs)
                fs.move(f"{base}/_{name}", f"{base}/{name}")
                held.clear()
                written.append(f"{base}/{name}")

        last = time.monotonic()
        try:
            for result in _results(factory, told, make, window):
                held.append(result)
                if len(held) >= save_rows or time.monotonic() - last > save_seconds:
                    save()
                    last = time.monotonic()
        finally:
            save()
        _gather(earlier + written, f"{base}/{mine}{TaskContext.get().taskAttemptId()}{GATHERED}", schema, fs)
        yield from ()

    before = _latest(tasks, folder).select("task_id", F.col("success").alias("__success"), F.col("metadata.steps").alias("steps_done"))
    left = tasks.drop("steps_done").join(before, "task_id", "left").where(~F.coalesce("__success", F.lit(False))).drop("__success")
    _neighbours(left, parts).mapInArrow(work, "n int").write.format("noop").mode("overwrite").save()
    return tasks.select("task_id").join(_latest(tasks, folder), "task_id")


def result_json() -> Column:
    """A result row as JSON, with nulls written out."""
    return F.to_json(F.struct(*_RESULT_TYPES), {"ignoreNullFields": "false"})
