import json

import pytest
from pyspark.sql import functions as F

from docwarden.functions.templates import TEMPLATES, render
from docwarden.operators import models as MO
from docwarden.operators import tasks as TA
from docwarden.operators.run import result_json, run_batch, run_multistep, run_tasks
from docwarden.plans.screening import process_tasks

TASK = "task_id long, action string, prompt string, output_format string, additional_context string, session_id string, boundary_token string"
LINK = "task_id long, doc_index int, doc_id long"
DOCS = "doc_id long, doc_type string, text string, uri string, content binary, source string"


def tasks_df(spark, rows):
    return spark.createDataFrame([tuple(r) + (None,) * (7 - len(r)) for r in rows], TASK)


def test_identity_and_missing_documents(spark):
    tasks = tasks_df(spark, [(1, "ocr"), (2, "ocr", None, None, None, "mine", "token")])
    links = spark.createDataFrame([(1, 0, 5), (1, 1, 6)], LINK)
    a, b = TA.make_tasks(tasks, links, "s").orderBy("task_id").collect()
    assert len(a.session_id) == 16 and len(a.boundary_token) == 32 and a.document_count == 2 and a.task_error is None
    assert (b.session_id, b.boundary_token, b.document_count) == ("mine", "token", 0)
    assert b.task_error == "At least one document is required"
    again = TA.make_tasks(tasks, links, "s").orderBy("task_id").first()
    other = TA.make_tasks(tasks, links, "t").orderBy("task_id").first()
    assert again.boundary_token == a.boundary_token != other.boundary_token


def test_prompts(spark):
    rows = [
        (1, "summarize", None, None, "a {brace} $1", None, "tok"), (2, "convert_format", "more", "json", None, None, None),
        (3, "custom", "", "", "do it", None, "b"),
    ]
    out = {r.task_id: r.full_prompt for r in TA.render_prompt(tasks_df(spark, rows)).collect()}
    assert out[1] == TEMPLATES["summarize"].format(boundary_token="tok", additional_context="a {brace} $1", output_format="markdown")
    assert out[2] == "\nTask: convert_format\n\n\n\nPlease provide the output in json format. \n\n\nAdditional instructions:  more"
    assert out[3] == TEMPLATES["custom"].format(boundary_token="b", additional_context="do it", output_format="markdown")
    plain = {r.task_id: r.full_prompt for r in TA.render_prompt(tasks_df(spark, rows), None).collect()}
    assert plain[1].startswith("\nTask: summarize\n\na {brace} $1\n")
    own = TA.render_prompt(tasks_df(spark, rows), {"custom": "{{x}} {additional_context}"}).where("task_id = 3").first()
    assert own.full_prompt == "{x} do it"
    with pytest.raises(KeyError):
        render("{unknown}", known=F.lit(1))
    sp = TA.system_prompt(tasks_df(spark, [(1, "ocr", None, None, None, "sess", "tok")]), F.lit(True)).first().system_prompt
    assert "SESSION_ID: sess\n" in sp and "<|DOC_BOUNDARY_tok|>" in sp and "sensitive" in sp
    fmt = TA.with_output_format(tasks_df(spark, rows)).orderBy("task_id").collect()
    assert [r.format_instruction is not None for r in fmt] == [True, True, True]


def test_task_rules(spark):
    n_docs = {1: 1, 2: 2, 3: 10, 4: 11, 5: 1, 6: 1, 7: 1, 8: 0}
    tasks = tasks_df(
        spark,
        [(i, "compare") for i in (1, 2, 3, 4)]
        + [(5, "translate"), (6, "ocr"), (7, "extract_tables", None, None, None, None, None), (8, "nonsense")],
    )
    links = [(t, i, t * 100 + i, "text/csv" if t == 6 else "text/plain", 60_000 if t == 7 else 10) for t, n in n_docs.items() for i in range(n)]
    docs = spark.createDataFrame(links, LINK + ", doc_type string, tokens long")
    out = {r.task_id: r for r in TA.validate_tasks(tasks, docs).collect()}
    assert out[1].errors == ["At least 2 documents are required"] and out[2].is_valid and out[3].is_valid
    assert out[4].errors == ["At most 10 documents are allowed"]
    assert out[5].errors == ["Additional context is required"]
    assert out[6].errors == ["Document types not accepted: csv"]
    assert out[7].errors == ["Input tokens (60000) exceed limit (50000)"] and out[7].suggested_output == "json"
    assert out[8].errors == ["At least one document is required", "Unknown action 'nonsense'"]


def test_parameters(spark):
    cases = [("0.5", "100", "JSON"), ("2", "65536", "text"), ("2.01", "0", "xml"), ("hot", "12.5", None), (None, None, None), ("NaN", "65537", "csv")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, temperature string, max_output_tokens string, output_format string")
    out = TA.sanitize_parameters(df).orderBy("id").collect()
    t, m = "Temperature must be a number between 0 and 2", "max_output_tokens must be between 1 and 65536"
    assert [r.errors for r in out] == [[], [], [t, m], [t, m], [], [t, m]]
    assert [r.sanitized_output_format for r in out] == ["json", "text", "text", None, None, "csv"]
    assert out[2].warnings == ["Unknown output format 'xml', using 'text'"] and out[2].sanitized_temperature == 2.01
    typed = spark.createDataFrame([(1.0, 5.0, "json")], "temperature double, max_output_tokens double, output_format string")
    assert TA.sanitize_parameters(typed).first().errors == [m]


def test_model_tables(spark):
    tasks = spark.createDataFrame([("qa",), ("question_answer",), ("ocr",), ("extract_data",), (None,)], "task string")
    conf = {r.task: r for r in MO.model_config_for_task(tasks).collect()}
    assert (conf["qa"].temperature, conf["qa"].max_output_tokens) == (conf["question_answer"].temperature, 2048) == (0.3, 2048)
    assert conf["extract_data"].model == "gemini-2.5-pro" and (conf["ocr"].temperature, conf[None].top_k) == (0.7, 40)
    assert "BroadcastHashJoin" in MO.model_config_for_task(tasks)._jdf.queryExecution().executedPlan().toString()
    pre = spark.createDataFrame([("conservative",), ("creative",), ("balanced",), ("wild",)], "preset string")
    got = {r.preset: (r.temperature, r.max_output_tokens, r.top_k) for r in MO.config_from_preset(pre).collect()}
    assert got == {"conservative": (0.2, 4096, 40), "creative": (1.2, 8192, 40), "balanced": (0.7, 8192, 40), "wild": (None, None, None)}
    bad = spark.createDataFrame([(2.1, 0, -0.1, 0), (2.0, 1, 1.0, 1)], "temperature double, max_output_tokens int, top_p double, top_k int")
    errs = [r.config_errors for r in MO.config_errors(bad).collect()]
    assert len(errs[0]) == 4 and errs[1] == []
    with_stops = bad.withColumn("s", F.array(F.lit("END")))
    js = [json.loads(r[0]) for r in with_stops.select(MO.generation_config(F.col("s"))).collect()]
    assert js[1] == {"temperature": 2.0, "max_output_tokens": 1, "top_p": 1.0, "top_k": 1, "stop_sequences": ["END"]}
    assert "stop_sequences" not in bad.select(MO.generation_config()).first()[0]
    names = spark.createDataFrame([("gemini-2.5-flash",), ("gemini-pro",), ("gemini-ultra",), ("other",)], "model_name string")
    look = {r.model_name: (r.model, r.is_flash, r.is_pro, r.is_latest_of_tier) for r in MO.lookup_models(names).collect()}
    assert look["gemini-2.5-flash"] == ("gemini-2.5-flash", True, False, True) and look["other"] == (None, False, False, False)
    assert look["gemini-pro"] == ("gemini-pro", False, True, False) and look["gemini-ultra"][1:] == (False, False, False)
    code = {r.model_name: r.cost_tier for r in MO.with_capabilities(names, "model_name").collect()}
    conf = {r.model_name: r.cost_tier for r in MO.with_capabilities(names, "model_name", "config").collect()}
    assert (code["gemini-ultra"], conf["gemini-ultra"], code["other"]) == ("medium", "high", "medium")


def sample(spark):
    docs = spark.createDataFrame(
        [(1, "text/plain", "one", None, None, "text"), (2, "text/html", None, "http://x", None, "http://x"),
         (3, "image/png", None, None, bytearray(b"\x89PNG"), "/f.png"), (4, "text/plain", None, None, None, None)], DOCS)
    links = spark.createDataFrame([(10, 2, 1), (10, 1, 2), (10, 3, 3), (10, 4, 4)] + [(11, i, 1) for i in range(21)] + [(13, 0, 1), (14, 0, 1), (14, 1, 99)], LINK)
    tasks = tasks_df(spark, [(10, "ocr"), (11, "ocr"), (12, "ocr"), (13, "analyze", None, None, "fail"), (14, "ocr")])
    return tasks, links, docs


def test_parts_and_missing_documents(spark):
    tasks, links, docs = sample(spark)
    parts = TA.task_parts(links, docs).where("task_id = 10").orderBy("doc_index").collect()
    assert [(p.part_kind, p.uri, p.text) for p in parts] == [("url", "http://x", None), ("text", None, "one"), ("bytes", "/f.png", None), (None, None, None)]
    assert bytes(parts[2].content) == b"\x89PNG" and parts[2].mime == "image/png"
    out = {r.task_id: r for r in TA.assemble_tasks(tasks, links, docs).collect()}
    assert (out[10].n_documents, out[10].task_error) == (4, None)
    assert (out[11].n_documents, out[11].task_error) == (21, None)
    assert out[12].task_error == "At least one document is required"
    assert out[14].task_error == "Documents not found: 1"


def echo():
    def generate(task):
        if "fail" in task["prompt"] and "synthesize" in task["prompt"]:
            raise RuntimeError("boom")
        if "fail" in task["prompt"] and "Step:" not in task["prompt"]:
            raise RuntimeError("boom")
        once, again = [p["doc_id"] for p in task["parts"]], list(task["parts"])
        assert once == [p["doc_id"] for p in again]
        assert all(p["part_kind"] != "bytes" or p["content"] == b"\x89PNG" for p in again)
        return f"{len(once)} parts, ssn 123-45-6789", 7

    return generate


def test_runs(spark):
    tasks, links, docs = sample(spark)
    ready = TA.make_tasks(TA.assemble_tasks(tasks, links, docs), None, "s")
    ready, parts = TA.render_prompt(ready, None).withColumn("model", F.lit("m")), TA.task_parts(links, docs)
    out = {r.task_id: r for r in run_tasks(ready, echo, parts).collect()}
    assert out[10].success and out[10].content.startswith("3 parts") and out[10].tokens_used == 7
    assert out[10].metadata.document_count == 4 and len(out[10].metadata.session_id) == 16
    assert out[11].success and out[11].content.startswith("21 parts")
    assert not out[14].success and out[14].error == "Documents not found: 1"
    assert (out[13].success, out[13].content, out[13].error, out[13].metadata.session_id) == (False, None, "boom", None)
    multi = {r.task_id: r for r in run_multistep(ready, echo, parts).collect()}
    assert multi[10].success and [s.step for s in multi[10].metadata.steps] == ["analyze", "extract", "synthesize"]
    assert not multi[13].success and multi[13].metadata.steps[-1].error == "boom" and multi[13].content is None
    named = run_batch(ready, echo, {"quiet": lambda: lambda t: "q"}, "quiet", parts).where("task_id = 10").first()
    assert named.content == "q"
    assert run_batch(ready, echo, {}, "nobody", parts).where("task_id = 10").first().content.startswith("3 parts")
    js = json.loads(run_tasks(ready, echo, parts).where("task_id = 13").select(result_json()).first()[0])
    assert js["content"] is None and js["error"] == "boom" and js["metadata"]["action"] == "analyze"
    flow = {r.task_id: r for r in process_tasks(tasks.withColumn("model", F.lit("m")), links, docs, echo, "s").collect()}
    assert flow[10].content == "3 parts, ssn [SSN REDACTED]" and flow[10].output_was_modified
