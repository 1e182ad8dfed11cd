"""Document tasks: identity, prompts, parameter checks, rules and the documents that belong to a task.

Tables: ``tasks(task_id, action, prompt, output_format, additional_context, session_id,
boundary_token)`` and ``task_documents(task_id, doc_index, doc_id)``. A task may hold any number of
documents, so counts and sums are combined on the map side and documents are never gathered per task:
they stay rows, which a task's run streams through the model function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mime import mime_family
from ..functions.templates import (
    DEFAULT_PROMPT,
    RESTRICTED_PROMPT,
    SYSTEM_PROMPT,
    TEMPLATES,
    render,
)
from ..sources import dimensions as D

_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def make_tasks(tasks: DataFrame, task_documents: DataFrame | None, salt: str) -> DataFrame:
    """Fill missing session ids (16 hex digits) and boundary tokens (32), add ``document_count`` and
    ``task_error``; a task without documents is an error.

    Tokens are derived from the task and a secret ``salt``, so a retried task keeps its own. Without
    ``task_documents``, tasks already have ``n_documents`` and ``task_error``, as ``assemble_tasks`` adds them.
    """

    def derived(tag: str, digits: int) -> Column:
        seed = F.concat_ws("|", F.col("task_id").cast("string"), F.lit(salt), F.lit(tag))
        return F.substring(F.sha2(seed, 256), 1, digits)

    tokens = {
        "session_id": F.coalesce("session_id", derived("session", 16)),
        "boundary_token": F.coalesce("boundary_token", derived("boundary", 32)),
    }
    if task_documents is None:
        return tasks.withColumns(tokens | {"document_count": F.col("n_documents")})
    counts = task_documents.groupBy("task_id").agg(F.count(F.lit(1)).alias("document_count"))
    joined = tasks.join(counts, "task_id", "left")
    return joined.withColumns(
        tokens
        | {
            "document_count": F.coalesce("document_count", F.lit(0).cast("bigint")),
            "task_error": F.when(
                F.col("document_count").isNull(), F.lit("At least one document is required")
            ),
        }
    )


def _or(name: str, fallback: str) -> Column:
    """Python's ``value or fallback``."""
    return F.when(F.length(name) > 0, F.col(name)).otherwise(F.lit(fallback))


def render_prompt(
    tasks: DataFrame, templates: dict[str, str] | None = TEMPLATES, out: str = "full_prompt"
) -> DataFrame:
    """Add the prompt of each task: the action's template, or the default prompt for actions without one
    (for all actions if ``templates`` is None), then the extra instruction if the task has one."""
    values = {
        "boundary_token": _or("boundary_token", ""),
        "additional_context": _or("additional_context", ""),
        "output_format": _or("output_format", "markdown"),
    }
    prompt = render(DEFAULT_PROMPT, action=F.col("action"), **values)
    for action, template in (templates or {}).items():
        prompt = F.when(F.col("action") == action, render(template, **values)).otherwise(prompt)
    extra = F.when(
        F.length("prompt") > 0,
        F.concat(F.lit("\n\nAdditional instructions:  "), F.col("prompt")),
    ).otherwise(F.lit(""))
    return tasks.withColumn(out, F.concat(prompt, extra))


def system_prompt(tasks: DataFrame, restricted: Column | None = None) -> DataFrame:
    """Add ``system_prompt``; where ``restricted`` holds, the rules for sensitive documents follow."""
    base = render(
        SYSTEM_PROMPT, session_id=_or("session_id", ""), boundary_token=_or("boundary_token", "")
    )
    if restricted is not None:
        base = F.concat(
            base, F.when(restricted, F.lit("\n" + RESTRICTED_PROMPT)).otherwise(F.lit(""))
        )
    return tasks.withColumn("system_prompt", base)


def with_output_format(tasks: DataFrame) -> DataFrame:
    """Add ``format_instruction`` and ``format_hint`` of the task's output format."""
    table = D.output_formats(tasks.sparkSession).select(
        F.col("output_format").alias("__format"),
        F.col("instruction").alias("format_instruction"),
        F.col("schema_hint").alias("format_hint"),
    )
    wanted = _or("output_format", "markdown")
    return tasks.join(F.broadcast(table), wanted == F.col("__format"), "left").drop("__format")


def estimated_tokens(text: Column) -> Column:
    """A rough token count, four characters each; ours."""
    return F.ceil(F.length(text) / 4)


def validate_tasks(tasks: DataFrame, task_documents: DataFrame) -> DataFrame:
    """Check tasks against the rules declared for their action; add ``n_documents``, ``input_tokens``,
    ``errors``, ``suggested_output`` and ``is_valid``. The messages are ours.

    ``task_documents`` carries ``doc_type`` and ``tokens`` of each document. Per task only a count, a sum
    and the set of families (eight values at most) are kept, combined before the shuffle.
    """
    facts = task_documents.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.sum("tokens").alias("input_tokens"),
        F.collect_set(F.coalesce(mime_family(F.col("doc_type")), F.lit("other"))).alias("__families"),
    )
    rules = D.action_rules(tasks.sparkSession).withColumnRenamed("action", "__action")
    joined = (
        tasks.join(facts, "task_id", "left")
        .join(F.broadcast(rules), F.col("action") == F.col("__action"), "left")
        .withColumns(
            {
                "n_documents": F.coalesce("n_documents", F.lit(0).cast("bigint")),
                "input_tokens": F.coalesce("input_tokens", F.lit(0).cast("bigint")),
            }
        )
    )
    n, tokens = F.col("n_documents"), F.col("input_tokens")
    foreign = F.array_sort(F.array_except("__families", "required_families"))

    def message(*parts: str | Column) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    errors = F.array(
        F.when(n == 0, F.lit("At least one document is required")),
        F.when(
            ~F.col("action").isin(*D.ACTIONS), message("Unknown action '", F.col("action"), "'")
        ),
        F.when(
            tokens > F.col("max_input_tokens"),
            message(
                "Input tokens (", tokens.cast("string"), ") exceed limit (",
                F.col("max_input_tokens").cast("string"), ")",
            ),
        ),
        F.when(
            F.size(foreign) > 0,
            message("Document types not accepted: ", F.array_join(foreign, ", ")),
        ),
        F.when(
            F.col("requires_context") & (F.coalesce(F.length("additional_context"), F.lit(0)) == 0),
            F.lit("Additional context is required"),
        ),
        F.when(
            n < F.col("min_documents"),
            message("At least ", F.col("min_documents").cast("string"), " documents are required"),
        ),
        F.when(
            n > F.col("max_documents"),
            message("At most ", F.col("max_documents").cast("string"), " documents are allowed"),
        ),
    )
    return (
        joined.withColumn("errors", F.array_compact(errors))
        .withColumn("is_valid", F.size("errors") == 0)
        .withColumnRenamed("preferred_output", "suggested_output")
        .drop(
            "__families", "__action", "max_input_tokens", "required_families", "requires_context",
            "min_documents", "max_documents",
        )
    )


def sanitize_parameters(df: DataFrame) -> DataFrame:
    """Check ``temperature``, ``max_output_tokens`` and ``output_format`` where not null; other columns
    pass through. Adds ``sanitized_*``, ``errors``, ``warnings`` and ``is_valid``.

    A string column may hold any parameter; text that reads as a number counts as one. Fractional columns
    are no integers. A rejected number is passed on, as well as being an error.
    """
    # Booleans count as the integers 0 and 1.
    flags = {c: F.col(c).cast("int") for c in ("temperature", "max_output_tokens") if dict(df.dtypes)[c] == "boolean"}
    df = df.withColumns(flags) if flags else df
    types = dict(df.dtypes)
    text_t = F.col("temperature").cast("string")
    temperature = text_t.try_cast("double")
    temperature_ok = F.coalesce(temperature.between(0.0, 2.0), F.lit(False))
    whole = types["max_output_tokens"] in (*_INTEGRAL, "string")
    tokens = (F.col("max_output_tokens") if whole else F.lit(None)).try_cast("bigint")
    tokens_ok = F.coalesce(tokens.between(1, 65536), F.lit(False))
    fmt = F.lower("output_format")
    known = fmt.isin(*[f[0] for f in D.OUTPUT_FORMATS])
    return df.withColumns(
        {
            "sanitized_temperature": temperature,
            "sanitized_max_output_tokens": tokens,
            "sanitized_output_format": F.when(known, fmt).when(fmt.isNotNull(), F.lit("text")),
            "errors": F.array_compact(
                F.array(
                    F.when(
                        F.col("temperature").isNotNull() & ~temperature_ok,
                        F.lit("Temperature must be a number between 0 and 2"),
                    ),
                    F.when(
                        F.col("max_output_tokens").isNotNull() & ~tokens_ok,
                        F.lit("max_output_tokens must be between 1 and 65536"),
                    ),
                )
            ),
            "warnings": F.array_compact(
                F.array(
                    F.when(
                        ~known,
                        F.concat(
                            F.lit("Unknown output format '"), fmt, F.lit("', using 'text'")
                        ),
                    )
                )
            ),
        }
    ).withColumn("is_valid", F.size("errors") == 0)


def task_parts(task_documents: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per document of a task: ``part_kind`` (bytes, url, text), ``mime`` and the text, the address or the bytes.

    Of documents from ``store_contents`` the rows carry ``content_ref`` and ``text_ref`` instead; a task opens them when they are read.

    Documents with neither content nor text nor address, and links to documents that are not there, have a null
    ``part_kind``; the latter also a null ``found``. A document shared by very many tasks makes one key of this join
    hot; the document side has one row per key, so Spark's skew join splits the other side.
    """
    content, text = (f"{c}_ref" if f"{c}_ref" in documents.columns else c for c in ("content", "text"))
    is_bytes, is_url = F.col(content).isNotNull(), F.col("uri").isNotNull()
    kind = (
        F.when(is_bytes, F.lit("bytes"))
        .when(is_url, F.lit("url"))
        .when(F.col(text).isNotNull(), F.lit("text"))
    )
    facts = documents.select(
        "doc_id",
        F.col("doc_type").alias("mime"),
        text,
        F.when(is_bytes, F.col("source")).otherwise(F.col("uri")).alias("uri"),
        content,
        kind.alias("part_kind"),
        F.lit(True).alias("found"),
    )
    return task_documents.join(facts, "doc_id", "left").select(
        "task_id", "doc_index", "doc_id", "part_kind", "mime", text, "uri", content, "found"
    )


def assemble_tasks(tasks: DataFrame, task_documents: DataFrame, documents: DataFrame) -> DataFrame:
    """Add ``n_documents`` and ``task_error``: a task needs a document, and all of its documents must be there.

    Only keys are joined and only counts shuffled on; texts and bytes follow as rows of ``task_parts`` when tasks run. A task
    may have any number of documents; whoever wants the limit of a request validates first.
    """
    known = documents.select("doc_id", F.lit(True).alias("__found"))
    counts = (
        task_documents.join(known, "doc_id", "left")
        .groupBy("task_id")
        .agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("__found").isNull()).alias("__missing"))
    )
    n = F.coalesce("n_documents", F.lit(0).cast("bigint"))
    error = F.when(n == 0, F.lit("At least one document is required")).when(
        F.col("__missing") > 0, F.concat(F.lit("Documents not found: "), F.col("__missing").cast("string"))
    )
    return (
        tasks.drop("task_error", "n_documents")
        .join(counts, "task_id", "left")
        .withColumns({"task_error": error, "n_documents": n})
        .drop("__missing")
    )
