"""Small fixed tables (models, presets, actions, formats) as DataFrames of known size.

Each has at most a dozen rows and is joined with a broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.mime import MIME_FAMILY

# Model identifiers with tier and place in the tier (1 = latest). Tier lists leave out
# models that no list names.
MODELS = (
    ("gemini-2.5-flash", "flash", 1),
    ("gemini-2.0-flash", "flash", 2),
    ("gemini-1.5-flash", "flash", 3),
    ("gemini-2.5-pro", "pro", 1),
    ("gemini-1.5-pro", "pro", 2),
    ("gemini-pro", "pro", 3),
    ("gemini-3.0-pro", "pro", 4),
    ("gemini-ultra", None, None),
    ("gemini-pro-vision", None, None),
)

# Context window, output limit and cost tier. Two sources disagree, so both are kept;
# every model sees, hears and watches in both.
CAPABILITIES_CODE = (
    ("gemini-2.5-flash", 1_000_000, 8192, "low"),
    ("gemini-2.5-pro", 2_000_000, 16384, "medium"),
    ("gemini-1.5-pro", 2_000_000, 8192, "medium"),
)
CAPABILITIES_CONFIG = (
    ("gemini-2.5-flash", 1_000_000, 8192, "low"),
    ("gemini-2.0-flash", 1_000_000, 8192, "low"),
    ("gemini-1.5-flash", 1_000_000, 8192, "low"),
    ("gemini-2.5-pro", 2_000_000, 16384, "medium"),
    ("gemini-1.5-pro", 2_000_000, 8192, "medium"),
    ("gemini-3.0-pro", 2_000_000, 32768, "medium"),
    ("gemini-ultra", 2_000_000, 32768, "high"),
)
DEFAULT_CAPABILITIES = (1_000_000, 8192, "medium")

# Default generation settings, per-task settings and presets.
DEFAULT_CONFIG = ("gemini-2.5-flash", 0.7, 8192, 0.95, 40)
TASK_CONFIGS = (
    ("summarize", "gemini-2.5-flash", 0.5, 4096),
    ("extract", "gemini-2.5-pro", 0.2, 8192),
    ("analyze", "gemini-2.5-pro", 0.4, 8192),
    ("qa", "gemini-2.5-flash", 0.3, 2048),
    ("classify", "gemini-2.5-flash", 0.1, 1024),
    ("translate", "gemini-2.5-pro", 0.3, 8192),
    ("compare", "gemini-2.5-pro", 0.3, 8192),
)
# The configuration file spells two of the tasks differently.
TASK_ALIASES = {"extract_data": "extract", "question_answer": "qa"}
PRESETS = (("conservative", 0.2, 4096), ("creative", 1.2, 8192), ("balanced", 0.7, 8192))

# The actions, and the rules declared for some of them: highest input tokens, document
# families accepted, whether context is required, least and most documents, preferred output.
ACTIONS = (
    "summarize",
    "extract_data",
    "analyze",
    "question_answer",
    "translate",
    "classify",
    "compare",
    "convert_format",
    "extract_tables",
    "extract_images",
    "ocr",
    "custom",
)
ACTION_RULES = (
    ("summarize", 100_000, ["pdf", "text", "image"], False, None, None, None),
    ("extract_data", 50_000, ["pdf", "text", "image", "csv", "json"], False, None, None, None),
    ("analyze", 100_000, ["pdf", "text", "image"], False, None, None, None),
    ("question_answer", 100_000, None, True, None, None, None),
    ("classify", 50_000, None, False, None, None, None),
    ("extract_tables", 50_000, None, False, None, None, "json"),
    ("ocr", 100_000, ["image", "pdf"], False, None, None, None),
    ("translate", 100_000, None, True, None, None, None),
    ("compare", 200_000, None, False, 2, 10, None),
    ("custom", 100_000, None, True, None, None, None),
)

# Output formats with what to ask for; the wording is ours.
OUTPUT_FORMATS = (
    ("json", "Answer with one valid JSON value.", "Keep to a JSON schema if the context names one."),
    ("markdown", "Answer in tidy Markdown.", "Structure it with headings, lists and code blocks."),
    ("text", "Answer in plain text.", "Separate paragraphs by blank lines."),
    ("csv", "Answer as CSV with a header row.", "Separate by commas and quote fields that hold one."),
    ("html", "Answer as valid HTML.", "Choose elements by meaning."),
)


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODELS), "model string, tier string, tier_rank int")


def model_capabilities(spark: SparkSession, source: str = "code") -> DataFrame:
    table = {"code": CAPABILITIES_CODE, "config": CAPABILITIES_CONFIG}[source]
    return spark.createDataFrame(
        list(table), "model string, context_window int, max_output_tokens int, cost_tier string"
    )


def task_configs(spark: SparkSession) -> DataFrame:
    """Per-task settings under both spellings of a task."""
    rows = list(TASK_CONFIGS)
    known = {r[0]: r for r in rows}
    rows += [(alias, *known[name][1:]) for alias, name in TASK_ALIASES.items()]
    return spark.createDataFrame(rows, "task string, model string, temperature double, max_output_tokens int")


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRESETS), "preset string, temperature double, max_output_tokens int")


def action_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(ACTION_RULES),
        "action string, max_input_tokens bigint, required_families array<string>, requires_context boolean,"
        " min_documents int, max_documents int, preferred_output string",
    )


def output_formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(OUTPUT_FORMATS), "output_format string, instruction string, schema_hint string"
    )


def mime_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MIME_FAMILY.items()), "mime string, family string")
