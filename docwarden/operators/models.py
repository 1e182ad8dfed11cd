"""Model choice and generation settings as joins with small fixed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import dimensions as D

_CONFIG = ("model", "temperature", "max_output_tokens", "top_p", "top_k")


def model_config_for_task(df: DataFrame, task_col: str = "task") -> DataFrame:
    """Add model, temperature, max_output_tokens, top_p and top_k for a task; defaults for unknown ones."""
    configs = D.task_configs(df.sparkSession).select(
        F.col("task").alias("__task"), *[F.col(c).alias("__" + c) for c in _CONFIG[:3]]
    )
    model, temperature, tokens, top_p, top_k = D.DEFAULT_CONFIG
    joined = df.join(F.broadcast(configs), F.col(task_col) == F.col("__task"), "left")
    return joined.withColumns(
        {
            "model": F.coalesce("__model", F.lit(model)),
            "temperature": F.coalesce("__temperature", F.lit(temperature)),
            "max_output_tokens": F.coalesce("__max_output_tokens", F.lit(tokens)),
            "top_p": F.lit(top_p),
            "top_k": F.lit(top_k),
        }
    ).drop("__task", "__model", "__temperature", "__max_output_tokens")


def config_from_preset(df: DataFrame, preset_col: str = "preset") -> DataFrame:
    """Add the settings of a preset (conservative, creative, balanced); unknown presets get null ones."""
    table = D.presets(df.sparkSession).withColumnRenamed("preset", "__preset")
    model, _, _, top_p, top_k = D.DEFAULT_CONFIG
    joined = df.join(F.broadcast(table), F.col(preset_col) == F.col("__preset"), "left")
    known = F.col("__preset").isNotNull()
    return joined.withColumns(
        {
            "model": F.when(known, F.lit(model)),
            "top_p": F.when(known, F.lit(top_p)),
            "top_k": F.when(known, F.lit(top_k)),
        }
    ).drop("__preset")


def config_errors(df: DataFrame) -> DataFrame:
    """Add ``config_errors``: every setting outside its range."""
    def rule(broken: Column, text: str) -> Column:
        return F.when(F.coalesce(broken, F.lit(True)), F.lit(text))

    return df.withColumn(
        "config_errors",
        F.array_compact(
            F.array(
                rule(~F.col("temperature").between(0.0, 2.0), "Temperature must be between 0.0 and 2.0"),
                rule(F.col("max_output_tokens") < 1, "max_output_tokens must be at least 1"),
                rule(~F.col("top_p").between(0.0, 1.0), "top_p must be between 0.0 and 1.0"),
                rule(F.col("top_k") < 1, "top_k must be at least 1"),
            )
        ),
    )


def generation_config(stop_sequences: Column | None = None) -> Column:
    """Settings as JSON; absent or empty stop sequences are left out."""
    fields = [F.col(c) for c in ("temperature", "max_output_tokens", "top_p", "top_k")]
    if stop_sequences is not None:
        fields.append(F.when(F.size(stop_sequences) > 0, stop_sequences).alias("stop_sequences"))
    return F.to_json(F.struct(*fields))


def lookup_models(df: DataFrame, name_col: str = "model_name") -> DataFrame:
    """Add ``model`` (null if unknown), ``is_flash``, ``is_pro`` and ``is_latest_of_tier``."""
    table = D.models(df.sparkSession)
    joined = df.join(F.broadcast(table), F.col(name_col) == F.col("model"), "left")
    return joined.withColumns(
        {
            "is_flash": F.coalesce(F.col("tier") == "flash", F.lit(False)),
            "is_pro": F.coalesce(F.col("tier") == "pro", F.lit(False)),
            "is_latest_of_tier": F.coalesce(F.col("tier_rank") == 1, F.lit(False)),
        }
    ).drop("tier", "tier_rank")


def with_capabilities(df: DataFrame, model_col: str = "model", source: str = "code") -> DataFrame:
    """Add capabilities; models without an entry get the defaults. ``source`` picks ``code`` or ``config``."""
    table = D.model_capabilities(df.sparkSession, source).select(
        F.col("model").alias("__model"), F.col("context_window").alias("__window"),
        F.col("max_output_tokens").alias("__tokens"), F.col("cost_tier").alias("__cost"),
    )
    window, tokens, cost = D.DEFAULT_CAPABILITIES
    joined = df.join(F.broadcast(table), F.col(model_col) == F.col("__model"), "left")
    return joined.withColumns(
        {
            "context_window": F.coalesce("__window", F.lit(window)),
            "output_token_limit": F.coalesce("__tokens", F.lit(tokens)),
            "supports_vision": F.lit(True),
            "supports_audio": F.lit(True),
            "supports_video": F.lit(True),
            "cost_tier": F.coalesce("__cost", F.lit(cost)),
        }
    ).drop("__model", "__window", "__tokens", "__cost")
