"""Prompt and response samples, redacted together so that tokens agree; and the chained profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstone.functions.registry import Registry, chained_registry, rule_registry
from veilstone.functions.spans import candidates
from veilstone.operators import tokens
from veilstone.operators.redact import Options, resolved


def redact_samples(samples: DataFrame, options: Options | None = None) -> DataFrame:
    """sample_id, redacted_prompt, redacted_response, prompt_entities, response_entities, token_map, total_entities.

    The rule profile numbers prompt and response as one scope, prompt first; the scored profile numbers each apart. An
    empty response counts as none. Columns of `samples` other than prompt and response are carried along.
    """
    options = options or Options()
    rest = [c for c in samples.columns if c not in ("prompt", "response")]
    prompt, response = F.col("prompt"), F.col("_response")
    rows = samples.withColumn("_response", F.when(F.col("response") != "", F.col("response")))
    rows = rows.withColumns({"_lp": F.lower(prompt), "_lr": F.lower(response)})
    registry = options.detectors()
    rows = rows.withColumns({"_fp": candidates("prompt", registry, "_lp", options.nearness()), "_fr": candidates("_response", registry, "_lr", options.nearness())})
    rows = rows.withColumns({"_sp": resolved(prompt, F.col("_fp"), options), "_sr": resolved(response, F.col("_fr"), options)})
    if options.profile == "scored":
        rows = rows.withColumns({"prompt_entities": tokens.numbered(F.col("_sp"), options.consistent, True), "response_entities": tokens.numbered(F.col("_sr"), options.consistent, True)})
    else:
        rows = rows.withColumn("_both", tokens.numbered(F.concat("_sp", "_sr"), options.consistent))
        rows = rows.withColumns({"prompt_entities": F.slice("_both", 1, F.size("_sp")), "response_entities": F.slice("_both", F.size("_sp") + 1, F.size("_sr"))})
    return rows.select(
        *rest,
        tokens.rewritten(prompt, F.col("prompt_entities")).alias("redacted_prompt"),
        tokens.rewritten(response, F.col("response_entities")).alias("redacted_response"),
        "prompt_entities",
        "response_entities",
        tokens.token_map(F.concat("prompt_entities", "response_entities")).alias("token_map"),
        (F.size("prompt_entities") + F.size("response_entities")).alias("total_entities"),
    )


def reviewer_samples(redacted: DataFrame) -> DataFrame:
    """sample_id, prompt, response and metadata, without anything raw: the default public view."""
    more = ["metadata"] if "metadata" in redacted.columns else []
    return redacted.select("sample_id", F.col("redacted_prompt").alias("prompt"), F.col("redacted_response").alias("response"), *more)


def from_conversations(conversations: DataFrame) -> DataFrame:
    """A sample of each user turn and the assistant turn right behind it, if there is one."""
    user = conversations.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    answer = conversations.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return user.join(answer, ["conv_id", "turn"], "left").select(F.concat_ws("-", "conv_id", "turn").alias("sample_id"), "prompt", "response")


def chain(df: DataFrame, text: str = "text", stages: list[Registry] | None = None, fallback: Registry | None = None) -> DataFrame:
    """Adds redacted_text and stage_counts: each stage scans what the stage before it left, tokens excepted, and numbers
    its entities on from it; `fallback` runs where no stage found anything."""
    stages = stages or [rule_registry(), chained_registry()]
    out, counts = df.withColumn("redacted_text", F.col(text)), []
    for k, registry in enumerate([*stages, *([fallback] if fallback else [])]):
        held = _untokenized(F.col("redacted_text"), candidates("redacted_text", registry))
        if fallback and k == len(stages):
            earlier = sum((F.col(c) for c in counts), F.lit(0))
            held = F.when(earlier == 0, held).otherwise(F.slice(held, 1, 0))
        out = out.withColumn("_found", held).withColumn("_ents", tokens.numbered(resolved(F.col("redacted_text"), F.col("_found"), Options()), False))
        out = out.withColumn("redacted_text", tokens.rewritten(F.col("redacted_text"), F.col("_ents"))).withColumn(f"_n{k}", F.size("_ents")).drop("_found", "_ents")
        counts.append(f"_n{k}")
    return out.withColumn("stage_counts", F.array(*counts)).drop(*counts)


def _untokenized(text: Column, spans: Column) -> Column:
    from veilstone.functions.spans import regex_spans

    made = F.when(F.contains(text, F.lit("[")), regex_spans(text, r"\[[A-Z_]+_\d+\]")).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    return F.filter(spans, lambda s: ~F.exists(made, lambda m: (s["start"] < m["end"]) & (m["start"] < s["end"])))
