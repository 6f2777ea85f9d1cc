"""JSON of any shape, redacted as it is written: string values go, all else stays to the sign.

No schema is inferred and nothing is coerced: a text is cut into its string literals and what stands between them; a
literal with a colon behind it is a name. String values become rows, are redacted as texts and are put back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstone.operators.redact import Options, redact

_LITERAL = r'"(?:[^"\\]|\\.)*+"'


def _parts(json: Column) -> tuple[Column, Column]:
    """The literals of a JSON text, and what stands before, between and behind them."""
    return F.regexp_extract_all(json, F.lit(_LITERAL), F.lit(0)), F.split(json, _LITERAL, -1)


def _value(literal: Column) -> Column:
    """The text that a literal stands for."""
    return F.get_json_object(F.concat(F.lit('{"v":'), literal, F.lit("}")), "$.v")


def _literal(value: Column) -> Column:
    written = F.to_json(F.struct(value.alias("v")))
    return F.substring(written, 6, F.length(written) - 6)


def string_leaves(df: DataFrame, key: str, json: str) -> DataFrame:
    """key, at (the literal's number in its text) and value of each string value; a text that is no JSON has none."""
    literals, gaps = _parts(F.col(json))
    told = F.transform(literals, lambda x, i: F.struct(i.alias("at"), x.alias("literal"), F.get(F.col("_gaps"), i + 1).rlike(r"^\s*:").alias("named")))
    rows = df.filter(is_json(F.col(json))).select(key, json, gaps.alias("_gaps")).select(key, F.inline_outer(told)).filter("at is not null and not named")
    return rows.select(key, "at", _value(F.col("literal")).alias("value"))


def is_json(json: Column) -> Column:
    return F.try_parse_json(json).isNotNull()


def redact_json(df: DataFrame, key: str, json: str, options: Options | None = None) -> DataFrame:
    """`df` with the column `json` redacted value by value, each string a text of its own. `key` has to be unique and not null.

    What is no JSON is redacted as one text; a null stays null. A value in which nothing is found keeps its literal as it
    was written. Only values that change are gathered by key, so texts without any are not touched.
    """
    done = redact(string_leaves(df, key, json), "value", options).filter("entity_count > 0")
    changed = done.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("at"), _literal(F.col("redacted_text"))))).alias("_new"), F.sum("entity_count").alias("_n"))
    broken = redact(df.filter(~is_json(F.col(json))).select(key, F.col(json).alias("_json")), "_json", options).select(key, F.col("redacted_text").alias("_plain"), F.col("entity_count").cast("long").alias("_m"))
    literals, gaps = _parts(F.col(json))
    put = F.transform(F.col("_literals"), lambda x, i: F.concat(F.coalesce(F.element_at("_new", i), x), F.get("_gaps", i + 1)))
    rows = df.withColumns({"_literals": literals, "_gaps": gaps}).join(changed, key, "left").join(broken, key, "left")
    text = F.when(F.col("_plain").isNotNull(), F.col("_plain")).when(F.col("_new").isNull(), F.col(json)).otherwise(F.concat(F.get("_gaps", F.lit(0)), F.array_join(put, "")))
    return rows.select(*(text.alias(c) if c == json else F.col(c) for c in df.columns), F.coalesce("_n", "_m", F.lit(0)).cast("long").alias("entity_count"))
