"""What of a result is shown to whom. The reviewer's views hold no raw value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def public_entities(entities: Column, with_score: bool = False) -> Column:
    """Entities without their values; scores rounded to three places."""
    names = ["label", "category", "token", "start", "end"]
    return F.transform(entities, lambda e: F.struct(*(e[n].alias(n) for n in names), *([F.bround(e["score"], 3).alias("score")] if with_score else [])))


def full(df: DataFrame, *keys: str, include_entities: bool = True, include_token_map: bool = False, with_score: bool = False) -> DataFrame:
    """redacted_text, entity_count, categories_found; entities (without values) and token_map (raw values!) if asked for."""
    more = [public_entities(F.col("entities"), with_score).alias("entities")] if include_entities else []
    return df.select(*keys, "redacted_text", "entity_count", "categories_found", *more, *(["token_map"] if include_token_map else []))


def reviewer(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "redacted_text", "entity_count", "categories_found")


def shortened(text: Column, length: int = 120) -> Column:
    return F.substring(text, 1, length)


def validated(df: DataFrame, text: str = "text", longest: int = 500_000, language: str | None = None, most_bytes: int = 1 << 20) -> DataFrame:
    """Adds status (200 or 422) and strips the text, after its length was checked. A null text is not valid."""
    size = F.length(text)
    ok = F.col(text).isNotNull() & size.between(1, longest) & (F.octet_length(text) <= most_bytes)
    if language is not None:
        ok = ok & F.coalesce(F.col(language).rlike("^[a-z]{2}$"), F.lit(False))
    return df.withColumn("status", F.when(ok, F.lit(200)).otherwise(F.lit(422))).withColumn(text, F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", ""))


def validated_batches(df: DataFrame, texts: str = "texts", most: int = 500, longest: int = 500_000) -> DataFrame:
    """Adds status (200 or 422) of requests with an array of texts: 1 to `most` texts, each of 1 to `longest` characters."""
    sizes = F.coalesce(F.size(texts), F.lit(0))
    ok = sizes.between(1, most) & F.forall(texts, lambda t: F.coalesce(F.length(t).between(1, longest), F.lit(False)))
    return df.withColumn("status", F.when(F.coalesce(ok, F.lit(False)), F.lit(200)).otherwise(F.lit(422)))


def sampled(df: DataFrame, key: str, percent: int = 5) -> DataFrame:
    """The same `percent` of keys in every run and in every engine: by the first 32 bits of the key's md5."""
    return df.filter(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 100 < percent)
