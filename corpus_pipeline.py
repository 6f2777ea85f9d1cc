"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Language ID (rows without a determined language go), line dedup, n-gram Jaccard join (the least id of a group of near
duplicates stays), benchmark decontamination, packing. The stages in front of packing return the columns of documents.

In every stage null ids count as one id that is larger than any other, columns beside those of documents are carried along
whatever their names, rows that are no text of their own (null, empty) are told below, and an empty table gives an empty
table. Nothing is sampled or capped but the labelled rows that the language model is fitted on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstone.llm import decontamination, language_id, line_dedup, ngram_join, packing, store
from veilstone.llm.queries import tokenizer

#: A document is rejected whose language has less than this share of what lies between chance and certainty: of four languages
#: a score under 0.4. On sf0.1 these are 3 of 10,000 documents, texts of 2, 3 and 5 characters, two of them told wrongly.
LEAST_OVER_CHANCE = 0.2


def _begin(spark: SparkSession, scope: str) -> str:
    """A stage's input is written, so the working tables of the stages in front of it have no reader any more."""
    for earlier in ("language", "lines", "near", "leaks", "packing"):
        store.release(spark, f"stage-{earlier}")
    return f"stage-{scope}"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined, repeated rows each. A text that is null, empty or has no letter is rejected; of
    equal scores the first language by name is taken. Without labelled rows nothing is determined and nothing stays."""
    _begin(spark, "language")
    model = language_id.train(docs.select("doc_id", "text", "lang").filter(language_id.fold(F.col("doc_id"), 5) != 0))
    names = {c: c if c in ("doc_id", "text") else f"_c{k}" for k, c in enumerate(docs.columns)}  # clash with nothing
    renamed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    known = language_id.predict(renamed, model, keep_text=True, keep=tuple(n for c, n in names.items() if n != c))
    chance = 1 / max(len(model.langs), 1)
    least = chance + LEAST_OVER_CHANCE * (1 - chance) if chance < 1 else 0.0
    return known.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= least)).select(*(F.col(n).alias(c) for c, n in names.items()))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that occur earlier, by id, then by the text's hash; a document of which no word is
    left goes, so of exact copies the first one stays. Rows equal in id and text are one text and are cut alike; null,
    empty and wordless texts stay as they are."""
    scope = _begin(spark, "lines")
    done = line_dedup.dedup(docs, scope=scope)
    left = (F.col("n_removed") == 0) | F.col("_row.text").rlike(r"[^\x20\x09-\x0D]")
    gone = "_" * (1 + max(map(len, docs.columns)))  # clashes with nothing
    cut = done.filter(left).select("_row.*", F.col("n_removed").alias(gone))
    return cut.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8): the one of least id. Of rows
    equal in id and set one stays; null and wordless texts are near nothing and all stay."""
    scope = _begin(spark, "near")
    return ngram_join.representatives(docs, n=5, percent=80, scope=scope)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows of one id, null included, go or stay together; null and empty texts stay,
    and all stay where the benchmark is empty."""
    _begin(spark, "leaks")
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; a null or empty text is its end token alone, repeated rows are packed each."""
    scope = _begin(spark, "packing")
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), 2048, 1, scope=scope)


STAGES = [("language ID", language_stage), ("line dedup", line_stage), ("n-gram Jaccard join", near_stage), ("benchmark decontamination", leak_stage), ("packing", packing_stage)]

#: SQL cannot express the language, retrieval and tokenizer stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    between = []
    for nth, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if nth == len(STAGES) - 1:
            return out
        docs = store.keep(out, "stage-output")
        between.append(docs)
        for read in between[:-1]:
            store.discard(read)
        del between[:-1]
    return docs
