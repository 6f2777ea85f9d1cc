"""The registered queries opN_<name>: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstone.llm.oracles import ORACLES  # noqa: F401
from veilstone.llm import alignment, chat, decontamination, divergence, language_id, line_dedup, ngram_join, packing, quality, secrets, token_counts, toxicity, warc


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir), n=3, percent=90)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), 2048, 1, digest=True)


#: A conversation whose texts are made of control strings.
CONTROL_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string")
    out = chat.formatted(table.unionByName(extra))
    turns = chat.read_back(F.col("formatted"))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["segment"])), "")
    read = out.select("conv_id", turns.alias("_t"), loss.alias("_l"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")
    digest = F.array_join(F.transform("_t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("_t").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"), F.length("_l").cast("long").alias("loss_chars"), F.sha2(F.col("_l"), 256).alias("loss_sha256"), "formatted_chars", "valid")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("_row.doc_id", "n_removed", "runs", "_row.text")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select("doc_id", *quality.FEATURES, "base_failed", "kept")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = language_id.fold(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, labels.filter(~held_out))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = language_id.fold(F.col("doc_id"), 5) == 0
    model = language_id.train(docs.select("doc_id", "text", "lang").filter(~held_out))
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"), 4096)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    of = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = [r.kind for r in secrets.RULES if r.base]
    digest = F.sha2(secrets.written(F.filter("found", lambda s: s["kind"].isin(*base))), 256)
    return found.select("doc_id", *map(of, base), digest.alias("base_sha256"), secrets.written(F.col("found")).alias("spans"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_packing, op3_chat_formatting, op4_line_dedup, op5_quality_rules, op6_decontamination, op7_toxicity, op8_language_id, op9_token_counts, op10_secret_scans, op11_source_divergence, op12_warc, op13_token_alignment)}
