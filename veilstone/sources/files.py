"""Readers and writers: lines of JSON or plain text, JSON trees, CSV, and sinks of redacted samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilstone.operators import tokens
from veilstone.operators.redact import Options, detect, redact_columns

UNSUPPORTED = {"xlsx": "no reader for spreadsheets is installed", "xls": "no reader for spreadsheets is installed", "pdf": "no reader for PDF is installed"}


def parse_lines(lines: DataFrame, line: str = "value", number: str = "line_no") -> DataFrame:
    """sample_id, prompt, response and metadata of lines that are JSON objects or plain text.

    Blank lines are skipped, but counted. `id` defaults to line-N, the prompt is `prompt`, else `text`, else empty; a line
    that is no JSON object is itself the prompt.
    """
    rows = lines.select(F.trim(line).alias("_l"), F.col(number).alias("_n")).filter("_l != ''")
    parsed = rows.withColumn("_j", F.from_json("_l", "map<string,string>"))
    is_json = F.startswith("_l", F.lit("{")) & F.col("_j").isNotNull() & F.get_json_object("_l", "$").isNotNull()
    of = lambda k: F.get_json_object("_l", f"$.{k}")
    default = F.concat(F.lit("line-"), F.col("_n").cast("string"))
    return parsed.select(
        F.when(is_json, F.coalesce(of("id"), default)).otherwise(default).alias("sample_id"),
        F.when(is_json, F.coalesce(of("prompt"), of("text"), F.lit(""))).otherwise(F.col("_l")).alias("prompt"),
        F.when(is_json, of("response")).alias("response"),
        F.when(is_json, F.coalesce(of("metadata"), F.lit("{}"))).otherwise(F.lit("{}")).alias("metadata"),
    )


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """parse_lines of a text file; line numbers count from 0 within the file, blank lines included.

    Numbers need the lines in front: counts by split, one row each, are summed up first, as a file is read in order.
    """
    lines = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id())
    split, within = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    rows = lines.withColumn("_split", split).withColumn("_within", within)
    sizes = {r._split: r.n for r in rows.groupBy("_split").agg(F.count("*").alias("n")).collect()}  # a row a split
    start, shift = 0, []
    for s in sorted(sizes):
        shift += [F.lit(s), F.lit(start)]
        start += sizes[s]
    offset = F.element_at(F.create_map(*shift), F.col("_split")) if shift else F.lit(0)
    return parse_lines(rows.withColumn("line_no", F.col("_within") + offset))


def redact_tree(df: DataFrame, options: Options | None = None) -> DataFrame:
    """Every string leaf of typed JSON redacted; keys and other values untouched. Maps, arrays and structs are walked."""
    out, n, options = df, 0, options or Options()
    for f in df.schema.fields:
        if f.dataType == T.StringType():
            out = detect(out, f.name, options, f"_t{n}")
            out = out.withColumn(f.name, tokens.rewritten(F.col(f.name), F.col(f"_t{n}"))).drop(f"_t{n}")
            n += 1
        elif _holds_text(f.dataType):
            out = out.withColumn(f.name, _walk(F.col(f.name), f.dataType, options))
    return out


def _holds_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_text(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds_text(kind.elementType)
    return _holds_text(kind.valueType) if isinstance(kind, T.MapType) else isinstance(kind, T.StringType)


def _leaf(text: Column, options: Options) -> Column:
    from veilstone.functions.spans import candidates
    from veilstone.operators.redact import resolved

    spans = resolved(text, candidates(text, options.detectors()), options)
    return tokens.rewritten(text, tokens.numbered(spans, options.consistent, options.profile == "scored"))


def _walk(value: Column, kind: T.DataType, options: Options) -> Column:
    if isinstance(kind, T.StringType):
        return _leaf(value, options)
    if not _holds_text(kind):
        return value
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_walk(value[f.name], f.dataType, options).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _walk(x, kind.elementType, options))
    return F.transform_values(value, lambda _, x: _walk(x, kind.valueType, options))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By extension: json (a document a file), jsonl, csv, parquet, txt; others are told apart by an error."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind in UNSUPPORTED:
        raise NotImplementedError(f".{kind}: {UNSUPPORTED[kind]}")
    readers = {"json": lambda: spark.read.json(path, multiLine=True), "jsonl": lambda: read_jsonl(spark, path), "csv": lambda: read_csv(spark, path), "parquet": lambda: spark.read.parquet(path), "txt": lambda: spark.read.text(path)}
    if kind not in readers:
        raise ValueError(f"no reader for .{kind}")
    return readers[kind]()


def redact_file(spark: SparkSession, path: str, options: Options | None = None) -> str:
    """Writes {name}_redacted.{extension} (a folder) beside a json or csv file and returns its path."""
    stem, _, kind = path.rpartition(".")
    out = f"{stem}_redacted.{kind}"
    table = read_any(spark, path)
    if kind == "csv":
        redact_columns(table, options=options).write.csv(out, header=True)
    elif kind == "json":
        redact_tree(table, options).write.json(out)
    else:
        raise ValueError(f"no writer for .{kind}")
    return out


def write_samples(redacted: DataFrame, path: str, include_token_map: bool = False) -> None:
    """Appends JSON lines: sample_id, redacted_prompt, redacted_response, entity_count, metadata; raw values only if asked."""
    more = [c for c in ("metadata",) if c in redacted.columns] + (["token_map"] if include_token_map else [])
    redacted.select("sample_id", "redacted_prompt", "redacted_response", F.col("total_entities").alias("entity_count"), *more).write.mode("append").json(path)
