"""python -m veilstone text TEXT | file PATH | rules | entities: thin commands over the library."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from veilstone.functions.registry import rule_registry, scored_registry
from veilstone.operators.redact import redact
from veilstone.plans.samples import redact_samples
from veilstone.settings import Settings
from veilstone.sources import files


def main() -> None:
    parser = argparse.ArgumentParser(prog="veilstone")
    parser.add_argument("--profile", choices=("rule", "scored"))
    parser.add_argument("--categories", nargs="*", default=())
    parser.add_argument("--skip-categories", nargs="*", default=())
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("text").add_argument("text")
    file = commands.add_parser("file")
    file.add_argument("path")
    file.add_argument("--out")
    commands.add_parser("rules")
    commands.add_parser("entities")
    args = parser.parse_args()
    if args.command in ("rules", "entities"):
        for d in (rule_registry() if args.command == "rules" else scored_registry()).detectors:
            print(f"{d.category:11} {d.label:22} {d.priority if args.command == 'rules' else d.score}")
        return
    spark = SparkSession.builder.appName("veilstone").getOrCreate()
    held = Settings.from_env()
    options = replace(held, profile=args.profile or held.profile, categories=tuple(args.categories) or held.categories, skip_categories=tuple(args.skip_categories) or held.skip_categories).options()
    if args.command == "text":
        print(redact(spark.createDataFrame([(args.text,)], "text string"), options=options).first().redacted_text)
    elif args.path.endswith(".jsonl"):
        out = args.out or args.path.removesuffix(".jsonl") + "_redacted.jsonl"
        files.write_samples(redact_samples(files.read_jsonl(spark, args.path), options), out)
        print(out)
    else:
        print(files.redact_file(spark, args.path, options))


if __name__ == "__main__":
    main()
