"""Command line: parse, repair and validate files of markup with Spark."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import PRESETS, Config
from .engine import Engine
from .sources import files


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="markgrove", description="Analyse markup files, however malformed.")
    top.add_argument("--preset", choices=sorted(PRESETS), default="default")
    sub = top.add_subparsers(dest="command", required=True)
    for name, text in (("parse", "summarise files"), ("repair", "write repaired XML"), ("validate", "say which files are sound")):
        p = sub.add_parser(name, help=text)
        p.add_argument("path")
        p.add_argument("--encoding")
        p.add_argument("--output", help="folder of the result; without it, rows are printed")
        p.add_argument("--format", choices=("json", "csv", "text", "parquet"), default="json")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if every file could be used (validate: is sound), else 1."""
    args = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("markgrove").getOrCreate()
    config = Config.preset(args.preset)
    found, problem = files.try_read_files(spark, args.path)
    if found is None:
        print(problem, file=sys.stderr)
        return 1
    if args.command == "repair":
        docs = files.decoded(found, args.encoding, config).select("doc_id", "path", F.col("text").alias("content"))
        out, ok = Engine(spark, config).repair(docs, carry=("path",)).select("path", F.col("content").alias("xml")), F.lit(True)
    else:
        summary = files.parse_files(spark, args.path, args.encoding, config)
        valid = F.col("success") & (F.col("repair_count") == 0)
        ok = valid if args.command == "validate" else F.col("success")
        out = summary.select(F.col("path").alias("file"), "success", "confidence", F.col("total_elements").alias("elements"), F.col("repair_count").alias("repairs"), F.col("error_count").alias("errors"), valid.alias("valid"), "encoding")
        ok = F.col("valid") if args.command == "validate" else F.col("success")
    out = out.cache()
    if args.output:
        files.write(out, args.output, args.format, "overwrite")
    else:
        for row in out.toLocalIterator():
            print("\t".join(str(v) for v in row))
    return int(out.where(~ok).limit(1).count() > 0)


if __name__ == "__main__":
    sys.exit(main())
