"""Command line: ``python -m quillspark formats | inspect PATH | convert SOURCE TARGET --to FORMAT``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import engine


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillspark")
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("formats")
    one = sub.add_parser("inspect")
    one.add_argument("path")
    one.add_argument("--format")
    two = sub.add_parser("convert")
    two.add_argument("source")
    two.add_argument("target")
    two.add_argument("--to", required=True)
    two.add_argument("--format")
    two.add_argument("--pages")
    two.add_argument("--experimental", action="store_true")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        if a.verb == "formats":
            rows = engine.formats(spark)
        elif a.verb == "inspect":
            rows = engine.read(spark, a.path, a.format).groupBy("doc", "page").agg(F.count(F.lit(1)).alias("strokes"), F.sum(F.size("x")).alias("points"), F.array_sort(F.collect_set("tool")).alias("tools")).orderBy("doc", "page")
        else:
            print(engine.convert(spark, a.source, a.target, a.to, a.format, a.pages, a.experimental))
            return 0
        for row in rows.toLocalIterator():
            print(json.dumps(row.asDict()))
    except engine.NotSupported as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
