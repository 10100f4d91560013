"""python -m skein.cli [--output DIR] [--config FILE] QUERY: QUERY is a file with a query, or its text."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from skein.engine import Engine, Settings


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="skein", description="Runs one query. Wrong use ends with code 2.")
    parser.add_argument("query", help="a file that holds a query, or the query itself")
    parser.add_argument("--output", help="folder for the result; without it the first rows are shown")
    parser.add_argument("--config", help="file of settings, key = value")
    parser.add_argument("--rows", type=int, default=20, help="rows to show")
    try:
        given = parser.parse_args(args)
    except SystemExit as stop:
        return int(stop.code or 0)
    text = given.query
    if os.path.isfile(text):
        with open(text, encoding="utf-8") as f:
            text = f.read()
    settings = Settings.from_file(given.config) if given.config else Settings()
    spark = spark or SparkSession.builder.appName("skein").getOrCreate()
    if given.output or settings.output_dir:
        print(Engine(spark, replace(settings, output_dir=given.output or settings.output_dir)).run(text))
    else:
        Engine(spark, settings).query(text).show(given.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
