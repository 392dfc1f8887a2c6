"""python -m trendlake FOLDER: one run over all sources into the tables of a folder."""

from __future__ import annotations

import argparse
import dataclasses
import json

from pyspark.sql import SparkSession

from .plans.pipeline import run_live


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="trendlake", description="Fetches all sources once and writes posts and keywords.")
    parser.add_argument("folder", help="where the tables lie; all executors must reach it")
    folder = parser.parse_args(arguments).folder
    spark = SparkSession.builder.appName("trendlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(json.dumps(dataclasses.asdict(run_live(spark, folder)), ensure_ascii=False))


if __name__ == "__main__":
    main()
