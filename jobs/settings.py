"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession


def read(spark: SparkSession, path: str) -> dict:
    """The JSON config at `path`, read by Spark, so that it may be anywhere."""
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def main(name: str, paths: Sequence[str], work: Callable, argv: Sequence[str] | None = None) -> None:
    """Parses `--config` and a path for each of `paths`, and calls work(spark, **paths, **config) in a
    session of its own."""
    parser = argparse.ArgumentParser(prog=name, description=work.__doc__.partition("\n")[0])
    parser.add_argument("--config", required=True, help="JSON file with the job's settings")
    for p in paths:
        parser.add_argument(f"--{p}", required=True, help=f"path of {p}")
    given = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        work(spark, **read(spark, given.pop("config")), **given)
    finally:
        spark.stop()
