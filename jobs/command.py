"""The command line that the jobs share: a config file, and options that override it."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession


def main(name: str, run: Callable, options: dict[str, str], argv: list[str] | None = None) -> None:
    """Run ``run(spark, **options)`` in a session of its own, with the values of ``--config`` and those given by name."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__.splitlines()[0])
    parser.add_argument("--config", required=True, help="a JSON file, in any store that Spark reads")
    for option, text in options.items():
        parser.add_argument(f"--{option}", help=text)
    given = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        config = json.loads(spark.read.text(given.pop("config"), wholetext=True).first()[0])
        run(spark, **config | {k: v for k, v in given.items() if v is not None})
    finally:
        spark.stop()
