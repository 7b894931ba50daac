"""What the jobs share: command lines, configuration, tables that may not be there yet."""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "json", "csv")


def arguments(about: str, module: str, *paths: tuple[str, str]) -> tuple[argparse.Namespace, dict]:
    """Path arguments, and the settings of the config file (by default the one beside the module)."""
    parser = argparse.ArgumentParser(description=about)
    for name, what in paths:
        parser.add_argument(f"--{name}", required=True, help=what)
    parser.add_argument("--config", default=os.path.splitext(module)[0] + ".json", help="settings, a JSON object")
    named = parser.parse_args()
    with open(named.config, encoding="utf-8") as f:
        settings = json.load(f)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return named, settings


def checked(settings: dict, defaults: dict) -> dict:
    """Defaults with what is set; unknown names are errors."""
    unknown = sorted(set(settings) - set(defaults))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    out = defaults | settings
    if out.get("format", "parquet") not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    return out


def session(name: str) -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def stored(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A table that the job itself writes; empty before it is written first."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
