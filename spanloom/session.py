"""Session settings that the library relies on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def session(app: str = "spanloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the UTC zone and adaptive execution; other settings are the cluster's."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Instants are stored as timestamps without zone, in UTC; conversions consult the session zone, so it is UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    importable(spark)
    return spark


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where it isn't installed but lies at the same place as on the driver."""
    here, given = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = given.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        given["PYTHONPATH"] = os.pathsep.join([here, *filter(None, paths)])
