"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str | None = None, name: str = "lorestone", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster, the master comes from the submit command."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
