"""A session with the settings the engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "symweave", master: str | None = None, **settings: str) -> SparkSession:
    """Adaptive execution, UTC and binary-safe defaults; cluster settings that are already given win."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
