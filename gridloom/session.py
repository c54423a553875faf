"""Session with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "gridloom", **conf: str) -> SparkSession:
    """A session with ANSI arithmetic, UTC and adaptive execution; ``conf`` overrides (dots as double underscores)."""
    b = SparkSession.builder.appName(app)
    base = {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
