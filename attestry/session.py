"""Session settings that the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC keeps timestamps comparable; AQE re-plans skewed joins; ANSI stays on (Spark 4 default).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(app: str = "attestry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS and `conf` on top; an active session is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
