"""Session factory. Sizes that depend on the cluster are left to its own settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "fairlead", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution, skew-join handling and Arrow."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
    }
    for k, v in (fixed | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
