"""Session settings that the engine expects; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: int | str = "*", app: str = "granary", **conf: str) -> SparkSession:
    """A local session with adaptive execution, UTC and Arrow; keyword settings use ``__`` for dots."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
