"""Session defaults shared by tests, the bench and the entry module."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "caselode", cores: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster the submitted conf wins."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if "MASTER" not in os.environ:
        builder = builder.master(f"local[{cores or '*'}]")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers on the driver's path import this package too.

    On a cluster the package is installed or sent with --py-files; in local
    mode workers start elsewhere and only see PYTHONPATH.
    """
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, env.get("PYTHONPATH", "")) if x)
