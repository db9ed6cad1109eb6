"""Sessions for tests and benchmarks; on a cluster the caller brings its own."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "plumbline", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tuned for."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("PLUMBLINE_DRIVER_MEMORY", "8g"),
        "spark.driver.host": "127.0.0.1",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def reach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, beside what they find themselves."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if here not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, here])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only in local mode without it."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not named:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
        named = context.getCheckpointDir()
    return f"{named.rstrip('/')}/plumbline"


@contextmanager
def unsent(spark: SparkSession) -> Iterator[None]:
    """What runs inside broadcasts only what it names itself.

    Spark takes rows that Python makes of a table to be as few bytes as the table, and sends them all through the driver.
    """
    name = "spark.sql.autoBroadcastJoinThreshold"
    own = {n: spark.conf.get(n, None) for n in (name, "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for n in own:
            spark.conf.set(n, "-1")
        yield
    finally:
        for n, value in own.items():
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)
