"""A session with the settings that the operators assume, and what executors need of it."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def session(name: str = "lodestrand", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in settings.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each context, so that they need no path of the driver's."""
    context = spark.sparkContext
    if not getattr(context, "_lodestrand_sent", False):
        folder = tempfile.mkdtemp()
        context.addPyFile(shutil.make_archive(f"{folder}/lodestrand", "zip", os.path.dirname(PACKAGE), os.path.basename(PACKAGE)))
        context._lodestrand_sent = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or on a single machine one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file:///tmp/checkpoints/{os.getpid()}"
