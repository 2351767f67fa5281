"""Folders for written tables and stream state that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may do without the setting; it gets a temporary folder,
    which is then remembered in the session.
    """
    named = spark.conf.get(SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="codegauge-")
    spark.conf.set("codegauge.local.dir", folder)
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    root = spark.conf.get(SETTING, None) or spark.conf.get("codegauge.local.dir", None)
    root = root or shared_root(spark)
    return f"{root.rstrip('/')}/codegauge/{name}-{uuid.uuid4().hex}"
