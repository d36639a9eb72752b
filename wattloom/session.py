"""Session settings, table access and the shared scratch folder."""
from __future__ import annotations

import os
import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Functions that run in Python workers travel with their code, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])


def session(app: str = "wattloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the zone pinned to UTC; market time itself is TIMESTAMP_NTZ."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the cluster's checkpoint folder.

    ``spark.checkpoint.dir`` names storage every executor can reach.  Where it is unset a cluster is
    refused; only a local master, whose tasks run in this process, gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")       # one machine: driver and tasks share it
        spark.conf.set("spark.checkpoint.dir", root)
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


def cut(df: DataFrame, purpose: str = "cut", codec: str | None = None) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back; codec is Parquet's, the session's own if None.

    Used where one result feeds several later scans, so that a lost executor
    replays a file read and not the whole upstream plan.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Attribute access to the parquet tables of one data directory."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._kept = spark, folder, {}

    def once(self, name: str, make) -> DataFrame:
        """make(tables), written at its first use and read from then on."""
        if name not in self._kept:
            self._kept[name] = cut(make(self), name)
        return self._kept[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
