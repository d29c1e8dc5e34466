"""Paths below the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN_DIRS: dict[str, str] = {}
_BEGUN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the one given to ``setCheckpointDir``; where neither
    is set, a temporary one, on local masters only (tests)."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="kinblock-")
        atexit.register(shutil.rmtree, _OWN_DIRS[app], ignore_errors=True)
    return _OWN_DIRS[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in this application's part of the shared folder, which goes when the application ends."""
    context = spark.sparkContext
    own = f"{shared_dir(spark).rstrip('/')}/kinblock-{context.applicationId}"
    if own not in _BEGUN:
        _BEGUN.add(own)
        path = context._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{own}/{label}-{uuid.uuid4().hex}"
