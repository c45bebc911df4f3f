"""Sends this package to the executors of a session that can't import it by themselves."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.abspath(__file__))
_sent: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file to the session's application, once; the driver serves it to each executor."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    folder = tempfile.mkdtemp(prefix="splitfold-")
    path = os.path.join(folder, "splitfold_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for base, _, names in os.walk(_ROOT):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(base, name)
                out.write(full, os.path.relpath(full, os.path.dirname(_ROOT)))
    spark.sparkContext.addPyFile(path)
    _sent[app] = path


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the cluster's own, or a temporary one in local mode."""
    sc = spark.sparkContext
    if (known := sc._jsc.sc().getCheckpointDir()).isDefined():
        return known.get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="splitfold-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_folder(spark: SparkSession, what: str) -> str:
    """The path of a new folder in the shared one; it is deleted when the driver ends."""
    folder = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder
