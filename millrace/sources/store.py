"""Tables kept in the folder that all executors share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only where the session names none and runs on a single machine."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return folder or current.get()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/millrace-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows survives lost executors and does not compute it again."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once a session, so that they need no copy of it."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(package)
    sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="millrace-package-"), name), "zip", os.path.dirname(package), name))
    sc._millrace_shipped = True
