"""Getting this package to the Python workers."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Where none is named, a local master gets one of its own; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send the package to all workers, once per session, so that queries run from any folder.

    The zip goes into the folder the cluster shares.
    """
    if getattr(spark.sparkContext, "_tracewright_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    name = f"{shared_folder(spark)}/tracewright-{uuid.uuid4().hex}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(data.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(name)
    spark.sparkContext._tracewright_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder the cluster shares (a local one only where none is set): short plans that survive lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
