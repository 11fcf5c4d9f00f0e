"""What a session needs before library functions run on executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Long texts must not fill an executor's memory: rows go to Python in batches of about this size.
BATCH = "8m"


def attach(spark: SparkSession) -> SparkSession:
    """Ship this package to the executors once a session, through Spark's own file server, and bound Arrow batches by bytes
    unless the session already does."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "-1", str(2**63 - 1), str(2**31 - 1), str(256 << 20)):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    if spark.conf.get("spark.waymark.attached", "") != spark.sparkContext.applicationId:
        root = Path(__file__).resolve().parent
        made = Path(tempfile.mkdtemp(prefix="waymark-")) / "waymark.zip"
        with zipfile.ZipFile(made, "w") as out:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        path = Path(folder) / name
                        out.write(path, f"{root.name}/{path.relative_to(root)}")
        spark.sparkContext.addPyFile(str(made))
        spark.conf.set("spark.waymark.attached", spark.sparkContext.applicationId)
    return spark


_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir`` or ``SparkContext.setCheckpointDir``.

    Only on one machine (a local master), where neither names one, a temporary folder is made and kept in the session;
    elsewhere that is an error, since executors would not see it.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or spark.conf.get("spark.waymark.scratch", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="waymark-")
        spark.conf.set("spark.waymark.scratch", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session ends."""
    path = f"{shared_dir(spark)}/waymark/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: computed once, and not again when executors are lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def drop_saved() -> None:
    """Delete what was written in this session; results that still read it must be saved before."""
    while _written:
        spark, path = _written.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: its files went with the cluster's folder
            return
