"""Tables that outlive an executor: written once to the folder all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, by any path Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A top-level column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in whatever case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where it is unset and all tasks run in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tamis-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later plans start from the files.

    Nothing is recomputed when an executor is lost, and the lineage ends here.  The
    path is kept as ``df.tamis_path`` for :func:`discard`; what is left of it goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tamis/{label}-{uuid.uuid4().hex}"
    folder, files = _hadoop(spark, path)
    df.write.parquet(path)
    files.deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out.tamis_path = path
    return out


def _hadoop(spark: SparkSession, path: str) -> tuple:
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(sc._jsc.hadoopConfiguration())


def discard(*frames: DataFrame | None) -> None:
    """Delete the files behind materialised frames that no later result reads."""
    for df in frames:
        path = getattr(df, "tamis_path", None)
        if path:
            folder, files = _hadoop(df.sparkSession, path)
            files.delete(folder, True)
            files.cancelDeleteOnExit(folder)
