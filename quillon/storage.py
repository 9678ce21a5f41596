"""Where jobs keep intermediate tables, and how they cut lineage.

Every intermediate table is written below the folder named by ``spark.checkpoint.dir``, which all
executors and the driver share, so a lost executor loses nothing that was finished.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CREATED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; where none is set, a temporary one if the session runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing uses yet; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    if not _CREATED:
        atexit.register(_clean, spark)
    _CREATED.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    if path in _CREATED:
        _CREATED.remove(path)


def _clean(spark: SparkSession) -> None:
    for path in list(_CREATED):
        try:
            remove(spark, path)
        except Exception:  # the session may be gone by now
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and go on from the files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._quillon_path = path
    return stored


def release(*tables: DataFrame | None) -> None:
    """Removes the files of materialised tables that nothing reads any more; others are left alone."""
    for table in tables:
        path = getattr(table, "_quillon_path", None)
        if path in _CREATED:
            remove(table.sparkSession, path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
