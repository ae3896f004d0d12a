"""Tables and markers in the folder that driver and executors share, for work that must end a lineage or survive a restart."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set. A local session without it gets a temporary folder; on a cluster a missing setting is an error."""
    sc = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return found
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyloom-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder that goes at exit."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stage(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that its lineage ends there; goes at exit."""
    path = scratch(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a write to path was ended: Spark leaves its marker last."""
    where, system = _file_system(spark, f"{path}/_SUCCESS")
    return system.exists(where)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in path, sorted; none where path isn't there."""
    where, system = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(where) if x.isDirectory()) if system.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    where, system = _file_system(spark, path)
    system.delete(where, True)


@atexit.register
def _delete_all() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # the session may be gone; its folder then goes with it
            return
