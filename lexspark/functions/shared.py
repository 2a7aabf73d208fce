"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session without one gets a temporary folder; on a cluster its
    executors could not see it, which is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lexspark-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lexspark-engine-{spark.sparkContext.applicationId}"


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = _place(spark, path)
    return fs.exists(place)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Changes whenever a file of the table at `path` does: by names, sizes and times of change."""
    place, fs = _place(spark, path)
    files, found = fs.listFiles(place, True), []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


#: Sessions whose folder goes when the process ends.
_LEAVES: set[str] = set()


def _leave(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # else the session has ended before
        with suppress(Exception):  # the process ends; there is nobody left to tell
            place, fs = _place(spark, session_dir(spark))
            fs.delete(place, True)


def own_dir(spark: SparkSession) -> str:
    """The session's folder, which is deleted when the process ends."""
    if spark.sparkContext.applicationId not in _LEAVES:
        _LEAVES.add(spark.sparkContext.applicationId)
        atexit.register(_leave, spark)
    return session_dir(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, written once to the session's folder and read again, for what is used several times or must not
    be computed twice."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
