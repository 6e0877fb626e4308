"""Tables as complete Parquet versions: a reader sees the last finished version only."""

from __future__ import annotations

import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of finished versions; Spark writes ``_SUCCESS`` when a write is complete."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/_SUCCESS")
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root)
    return sorted(int(s.getPath().getParent().getName()[2:]) for s in found or [])


def publish(df: DataFrame, path: str) -> int:
    """Write the next version; a write that was cut short is overwritten by the next try."""
    done = versions(df.sparkSession, path)
    number = done[-1] + 1 if done else 0
    df.write.mode("overwrite").parquet(f"{path}/v={number}")
    return number


def current(spark: SparkSession, path: str) -> DataFrame | None:
    done = versions(spark, path)
    return spark.read.parquet(f"{path}/v={done[-1]}") if done else None


# ------------------------------------------------------------------------------------- versions with many writers

def _created(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file unless it is there; of several writers one succeeds.

    The check and the creation are one step of the file system: exclusive creation on a local disk, a creation without
    overwriting elsewhere (HDFS decides it in its name node; an object store must support conditional writes).
    """
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    data = bytearray(text.encode())
    try:
        if files.getScheme() == "file":
            target = jvm.java.nio.file.Path.of(files.makeQualified(place).toUri())
            staged = jvm.java.nio.file.Files.writeString(target.resolveSibling(f".{uuid.uuid4().hex}"), text, spark.sparkContext._gateway.new_array(jvm.java.nio.file.OpenOption, 0))
            try:
                jvm.java.nio.file.Files.createLink(target, staged)  # whole or not at all, and never over another
            finally:
                jvm.java.nio.file.Files.delete(staged)
            return True
        out = files.create(place, False)
        out.write(data)
        out.close()
        return True
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise


def _markers(spark: SparkSession, path: str) -> list[int]:
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version-*")
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root)
    return sorted(int(s.getPath().getName()[len("version-"):]) for s in found or [])


def newest(spark: SparkSession, path: str) -> int:
    """Number of the newest version that ``commit`` published; -1 if there is none."""
    return (_markers(spark, path) or [-1])[-1]


def commit(df: DataFrame, path: str, expected: int | None = None, tries: int = 100) -> int | None:
    """Publish ``df`` as one version more, safe against other writers at the same time; the version's number.

    The rows are written first, to a folder of their own; then the file that names the folder is put at the next number if
    nobody has put one there. With ``expected`` (the version that ``df`` was made from, -1 for none) the rows are only published
    right after it: None means that somebody else came first and ``df`` should be made again. Without it the rows go
    to the next free number. Readers see whole versions only; a writer that dies leaves a folder that no version names.
    """
    spark, folder = df.sparkSession, f"data-{uuid.uuid4().hex}"
    if expected is not None and (_markers(spark, path) or [-1])[-1] != expected:
        return None
    df.write.parquet(f"{path}/{folder}")
    for _ in range(tries):
        number = ((_markers(spark, path) or [-1])[-1] if expected is None else expected) + 1
        if _created(spark, f"{path}/version-{number}", folder):
            return number
        if expected is not None:
            return None
    raise RuntimeError(f"no free version of {path} in {tries} tries")


def committed(spark: SparkSession, path: str, number: int | None = None) -> DataFrame | None:
    """The rows of a version that ``commit`` published, the newest by default; None if there is none."""
    done = _markers(spark, path)
    if not done:
        return None
    folder = spark.read.text(f"{path}/version-{done[-1] if number is None else number}").first()["value"]
    return spark.read.parquet(f"{path}/{folder}")


def history(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all versions, with their ``version``."""
    parts = [committed(spark, path, n).withColumn("version", F.lit(n)) for n in _markers(spark, path)]
    return reduce(DataFrame.unionByName, parts) if parts else None
