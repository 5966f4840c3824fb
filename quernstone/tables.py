"""Where tables come from, and the settings every operator relies on."""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names; one of our own only where none is set and all tasks run in this JVM, as in tests."""
    context = spark.sparkContext
    if (at := context.getCheckpointDir()) is None:
        at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if at is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            at = tempfile.mkdtemp(prefix="quernstone-")
        context.setCheckpointDir(at)
    return at


def shared(spark: SparkSession, name: str) -> str:
    """A folder of that name below the shared one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}"


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _files(spark, path)
    return system.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    system, at = _files(spark, path)
    system.delete(at, True)


def sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of each file below a path, whatever file system it is on."""
    system, at = _files(spark, path)
    found, listed = {}, system.listFiles(at, True)
    while listed.hasNext():
        f = listed.next()
        found[f.getPath().toString()] = f.getLen()
    return found


def stamp(spark: SparkSession, path: str) -> str:
    """Changes with the files below a path: their names, lengths and times."""
    system, at = _files(spark, path)
    listed, seen = system.listFiles(at, True), []
    while listed.hasNext():
        f = listed.next()
        seen.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:16]


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last in ``order`` (nulls first), of equal ones that of the greatest hash; null keys are a key."""
    rank = F.struct(*order, F.xxhash64(F.to_json(F.struct("*"))))
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(F.struct("*"), rank).alias("_row")).select("_row.*")


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written to the shared folder: later steps read them, whatever executor is lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
