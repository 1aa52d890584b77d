"""Where jobs keep what outlives a task: the session's shared folder."""

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Only a local session may do without one; it gets a new temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make checkpoint() usable, in the shared folder unless one is set already."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def _located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, independent of any working folder."""
    files, at = _located(spark, path)
    return files.makeQualified(at).toString()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, in order; nothing where there is no folder."""
    files, at = _located(spark, path)
    if not files.exists(at):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(at) if not s.getPath().getName().startswith("."))


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a folder."""
    files, at = _located(spark, path)
    return files.getContentSummary(at).getLength()


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder with all it holds, if it is there."""
    files, at = _located(spark, path)
    files.delete(at, True)


def mark(spark: SparkSession, path: str) -> None:
    """Make an empty folder, in one step that others see or do not see."""
    files, at = _located(spark, path)
    files.mkdirs(at)
