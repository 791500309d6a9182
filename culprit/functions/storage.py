"""Cut a plan by writing it once to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a local one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="culprit-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Write options for very many small files: a local file system keeps no checksum file beside each. Others do not read them.
MANY_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows of a key in one task, in as many tasks as a shuffle has. For writes that make a file for each key: the work is
    in the files, so tasks are not joined for being small, and no two write files of one key."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def in_fewer_tasks(files: DataFrame, most: int = 32) -> DataFrame:
    """A scan of small files with up to ``most`` of its partitions in a task, but not in fewer tasks than a shuffle has.

    Spark counts ``spark.sql.files.openCostInBytes`` for each file, so a partition holds only a few and tasks cost more than files.
    """
    n = files.rdd.getNumPartitions()
    return files.coalesce(max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // most)))


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path, of any file system that Spark knows, is a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` and read it back: later steps start from the table, also after executor loss."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables from :func:`stored` that no later step reads."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
