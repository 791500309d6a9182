"""Folders of very many small files.

Spark's own writers and readers keep a list of all files on the driver, and Hadoop's local file system starts a process for
each file and folder that it makes. So on a local file system, which all executors share, tasks list, write and read the
files themselves, and the driver has no list. Other file systems go through Spark's writers and readers, and so do folders
with packed files. Names, hidden files, empty files and paths are as Spark has them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from culprit.functions.storage import MANY_FILES, dealt, in_fewer_tasks

NO_KEY = "__HIVE_DEFAULT_PARTITION__"
PACKED = r"\.(gz|bz2|deflate|zstd?|lz4|lzo|snappy|xz|passthrough)$"
ONE_COLUMN = {"quote": "\u0000", "sep": "\u0001"}  # CSV rows that are lines
SPREAD = 10_000  # names that are listed before the folders among them are left to other tasks
BYTES, ROWS = 1 << 23, 1_000  # of a batch
_IN_FOLDER = re.compile("[\\x01-\\x1f\"#%'*/:=?\\\\\\x7f{\\[\\]^]")  # is escaped in the name of a partition
_IN_URI = re.compile(r"[^A-Za-z0-9/_\-!.~'()*,;:$&+=@\x80-\U0010ffff]|[\x80-\x9f]|(?=[^\x00-\x7f])\s")


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path on the local file system; None if it is on another one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.makeQualified(at).toUri().getPath() if files.getScheme() == "file" else None


def write_lines(df: DataFrame, path: str, key: str, text: str, order: Iterable[str] = (), extension: str = "") -> None:
    """One file for each key, in a folder ``key=value`` as partitions have, with the texts of the key as lines, by ``order``.
    With an extension the lines are rows of CSV files with one column."""
    rows = dealt(df, key).sortWithinPartitions(key, *order).select(key, text)
    root = local_path(df.sparkSession, path)
    if root is None:
        writer = rows.write.options(**MANY_FILES).partitionBy(key)
        writer.options(**ONE_COLUMN, extension=extension).csv(path) if extension else writer.text(path)
        return
    if os.path.lexists(root):
        raise FileExistsError(root)
    line = F.col(text)
    if extension:
        rows, line = rows.filter(line.isNotNull()), F.to_csv(F.struct(text), ONE_COLUMN)
    rows = rows.select(F.col(key).cast("string"), line.cast("binary"))
    rows.mapInArrow(_written(f"{root}/{key}=", f".{extension or 'txt'}"), "n bigint").write.format("noop").mode("overwrite").save()
    os.makedirs(root, exist_ok=True)


def _escaped(key: str | None) -> str:
    return _IN_FOLDER.sub(lambda m: f"%{ord(m[0]):02X}", key) if key else NO_KEY


def _written(prefix: str, ending: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        name = f"part-{task.partitionId():05d}{ending}"
        part = f".{name}.{task.taskAttemptId()}"  # hidden until it is whole
        rows = ((prefix + _escaped(k.as_py()), t.as_py()) for b in batches for k, t in zip(b.column(0), b.column(1), strict=True))
        for folder, lines in groupby(rows, lambda r: r[0]):
            os.makedirs(folder, exist_ok=True)
            with open(f"{folder}/{part}", "wb") as out:
                for _, line in lines:
                    out.write((line or b"") + b"\n")
            os.replace(f"{folder}/{part}", f"{folder}/{name}")
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return run


def whole_texts(spark: SparkSession, path: str, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """``source, value``: path and text of each file below a folder; with ``keep`` only files whose path passes are read."""
    root = local_path(spark, path)
    listed = _listed(spark, root) if root and os.path.isdir(root) else None
    if listed is None or listed.agg(F.max(F.rlike("path", F.lit(PACKED)))).first()[0]:
        d = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
        d = d.select(F.col("_metadata.file_path").alias("source"), "value")
        return in_fewer_tasks(d.filter(keep(F.col("source"))) if keep else d)
    kept = listed.filter(keep(F.col("source"))) if keep else listed
    read = kept.repartition(_tasks(spark)).mapInArrow(_read, "source string, value binary")
    return read.select("source", F.col("value").cast("string").alias("value"))


def key_of(source: Column, key: str) -> Column:
    """The key of a file from :func:`write_lines`."""
    k = F.regexp_extract(source, f"/{key}=([^/]*)/[^/]*$", 1)
    for _ in ("URI", "folder"):
        k = F.url_decode(F.replace(k, F.lit("+"), F.lit("%2B")))
    return F.nullif(k, F.lit(NO_KEY))


def lines_of(text: Column) -> Column:
    """The lines of a file's text; what ends the last one begins no other."""
    return F.split(F.regexp_replace(text, r"(\r\n|\r|\n)\z", ""), "\r\n|\r|\n")


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """``path, source`` of the files below a folder. One task lists the names at the top, others what is below them."""
    top = spark.range(0, 1, 1, 1).mapInArrow(lambda _: _batches((x,) for x in _names(root.rstrip("/") or "/")), "path string")
    return top.repartition(_tasks(spark)).mapInArrow(_walked, "path string, source string")


def _hidden(name: str, folder: bool) -> bool:
    out = name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")
    return out and not (folder and name.startswith(("_metadata", "_common_metadata")))


def _below(folder: str) -> Iterator[str]:
    """Files and folders in a folder, folders with a slash at the end."""
    with os.scandir(folder) as entries:
        for e in entries:
            is_folder = e.is_dir()
            if (is_folder or e.is_file()) and not _hidden(e.name, is_folder):
                yield os.path.join(folder, e.name) + "/" * is_folder


def _names(root: str) -> Iterator[str]:
    """Files and folders that have all files below ``root``, ``SPREAD`` or more if there are so many."""
    level = [root]
    while level:
        below = (x for folder in level for x in _below(folder))
        first = list(islice(below, SPREAD))
        if len(first) == SPREAD:
            yield from first
            yield from below
            return
        yield from (x for x in first if not x.endswith("/"))
        level = [x for x in first if x.endswith("/")]


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def files(name: str) -> Iterator[str]:
        folders = [name] if name.endswith("/") else []
        if not folders:
            yield name
        while folders:
            for x in _below(folders.pop()):
                folders.append(x) if x.endswith("/") else (yield x)

    return _batches(((x, "file:" + _IN_URI.sub(_quoted, x)) for b in batches for name in b.column(0).to_pylist() for x in files(name)), ("path", "source"))


def _quoted(m: re.Match) -> str:
    return "".join(f"%{x:02X}" for x in m[0].encode())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def texts() -> Iterator[tuple[str, bytes]]:
        for b in batches:
            for path, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with open(path, "rb") as f:
                    text = f.read()
                if text:
                    yield source, text

    return _batches(texts(), ("source", "value"), (pa.string(), pa.binary()))


def _batches(rows: Iterable[tuple], names: tuple[str, ...] = ("path",), kinds: tuple[pa.DataType, ...] = (pa.string(), pa.string())) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=False)], names=list(names))

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= BYTES or len(held) == ROWS:
            yield out()
            held, size = [], 0
    if held:
        yield out()
