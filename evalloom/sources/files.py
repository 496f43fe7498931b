"""Small files wherever Spark keeps them: local paths, or any store that Hadoop's file systems reach."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, source: str, target: str, overwrite: bool = True) -> None:
    """Move in one step; without ``overwrite`` an existing target is an error."""
    jvm, (_, p), (_, q) = spark.sparkContext._jvm, _at(spark, source), _at(spark, target)
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE if overwrite else kind.NONE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(q.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(p, q, how)


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder over another: the old one steps aside and comes back if the new one can't be moved."""
    old = f"{target.rstrip('/')}.{uuid.uuid4().hex[:8]}.old"
    had = exists(spark, target)
    if had:
        rename(spark, target, old, overwrite=False)
    try:
        rename(spark, source, target, overwrite=False)
    except BaseException:
        if had:
            rename(spark, old, target, overwrite=False)
        raise
    if had:
        delete(spark, old)


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    write_bytes(spark, path, text.encode("utf-8"), overwrite)


def write_bytes(spark: SparkSession, path: str, data: bytes, overwrite: bool = True) -> None:
    """Write beside the target, then move over it: readers see the old file or the new one."""
    folder, _, name = path.rpartition("/")
    aside = f"{folder}/.{name}.{uuid.uuid4().hex[:8]}.tmp"
    fs, p = _at(spark, aside)
    out = fs.create(p, False)
    try:
        out.write(bytearray(data))
        out.close()
        rename(spark, aside, path, overwrite)
    except BaseException:
        fs.delete(p, False)
        raise


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file, on the driver."""
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    return read_bytes(spark, path).decode("utf-8")


def walk(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(path below the folder, bytes) of all files below it, sorted; none if it doesn't exist; a file itself is ``""``."""
    fs, p = _at(spark, folder)
    if not fs.exists(p):
        return []
    if fs.getFileStatus(p).isFile():
        return [("", fs.getFileStatus(p).getLen())]
    top, found, out = fs.getFileStatus(p).getPath().toString().rstrip("/") + "/", fs.listFiles(p, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString().removeprefix(top), f.getLen()))
    return sorted(out)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted."""
    fs, p = _at(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(p))
