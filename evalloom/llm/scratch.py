"""Cutting lineage with written tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_FOLDERS: set[tuple[SparkSession, str]] = set()
#: Shuffle files of a query go when it ends, not when the driver's garbage happens to be collected.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark is local (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="evalloom-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return f"file://{_OWN[app]}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder wherever Spark keeps it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the driver's Python ends, if its session still runs."""
    if not _FOLDERS:
        atexit.register(_delete_all)
    _FOLDERS.add((spark, path))


def _delete_all() -> None:
    for spark, path in _FOLDERS:
        with contextlib.suppress(Exception):  # the JVM may have gone first
            if spark.sparkContext._jsc is not None:
                delete(spark, path)


@contextlib.contextmanager
def _own_shuffles(spark: SparkSession):
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


class Scratch:
    """Tables written for one operator call. Those its result doesn't read go by ``keep``, the others when
    the driver's Python ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.held: set[str] = set()
        delete_at_exit(spark, self.base)

    def pin(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """Write ``df`` once, in a folder for each value of ``by``, and return a scan of it."""
        self.n += 1
        path = f"{self.base}/t{self.n}"
        to = df.write.option("compression", "zstd")
        with _own_shuffles(self.spark):
            (to.partitionBy(by) if by else to).parquet(path)
        self.held.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables made by ``pin`` that nothing reads any more."""
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path in self.held:
                self.held.remove(path)
                delete(self.spark, path)

    def keep(self, *frames: DataFrame) -> None:
        """Delete all tables but these."""
        stay = {getattr(df, "_scratch_path", None) for df in frames}
        for path in self.held - stay:
            delete(self.spark, path)
        self.held &= stay


def _is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is a file scan with nothing but projections and filters over it."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.children().size() == 0 and plan.nodeName().startswith(("Relation", "LogicalRelation"))


def numbered(df: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """``df`` with a long ``name`` that is unique to each row and the same whenever the result is read.

    Rows of files are numbered by their place in them, which asks for no copy: a file's rows follow those
    of the files before it by name. Other tables are numbered in a written copy.
    """
    if not _is_scan(df):
        return scratch.pin(df.withColumn(name, F.monotonically_increasing_id()))
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    try:
        placed = df.select("*", path.alias("_at_path"), row.alias("_at_row"))
    except AnalysisException:  # files of another kind
        return scratch.pin(df.withColumn(name, F.monotonically_increasing_id()))
    files = placed.groupBy("_at_path").agg((F.max("_at_row") + 1).alias("_at_n"))
    start = F.sum("_at_n").over(W.orderBy("_at_path")) - F.col("_at_n")  # a row a file
    files = scratch.pin(files.select("_at_path", start.alias("_at_start")))
    got = placed.join(sized_broadcast(files, 100_000), "_at_path")
    return got.select(*df.columns, (F.col("_at_start") + F.col("_at_row")).alias(name))


def sized_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` (narrow) rows, else as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: A key with more than this share of the rows is hot, so there are at most as many hot keys; fewer rows than
#: ``HOT_LEAST`` are no load for a task.
HOT_SHARE, HOT_LEAST, SALTS = 1000, 500, 64


def least_hot(total: int) -> int:
    """Keys with more rows than this are hot where there are ``total`` rows."""
    return max(HOT_LEAST, total // HOT_SHARE)


def salted_join(rows: DataFrame, unique: DataFrame, on: list[str], n: str, salt_by: list[str], how: str = "inner", known: tuple[int, int] | None = None) -> DataFrame:
    """``rows.join(unique, on, how)`` where ``unique`` has a row a key and ``n``, how many of ``rows`` have it.

    Keys with more than 1 / ``HOT_SHARE`` of all these rows, ``HOT_SHARE`` at most, are broadcast: their
    rows never meet in one task. The other keys are joined as usual. ``n`` is dropped. ``how`` is inner or left. ``known`` are
    all keys' sum and the greatest ``n``, where they have been counted already.
    """
    total, most = known or unique.agg(F.coalesce(F.sum(n), F.lit(0)), F.max(n)).first()
    least = least_hot(total)
    if (most or 0) <= least:
        return rows.join(unique.drop(n), on, how)
    hot = F.col(n) > least
    salt = F.pmod(F.xxhash64(*salt_by), F.lit(SALTS)).cast("int")
    dealt = rows.join(F.broadcast(unique.where(hot).select(*on, F.lit(True).alias("_hot"))), on, "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0))).drop("_hot")
    copied = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(hot, F.lit(SALTS - 1)).otherwise(F.lit(0))))).drop(n)
    return dealt.join(copied, [*on, "_salt"], how).drop("_salt")


def semi_join(rows: DataFrame, unique: DataFrame, on: list[str], n: str, salt_by: list[str], max_rows: int) -> DataFrame:
    """``salted_join`` with keys alone, which are broadcast if they are at most ``max_rows``."""
    if unique.limit(max_rows + 1).count() <= max_rows:
        return rows.join(F.broadcast(unique.select(*on)), on, "left_semi")
    return salted_join(rows, unique, on, n, salt_by)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
