"""Sinks: ordered JSON lines, single JSON records, datasets, splits, requests."""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


def write_json(path: str, record: dict) -> None:
    """One record with sorted keys, written beside its place and moved over it, in the store that Spark takes the path for."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("writing needs an active Spark session")
    files.write_text(spark, path, json.dumps(record, sort_keys=True, ensure_ascii=False) + "\n")


@contextlib.contextmanager
def committed(spark: SparkSession, path: str, overwrite: bool = False) -> Iterator[str]:
    """A folder's path to write to, which becomes ``path`` if all goes well and is deleted if not: readers see a whole
    folder or what was there before. Without ``overwrite`` an existing target is an error, found before and after."""
    if not overwrite and files.exists(spark, path):
        raise FileExistsError(f"{path} exists")
    folder, _, name = path.rstrip("/").rpartition("/")
    aside = f"{folder}/.{name}.{uuid.uuid4().hex[:8]}.tmp" if folder else f".{name}.{uuid.uuid4().hex[:8]}.tmp"
    try:
        yield aside
        if overwrite:
            files.replace(spark, aside, path)
        else:
            files.rename(spark, aside, path, overwrite=False)
    except BaseException:
        files.delete(spark, aside)
        raise


def write_json_lines(df: DataFrame, path: str, order: str, mode: str = "errorifexists") -> None:
    """Compact JSON lines with sorted keys, in order: ranges of ``order`` become files in name order, which the readers
    keep. The folder appears once all tasks are done; a failure leaves nothing. Modes: errorifexists, overwrite, append."""
    cols = sorted(c for c in df.columns if c != order)
    rows = df.repartitionByRange(order).sortWithinPartitions(order)
    lines = rows.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))
    if mode == "append":
        return lines.write.mode(mode).text(path)
    if mode not in ("errorifexists", "error", "overwrite"):
        raise ValueError(f"unknown mode: {mode}")
    with committed(df.sparkSession, path, mode == "overwrite") as aside:
        lines.write.text(aside)


def write_record(df: DataFrame, path: str) -> dict:
    """A one-row table as a JSON record."""
    record = df.first().asDict(recursive=True)
    write_json(path, record)
    return record


def write_dataset(cases: DataFrame, labels: DataFrame, metadata: dict, path: str, order: str = "_pos") -> None:
    write_json_lines(cases, f"{path}/cases", order)
    write_json_lines(labels, f"{path}/labels", order)
    write_json(f"{path}/metadata.json", metadata)


def write_split(rows: DataFrame, split: DataFrame, group: str, path: str, **settings) -> None:
    """``train`` and ``validation`` folders of JSON lines by one partitioned write, and ``split.json`` with the
    settings and each side's groups; the target must be new. The groups' list is small by nature."""
    rows.join(split, group).write.partitionBy("split").mode("errorifexists").json(path)
    sides = {r["split"]: sorted(r["groups"]) for r in split.groupBy("split").agg(F.collect_set(F.col(group).cast("string")).alias("groups")).collect()}
    write_json(f"{path}/split.json", settings | {f"{k}_groups": v for k, v in sides.items()})


def write_parquet(df: DataFrame, path: str) -> None:
    """Written beside its place and moved over it: a failed write leaves what was there."""
    with committed(df.sparkSession, path, overwrite=True) as aside:
        df.write.parquet(aside)


def write_requests(payload: DataFrame, path: str) -> None:
    """A ``batch=N`` folder of request JSON for each batch."""
    payload.select("batch", F.to_json(F.struct("tasks")).alias("value")).write.partitionBy("batch").mode("errorifexists").text(path)


def append_features(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
