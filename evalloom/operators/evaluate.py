"""Batch prediction per model and scoring against labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import work_dir


def run_batches(cases: DataFrame, predict: Callable[[str, list[str]], list[bool]]) -> DataFrame:
    """(id, is_robust, valid): ``predict(model_id, problems)`` once for each model, with all its problems.

    The result must be a list of as many exact booleans; anything else, or an exception, makes the whole
    group False and invalid. A model's rows are held by one task: that is the function's contract.
    """
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos", kind="stable")
        n = len(pdf)
        try:
            got = predict(str(pdf["model_id"].iloc[0]), pdf["problem"].tolist())
            fine = type(got) is list and len(got) == n and all(type(x) is bool for x in got)
        except Exception:  # noqa: BLE001 opaque code: its failure is a result
            got, fine = [], False
        return pd.DataFrame({"_pos": pdf["_pos"], "id": pdf["id"], "is_robust": got if fine else [False] * n, "valid": [fine] * n})

    return cases.groupBy("model_id").applyInPandas(one, "_pos long, id string, is_robust boolean, valid boolean")


def constant(model_id: str, problems: list[str]) -> list[bool]:
    """The baseline: everything is robust."""
    return [True] * len(problems)


def first_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, and how many there were (``n_rows``). Summed map-side, no window."""
    rest = [c for c in df.columns if c not in (key, order)]
    g = df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r"), F.count(F.lit(1)).alias("n_rows"))
    return g.select(key, "n_rows", "_r.*")


def score(labels: DataFrame, predictions: DataFrame, malformed: int = 0, by: str | None = None) -> DataFrame:
    """One row (or one for each ``by`` of labels): ``accuracy, coverage, invalid_predictions, n_labels``.

    ``predictions`` is (id, is_robust, valid, _pos). A label is covered by a single valid prediction with
    a boolean; accuracy is over all labels. Invalid: labels not covered, malformed lines, repeated ids and ids
    without label (by group only the first).
    """
    first = first_by_key(predictions.select("id", "is_robust", "valid", "_pos"), "id", "_pos")
    keep = labels.select("id", F.col("is_robust").alias("_y"), *([by] if by else []))
    j = keep.join(first, "id", "left")
    covered = (F.col("n_rows") == 1) & F.coalesce("valid", F.lit(False)) & F.col("is_robust").isNotNull()
    aggs = [
        (F.count_if(covered & (F.col("is_robust") == F.col("_y"))) / F.count(F.lit(1))).alias("accuracy"),
        (F.count_if(covered) / F.count(F.lit(1))).alias("coverage"),
        (F.count(F.lit(1)) - F.count_if(F.coalesce(covered, F.lit(False)))).alias("_uncovered"), F.count(F.lit(1)).alias("n_labels"),
    ]
    if by:
        return j.groupBy(by).agg(*aggs).withColumnRenamed("_uncovered", "invalid_predictions")
    other = first.select("id", "n_rows").join(labels.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("_extra"))
    dup = first.agg(F.count_if(F.col("n_rows") > 1).alias("_dup"))
    one = j.agg(*aggs).crossJoin(other).crossJoin(dup)  # one row each
    return one.select("accuracy", "coverage", (F.col("_uncovered") + malformed + F.col("_dup") + F.col("_extra")).alias("invalid_predictions"), "n_labels")


def extra_ids(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    return predictions.select("id").distinct().join(labels.select("id"), "id", "left_anti")


def uncovered_ids(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    return labels.select("id").join(predictions.select("id").distinct(), "id", "left_anti")


def ingestion_summary(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.count(F.lit(1)).alias("cases"), F.count_if(~F.col("valid")).alias("invalid_predictions"))


def family_accuracy(rows: DataFrame, family: str, correct: str) -> DataFrame:
    """Accuracy over rows and the mean over families of their accuracy."""
    per = rows.groupBy(family).agg(F.avg(F.col(correct).cast("double")).alias("_a"), F.sum(F.col(correct).cast("long")).alias("_k"), F.count(F.lit(1)).alias("_n"))
    return per.agg((F.sum("_k") / F.sum("_n")).alias("row_accuracy"), F.avg("_a").alias("family_accuracy"), F.count(F.lit(1)).alias("n_families"))


def majority_baseline(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """The test accuracy of the training rows' majority class; a tie says True."""
    m = train.agg((2 * F.count_if(F.col(label)) >= F.count(label)).alias("majority"))
    return test.crossJoin(F.broadcast(m)).agg(F.first("majority").alias("majority"), F.avg((F.col(label) == F.col("majority")).cast("double")).alias("accuracy"))


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """``df`` dealt out in ranges of ``order`` and sorted within, with the range (``_part``) and the place in it (``_at``).

    Ranges are drawn from a sample anew each time, so the table is written once.
    """
    t = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    t = t.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")
    path = work_dir(df.sparkSession, "ordered")
    t.write.parquet(path)
    return df.sparkSession.read.schema(t.schema).parquet(path)


def numbered_in_order(df: DataFrame, *order: str, out: str = "pos") -> DataFrame:
    """Global positions from 0 by a unique order. Rows are sorted in ranges and each range adds the sizes
    before it, so no task holds more than its range. Names starting with ``_`` are reserved."""
    t = in_ranges(df, *order)
    sizes = t.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a range
    return t.join(F.broadcast(starts), "_part").withColumn(out, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def running_sums(df: DataFrame, order: str, *columns: str) -> DataFrame:
    """Adds for each column its sum up to the row by a unique ``order`` (``c_c``) and its whole sum (``all_c``), and
    the ``next`` value of ``order``. Ranges add what lies before them, so no task holds more than its range."""
    t = in_ranges(df, order)
    per = t.groupBy("_part").agg(F.min(order).alias("_first"), *[F.sum(c).alias(f"_s_{c}") for c in columns])
    over, all_ = W.orderBy("_part"), W.partitionBy()  # a row a range
    sums = [(F.sum(f"_s_{c}").over(over) - F.col(f"_s_{c}")).alias(f"_b_{c}") for c in columns] + [F.sum(f"_s_{c}").over(all_).alias(f"all_{c}") for c in columns]
    starts = per.select("_part", F.lead("_first").over(over).alias("_next"), *sums)
    inside = W.partitionBy("_part").orderBy("_at")
    got = t.join(F.broadcast(starts), "_part").withColumns({"next": F.coalesce(F.lead(order).over(inside), "_next"), **{f"c_{c}": F.col(f"_b_{c}") + F.sum(c).over(inside) for c in columns}})
    return got.select(*df.columns, "next", *[f"{k}_{c}" for c in columns for k in ("c", "all")])
