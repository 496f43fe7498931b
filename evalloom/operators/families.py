"""Deduplicating rows into cases and families; deterministic selection, shards and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import family_id
from .quality import DataQualityError


def keep_first(df: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """The first (or last) row of each key by ``order``; summed map-side."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    pick = F.max_by if last else F.min_by
    edge = F.max if last else F.min
    g = df.groupBy(*keys).agg(edge(order).alias(order), pick(F.struct(*rest), order).alias("_r"))
    return g.select(*keys, order, "_r.*").select(*df.columns)


def dedup_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return one.agg(F.sum("_n").alias("source_rows"), F.count(F.lit(1)).alias("cases"), (F.sum("_n") - F.count(F.lit(1))).alias("duplicates_removed"))


def families(rows: DataFrame) -> DataFrame:
    """(family_id, dataset_id, problem_id, original_problem, historic_label, source_rows, model_id).

    A row a (dataset, problem) with its text, label and first model by ``_pos``. ``conflicts`` of
    ``quality`` tells keys with several texts or labels.
    """
    g = rows.groupBy("dataset_id", "problem_id").agg(
        F.min("original_problem").alias("original_problem"), F.bool_and("model_is_robust").alias("historic_label"), F.count(F.lit(1)).alias("source_rows"), F.min_by("model_id", "_pos").alias("model_id")
    )
    return g.select(family_id(F.col("dataset_id"), F.col("problem_id")).alias("family_id"), "*")


def hash_order(key: Column) -> Column:
    return F.sha2(key.cast("string"), 256)


def stratified(df: DataFrame, key: str, label: str, k: int, strict: bool = False) -> DataFrame:
    """The first ``k`` rows of each label in hash order, with their rank. Strict mode fails if a label is short.

    Ranked among each task's own first k before the exchange, so a label's rows never meet in one task.
    """
    o = hash_order(F.col(key))
    local = W.partitionBy(label, F.spark_partition_id()).orderBy("_o", key)
    few = df.withColumn("_o", o).withColumn("_l", F.row_number().over(local)).where(F.col("_l") <= k)
    got = few.withColumn("rank", F.row_number().over(W.partitionBy(label).orderBy("_o", key)).cast("long")).where(F.col("rank") <= k).drop("_o", "_l")
    if strict:
        n = {r[0]: r[1] for r in got.groupBy(label).count().collect()}
        if len(n) < 2 or min(n.values()) < k:
            raise DataQualityError(f"fewer than {k} rows for a label: {n}")
    return got


def pilot_first(selected: DataFrame, label: str, n_true: int = 3, n_false: int = 2) -> DataFrame:
    """Adds ``pilot`` to the output of ``stratified``: the first few of either label."""
    return selected.withColumn("pilot", F.when(F.col(label), F.col("rank") <= n_true).otherwise(F.col("rank") <= n_false))


def batches(selected: DataFrame, order: Column, size: int = 5) -> DataFrame:
    """Adds ``batch`` from 1: chunks of ``size`` rows in ``order``. For selections, which are small."""
    return selected.withColumn("batch", (F.floor((F.row_number().over(W.orderBy(order)) - 1) / size) + 1).cast("long"))


def request_payload(batched: DataFrame) -> DataFrame:
    """(batch, tasks): label-free tasks of each batch, ordered by family."""
    return batched.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("family_id", "original_problem"))).alias("tasks"))


def shard(df: DataFrame, key: str, pos: str, n: int, i: int) -> DataFrame:
    """Keys of shard ``i``: distinct keys by first appearance, every ``n``-th from ``i``.

    Only a row a distinct key is ranked.
    """
    from .evaluate import numbered_in_order

    first = df.groupBy(key).agg(F.min(pos).alias(pos))
    return numbered_in_order(first, pos, out="rank").where(F.pmod("rank", F.lit(n)) == i)


def group_split(df: DataFrame, group: str, fraction: float, seed: int = 0) -> DataFrame:
    """(group, split): disjoint groups, the share ``fraction`` (half-even rounding, at least 1 and all but 1) to validation.

    Groups are ordered by a seeded hash. Only groups are ranked.
    """
    from .evaluate import numbered_in_order

    g = df.select(group).distinct().withColumn("_o", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")), 256))
    n = g.count()
    take = min(n - 1, max(1, round(n * fraction)))
    return numbered_in_order(g, "_o", group, out="_r").select(group, F.when(F.col("_r") < take, "validation").otherwise("train").alias("split"))


def fold_assignment(df: DataFrame, group: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """(group, fold): whole groups, stratified by the group's class, dealt in seeded hash order.

    A group's class is its majority label. Within a class groups are dealt round robin, so every fold has
    as many groups of each class as any other, give or take one.
    """
    from .evaluate import numbered_in_order

    g = df.groupBy(group).agg((2 * F.count_if(F.col(label)) >= F.count(F.lit(1))).alias("_c")).withColumn("_o", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")), 256))
    ranked = numbered_in_order(g, "_c", "_o", group, out="_r")
    return ranked.select(group, F.pmod("_r", F.lit(folds)).cast("long").alias("fold"))


def deal(signatures: list[tuple[int, int, int]], folds: int) -> list[tuple[int, list[int]]]:
    """For groups of (rows of class False, rows of class True, how many such groups): (groups dealt to every fold alike,
    folds of the others).

    As many alike groups as there are folds change nothing in the balance, so whole rounds go to all folds. The
    rest are placed one by one, those whose classes differ most first: each goes where the shares of the classes
    then differ least between folds, then where the fewest rows are, then to the first fold.
    """
    total = [sum(s[c] * s[2] for s in signatures) or 1 for c in (0, 1)]
    rows = [[0, 0] for _ in range(folds)]
    out: list[tuple[int, list[int]]] = [(0, [])] * len(signatures)
    for k, (no, yes, n) in enumerate(signatures):
        out[k] = (n // folds, [])
        for r in rows:
            r[0] += no * (n // folds)
            r[1] += yes * (n // folds)

    def unevenness(f: int, add: tuple[int, int]) -> float:
        spread = 0.0
        for c in (0, 1):
            shares = [(r[c] + (add[c] if i == f else 0)) / total[c] for i, r in enumerate(rows)]
            mean = sum(shares) / folds
            spread += (sum((x - mean) ** 2 for x in shares) / folds) ** 0.5
        return round(spread, 12)

    for k in sorted(range(len(signatures)), key=lambda k: (-abs(signatures[k][0] - signatures[k][1]), -sum(signatures[k][:2]), signatures[k])):
        add = signatures[k][:2]
        for _ in range(signatures[k][2] % folds):
            f = min(range(folds), key=lambda f: (unevenness(f, add), sum(rows[f]), f))
            rows[f][0] += add[0]
            rows[f][1] += add[1]
            out[k][1].append(f)
    return out


#: Kinds of groups, by their rows of either class, that are dealt out on the driver at most.
SIGNATURES = 1_000_000


def balanced_folds(df: DataFrame, group: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """(group, fold): whole groups, folds with nearly the same rows of either class.

    Groups with the same rows of either class are alike, so only the numbers of alike groups reach the driver, where ``deal``
    settles how many of them each fold gets; which ones is their seeded hash's matter. Groups are numbered in
    ranges, so neither a large group nor very many alike ones meet in a task. A null label counts as False, a null
    group as a group. Names starting with ``_`` are reserved.
    """
    from .evaluate import numbered_in_order

    if folds < 2:
        raise DataQualityError("folds are 2 at least")
    y = F.coalesce(F.col(label), F.lit(False))
    g = df.groupBy(group).agg(F.count_if(~y).alias("_no"), F.count_if(y).alias("_yes"))
    g = g.withColumn("_o", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(group).cast("string"), F.lit("\x00"))), 256))
    ranked = numbered_in_order(g, "_no", "_yes", "_o", group, out="_r")
    kinds = ranked.groupBy("_no", "_yes").agg(F.count(F.lit(1)).alias("_n"), F.min("_r").alias("_first")).orderBy("_no", "_yes").limit(SIGNATURES + 1).collect()
    if len(kinds) > SIGNATURES:
        raise DataQualityError(f"groups are of more than {SIGNATURES} kinds")
    dealt = deal([(k["_no"], k["_yes"], k["_n"]) for k in kinds], folds)
    plan = df.sparkSession.createDataFrame([(k["_no"], k["_yes"], k["_first"], each, rest) for k, (each, rest) in zip(kinds, dealt)], "_no long, _yes long, _first long, _each long, _rest array<int>")
    at = F.col("_r") - F.col("_first")
    fold = F.when(at < F.col("_each") * folds, F.pmod(at, F.lit(folds))).otherwise(F.get("_rest", (at - F.col("_each") * folds).cast("int")))
    return ranked.join(plan, ["_no", "_yes"]).select(group, fold.cast("long").alias("fold"))


def fold_leakage(assignment: DataFrame, group: str) -> DataFrame:
    """Groups in more than one fold."""
    return assignment.groupBy(group).agg(F.count_distinct("fold").alias("n_folds")).where("n_folds > 1")
