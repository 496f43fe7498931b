"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch, numbered, sized_broadcast, table

_WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(source, weight, source_size, target): the water-filling level over source totals.

    ``sizes`` has one row per source. Sorted by code point (null last), sources weigh ``weights`` in
    rotation and share the total; a target stops at ``max_repeats`` times its source, the excess is
    reshared by weight. With sources ordered by ``max_repeats * size / weight``, those below the level
    are full, and the level is what is left over the weight that is left.
    """
    r = len(weights)
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % r + 1).cast("int")).cast("double"))
    s = s.withColumn("ceiling", F.lit(max_repeats) * F.col("source_size")).withColumn("full_at", F.col("ceiling") / F.col("weight"))
    by_level = W.orderBy("full_at", F.col("source").asc_nulls_last())
    s = s.withColumn("_before", F.coalesce(F.sum("ceiling").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("_left", F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("_all", F.sum("source_size").over(W.partitionBy()))
    s = s.withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_left"))
    level = F.min(F.when(F.col("_level") <= F.col("full_at"), F.struct("full_at", "_before", "_level"))).over(W.partitionBy())["_level"]
    return s.withColumn("_level", level).select(
        "source", "weight", "source_size", F.least(F.col("ceiling").cast("double"), F.coalesce(F.col("_level") * F.col("weight"), F.col("ceiling").cast("double"))).alias("target")
    )


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix", rows_per_run: int = 1000) -> DataFrame:
    """Every row of ``docs`` with ``size, source_size, target, taken, finish``.

    Each source's documents are shuffled by a seeded hash, ``max_repeats`` times in a row. A copy's
    virtual finish time is its source's cumulative words over the source's weight; all copies are ranged
    by finish time and taken while the words so far stay within the budget (the words of all documents); copies
    that finish at the same time are taken together or not at all.
    ``taken`` counts a document's words in the mix, ``finish`` is its first copy's finish time.

    Cumulative words come from hash runs of about ``rows_per_run`` rows: runs are summed first, so no
    window holds a whole source, and the final cut is found in a histogram of finish times before rows
    near it are ranked. A run that one key swells, as rows without id and text may, is cut by row number
    into runs of that size (only there the order isn't by key). Null text has size 0; null sources are one source, last in order; repeated rows
    count each; rows without an id are shuffled by their texts; an empty table gives an empty result.
    Other columns are not read, but for a row number named ``_mix_row``, which is kept; names starting
    with ``_mix`` are reserved.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    row_id = [c for c in docs.columns if c == "_mix_row"]
    if not row_id:
        docs = numbered(docs.select("doc_id", "source", "text"), "_mix_row", Scratch(spark, "rows"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5("text")), F.lit(""))
    key = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 15), 16, 10).cast("long")
    slim = scratch.pin(docs.select("doc_id", "_mix_row", "source", word_count(F.col("text")).alias("size"), key.alias("_mix_key")))
    n, total = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    width = max(1, (1 << 60) * rows_per_run // max(n, 1))
    slim = slim.withColumn("_mix_run", F.floor(F.col("_mix_key") / F.lit(width)).cast("long") if width < 1 << 60 else F.lit(0).cast("long"))

    runs = slim.groupBy("source", "_mix_run").agg(F.count(F.lit(1)).alias("_mix_n")).where(F.col("_mix_n") > 4 * rows_per_run)
    swollen = scratch.pin(runs.select(F.col("source").alias("_s"), F.col("_mix_run").alias("_r"), F.ceil(F.col("_mix_n") / rows_per_run).alias("_k")))
    slim = slim.join(sized_broadcast(swollen, 100_000), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_mix_run") == F.col("_r")), "left")
    slim = slim.withColumn("_mix_cut", F.coalesce(F.pmod(F.xxhash64("_mix_row"), "_k"), F.lit(0))).drop("_s", "_r", "_k")
    runs = scratch.pin(slim.groupBy("source", "_mix_run", "_mix_cut").agg(F.sum("size").alias("_mix_sum")))
    # the running sum over runs: bounded groups again, by cutting each source's runs into blocks
    block = F.floor(F.col("_mix_run") / 1024)
    blocks = runs.groupBy("source", block.alias("_b")).agg(F.sum("_mix_sum").alias("_bs"))
    blocks = blocks.select("source", "_b", (F.sum("_bs").over(W.partitionBy("source").orderBy("_b")) - F.col("_bs")).alias("_b0"))
    r = runs.withColumn("_b", block)
    r = r.withColumn("_r0", F.sum("_mix_sum").over(W.partitionBy("source", "_b").orderBy("_mix_run", "_mix_cut")) - F.col("_mix_sum")).alias("r")
    starts = r.join(blocks.alias("k"), F.col("r.source").eqNullSafe(F.col("k.source")) & (F.col("r._b") == F.col("k._b")))
    starts = starts.select(F.col("r.source"), F.col("r._mix_run"), F.col("r._mix_cut"), (F.col("_r0") + F.col("_b0")).alias("_mix_start"))
    goal = targets(runs.groupBy("source").agg(F.sum("_mix_sum").alias("source_size")), weights, max_repeats)
    plan = scratch.pin(starts.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.source", "_mix_run", "_mix_cut", "_mix_start", "weight", "source_size", "target"))

    inside = W.partitionBy("source", "_mix_run", "_mix_cut").orderBy("_mix_key", "doc_id", "size", "_mix_row")
    placed = slim.withColumn("_mix_in", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0))).alias("d")
    on = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d._mix_run") == F.col("p._mix_run")) & (F.col("d._mix_cut") == F.col("p._mix_cut"))
    placed = placed.join(plan.alias("p"), on).select("doc_id", *row_id, "d.source", "size", "source_size", "target", "weight", (F.col("_mix_start") + F.col("_mix_in")).alias("_mix_cum"))
    placed = scratch.pin(placed)

    # copies of epoch e finish at (e * source_size + cum) / weight; the budget cuts the range-sorted copies
    def at(e) -> Column:
        return (e * F.col("source_size") + F.col("_mix_cum")) / F.col("weight")

    epochs = F.explode(F.array(*[F.lit(e) for e in range(max_repeats)]))
    copies = placed.select("*", epochs.alias("_e")).withColumn("_t", at(F.col("_e")))
    lo, hi, before, last = -1.0, float(copies.agg(F.max("_t")).first()[0] or 0.0), 0, None
    while True:  # zoom into the range of finish times that holds the cut until its rows are few
        here = copies.where((F.col("_t") > lo) & (F.col("_t") <= hi))
        step = (hi - lo) / 1024
        bins = F.greatest(F.lit(0), F.least(F.ceil((F.col("_t") - lo) / step) - 1, F.lit(1023)))
        hist = here.groupBy(bins.alias("_bin")).agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"), F.min("_t").alias("a"), F.max("_t").alias("b")).orderBy("_bin").collect()
        full = None
        for row in hist:
            if before + row["w"] > total:
                full = row
                break
            before, last = before + row["w"], row["b"]
        if full is None or full["a"] == full["b"]:
            break
        if full["n"] <= 10_000:
            ranked = W.orderBy("_t").rangeBetween(W.unboundedPreceding, W.currentRow)  # equal times together
            edge = here.where((F.col("_t") >= full["a"]) & (F.col("_t") <= full["b"])).withColumn("_sum", F.sum("size").over(ranked))
            fits = edge.where(F.col("_sum") + before <= total).agg(F.max("_t")).first()[0]
            last = last if fits is None else fits
            break
        lo, hi = math.nextafter(full["a"], -math.inf), full["b"]
    taken = F.lit(0)
    if last is not None:
        for e in range(max_repeats):
            taken = taken + F.when(at(F.lit(e)) <= last, F.col("size")).otherwise(0)
    scratch.keep(placed)
    return placed.select("doc_id", *row_id, "source", "size", "source_size", "target", taken.cast("long").alias("taken"), at(F.lit(0)).alias("finish"), "weight")


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: one row of ``docs`` per copy taken, with ``size, source_size, target, taken, copy``.

    Rows are numbered, so those that repeat a doc_id or have none are each taken as often as the mix says.
    Columns of ``docs`` with the added names are replaced, in any case of letters; all others are kept, but
    names starting with ``_mix`` or ``_at`` are reserved. Rows of size 0 are never taken.
    """
    added = ("size", "source_size", "target", "taken")
    docs = docs.drop(*added, "copy")
    spark = docs.sparkSession
    own = Scratch(spark, "rows")
    rows = numbered(docs, "_mix_row", own)
    slim = mix(rows, **params).where("taken > 0").select("_mix_row", *[F.col(c).alias(f"_mix_{c}") for c in (*added, "finish", "weight")])
    copies = rows.join(slim, "_mix_row").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), (F.col("_mix_taken") / F.col("_mix_size")).cast("int"))))
    order = copies.withColumn("_mix_at", ((F.col("_mix_copy") - 1) * F.col("_mix_source_size") + F.col("_mix_finish") * F.col("_mix_weight")) / F.col("_mix_weight"))
    order = order.repartitionByRange("_mix_at", "_mix_row").sortWithinPartitions("_mix_at", "_mix_row")
    return order.select(*docs.columns, *[F.col(f"_mix_{c}").alias(c) for c in added], F.col("_mix_copy").alias("copy"))


def op7_mixing(spark, sf_dir):
    """Mixes all documents; ties of finish time break by source, hash and doc_id."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "finish")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+')) AS size,
  coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5("text"), '') AS name FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([1, 2, 3])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
f AS (SELECT *, 3 * source_size AS ceiling, 3 * source_size / weight AS full_at FROM s),
g AS (SELECT *, coalesce(sum(ceiling) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone, sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS total FROM f),
l AS (SELECT min_by((total - gone) / rest, full_at) AS level FROM g WHERE (total - gone) / rest <= full_at),
t AS (SELECT source, source_size, weight, total, least(ceiling::DOUBLE, coalesce((SELECT level FROM l) * weight, ceiling::DOUBLE)) AS target FROM g),
c AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.weight, t.total, sum(d.size) OVER (PARTITION BY d.source ORDER BY ('0x' || substr(md5('mix:' || name), 1, 15))::BIGINT, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum, row_number() OVER () AS r
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT r, size, total, (k * source_size + cum) / weight AS ix FROM c, (VALUES (0), (1), (2)) v(k)),
u AS (SELECT r, size, sum(size) OVER (ORDER BY ix) <= total AS fits FROM e),
n AS (SELECT r, coalesce(sum(size) FILTER (fits), 0)::BIGINT AS taken FROM u GROUP BY r)
SELECT doc_id, size, source_size, target, taken, cum / weight AS finish FROM c JOIN n USING (r)
"""
