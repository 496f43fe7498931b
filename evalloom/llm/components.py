"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, least_hot, salted_join


def _mins(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))


def _state(arcs: DataFrame) -> tuple[bool, bool]:
    """(whether every node has one smaller neighbour that has none itself: then components are told; whether a node has
    so many neighbours that they must not meet)."""
    ends = arcs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"), F.count(F.lit(1)).alias("n"))
    stars = F.coalesce(F.bool_and((F.col("up") == 0) | ((F.col("up") == 1) & (F.col("least") == 1))), F.lit(True))
    done, most, total = per.agg(stars, F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return done, most > least_hot(total)


def _with_mins(arcs: DataFrame, hubs: bool) -> DataFrame:
    """Each arc with the least of its first node and that one's neighbours; hubs have their arcs dealt out."""
    mins = _mins(arcs)
    return salted_join(arcs, mins, ["u"], "n", ["v"]) if hubs else arcs.join(mins.drop("n"), "u")


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reached.

    Each round joins a small per-node minimum (partially aggregated) to the edges; where a node has very many
    links they are dealt out over tasks. Every round is cut off by a written table.
    """
    now = scratch.pin(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        done, hubs = _state(now)
        if done:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_mins(both, hubs).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.pin(large)
        small = _with_mins(large, hubs)
        small = small.select("u", "m").unionByName(small.select(F.col("v").alias("u"), "m")).where("u <> m").select("u", F.col("m").alias("v")).distinct()
        then = scratch.pin(small)
        scratch.drop(large, now)
        now = then
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
