"""Digests of sequences that can be made in pieces: what the order of rows is counts, where they lie doesn't."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The modulus (a Mersenne prime) and the two bases of the polynomials.
PRIME = (1 << 61) - 1
BASES = (1_000_003_000_019, 1_700_000_000_000_029)


def row_hash(*columns: str) -> Column:
    """The MD5 of a row's columns as strings, null apart from empty."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]))


def fold(values: list[int], base: int) -> tuple[int, int]:
    """(base ** n, sum of values[i] * base ** (n - 1 - i)), modulo ``PRIME``: what a run of rows does to a digest."""
    power, total = 1, 0
    for v in values:
        power, total = power * base % PRIME, (total * base + v) % PRIME
    return power, total


def after(one: tuple[int, int], two: tuple[int, int]) -> tuple[int, int]:
    """A run and the run that follows it, as one run. Associative, but not commutative."""
    return one[0] * two[0] % PRIME, (one[1] * two[0] + two[1]) % PRIME


def sequence_digest(df: DataFrame, order: list[str], columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., n_rows, digest_1, digest_2): digests of the rows' ``columns`` in ``order``, for each group if ``by`` is given.

    A row is the first 15 hex digits of its MD5 for the first polynomial and the next 15 for the second, whose
    values at fixed bases are the digests (decimal numbers). Rows are sorted in ranges of (by, order), so a group
    may span many tasks and is in no single one; each task folds its run of every group, and the runs, a row a group
    and range, are put together in the ranges' order. Rows that ``order`` doesn't tell apart follow by their hash,
    so the result never depends on how rows lie. Without rows there is no result row. ``_s`` names are reserved.
    """
    by = by or []
    h = row_hash(*columns)
    part = lambda at: F.conv(F.substring("_sh", at, 15), 16, 10).cast("long")
    keyed = df.select(*[F.col(c).alias(f"_sb{i}") for i, c in enumerate(by)], *[F.col(c).alias(f"_so{i}") for i, c in enumerate(order)], h.alias("_sh"))
    keys = [c for c in keyed.columns if c.startswith(("_sb", "_so"))] + ["_sh"]
    group = [f"_sb{i}" for i in range(len(by))]
    t = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    t = t.select(*group, part(1).alias("_s1"), part(16).alias("_s2"), F.spark_partition_id().alias("_sp"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema.fields[: len(group)])
    schema = (f"{kinds}, " if kinds else "") + "_sp int, _sn long, _p1 decimal(20,0), _h1 decimal(20,0), _p2 decimal(20,0), _h2 decimal(20,0)"
    runs = t.mapInArrow(_folder(group), schema)
    per = runs.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_sp", "_sn", "_p1", "_h1", "_p2", "_h2"))).alias("_r"))  # a row a range

    def whole(k: int) -> Column:
        p = F.lit(PRIME).cast("decimal(20,0)")
        return F.aggregate("_r", F.lit(0).cast("decimal(20,0)"), lambda s, r: ((s.cast("decimal(38,0)") * r[f"_p{k}"] + r[f"_h{k}"]) % p).cast("decimal(20,0)")).cast("string").alias(f"digest_{k}")

    n = F.aggregate("_r", F.lit(0).cast("long"), lambda s, r: s + r["_sn"]).alias("n_rows")
    named = [F.col(f"_sb{i}").alias(c) for i, c in enumerate(by)]
    got = per.select(*named, n, whole(1), whole(2))
    return got if by else got.where("n_rows > 0")


def _folder(group: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's rows are sorted, so a group's are one run, which may go on in the next batch."""
        key, held, schema = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            schema = b.schema
            one, two, p = (b.column(c).to_pylist() for c in ("_s1", "_s2", "_sp"))
            keys = list(zip(*(b.column(c).to_pylist() for c in group))) if group else [()] * b.num_rows
            at = 0
            while at < len(keys):
                to = at + 1
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                mine = (to - at, fold(one[at:to], BASES[0]), fold(two[at:to], BASES[1]))
                if held is not None and key == (keys[at], p[at]):
                    held = (held[0] + mine[0], after(held[1], mine[1]), after(held[2], mine[2]))
                else:
                    if held is not None:
                        yield _run(group, schema, key, held)
                    key, held = (keys[at], p[at]), mine
                at = to
        if held is not None:
            yield _run(group, schema, key, held)

    return run


def _run(group: list[str], schema: pa.Schema, key: tuple, held: tuple) -> pa.RecordBatch:
    number = pa.decimal128(20, 0)
    cols = [pa.array([v], schema.field(c).type) for c, v in zip(group, key[0])]
    cols += [pa.array([key[1]], pa.int32()), pa.array([held[0]], pa.int64()), *(pa.array([Decimal(x)], number) for x in (*held[1], *held[2]))]
    return pa.RecordBatch.from_arrays(cols, [*group, "_sp", "_sn", "_p1", "_h1", "_p2", "_h2"])
