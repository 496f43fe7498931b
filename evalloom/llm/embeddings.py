"""Cosine links between all embeddings from int8 tile products with error bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .scratch import Scratch, table

#: Vectors in a packed block at most; a tile pairs two blocks, so what is shuffled falls as blocks grow.
BLOCK_ROWS = 32768
#: Components in a packed block at most; so blocks of long vectors have fewer rows.
BLOCK_VALUES = 1 << 22
#: Small tables still get so many blocks, so tiles spread over tasks.
LEAST_BLOCKS = 16
#: Products held at a time.
_STRIP = 1 << 22


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and error norm of unit rows: ``x = code * scale + e`` with ``|e| <= err``."""
    scale = np.abs(x).max(axis=1) / 127
    code = np.rint(x / scale[:, None]).astype(np.int8)
    err = np.sqrt(((x - code * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    return code, scale, err


def tile_links(xa: np.ndarray, xb: np.ndarray, threshold: float, same: bool, va: np.ndarray | None = None, vb: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Links between unit rows of two blocks: counts for rows of a and b, forest edges (i, j), pairs recomputed.

    With unit x = qs + e, |x.y - qs.qt| <= |e| + |f| + |e||f| for the errors e, f of x and y. Products of
    int8 codes of up to 1,040 components are exact in float32, so the bound is rigorous; pairs whose
    interval holds the threshold are recomputed in double precision. Within a tile, links become a
    spanning forest over its rows, at most one edge a row. Rows with equal ids in ``va`` and ``vb`` aren't linked.
    """
    (ca, sa, ea), (cb, sb, eb) = quantise(xa), quantise(xb)
    wide = np.float32 if xa.shape[1] <= 1040 else np.float64
    cbt = cb.T.astype(wide)
    na, nb = np.zeros(len(xa), np.int64), np.zeros(len(xb), np.int64)
    root = np.arange(len(xa) + len(xb))  # union-find over rows of both blocks
    off = 0 if same else len(xa)
    edges: list[np.ndarray] = []
    redone = 0
    strip = max(1, _STRIP // max(len(xb), 1))
    for lo in range(0, len(xa), strip):
        hi = min(lo + strip, len(xa))
        dot = (ca[lo:hi].astype(wide) @ cbt) * sa[lo:hi, None].astype(wide)
        dot *= sb[None, :].astype(wide)
        # |e| + |f| + |e||f|; 4e-6 covers the roundings: two of scaling, those of the bound, all below 2 ** -22
        f32 = lambda x: np.nextafter(x.astype(np.float32), np.float32(np.inf))
        e, f = f32(ea[lo:hi, None]), f32(eb[None, :])
        slack = e * f
        slack += e
        slack += f + np.float32(4e-6)
        i, j = np.nonzero(dot + slack >= threshold)
        if same:
            up = j > i + lo
            i, j = i[up], j[up]
        if va is not None:
            other = va[i + lo] != vb[j]
            i, j = i[other], j[other]
        if not len(i):
            continue
        sure = dot[i, j] - slack[i, j] >= threshold
        check = np.flatnonzero(~sure)
        redone += len(check)
        for c in range(0, len(check), 1 << 16):
            k = check[c : c + (1 << 16)]
            sure[k] = np.einsum("ij,ij->i", xa[i[k] + lo], xb[j[k]]) >= threshold
        i, j = i[sure] + lo, j[sure]
        np.add.at(na, i, 1)
        np.add.at(nb, j, 1)
        if len(i):
            edges.append(_forest(root, i, j + off))
    return na, nb, np.concatenate(edges) if edges else np.zeros((0, 2), np.int64), redone


def _forest(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edges among (a, b) that join components of ``root`` (updated in place)."""
    kept = []
    while len(a):
        ra, rb = root[a], root[b]
        hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
        open_ = hi != lo
        a, b, hi, lo = a[open_], b[open_], hi[open_], lo[open_]
        if not len(a):
            break
        # every larger root takes one edge to a smaller one
        order = np.lexsort((lo, hi))
        first = order[np.concatenate(([True], hi[order][1:] != hi[order][:-1]))]
        kept.append(np.stack((a[first], b[first]), axis=1))
        link = np.arange(len(root))
        link[hi[first]] = lo[first]
        while True:
            nxt = link[link]
            if (nxt == link).all():
                break
            link = nxt
        root[:] = link[root]
    return np.concatenate(kept) if kept else np.zeros((0, 2), np.int64)


def _pack(t: pa.Table) -> pa.Table:
    ids = t.column("vec_id").to_numpy()
    flat = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return pa.table({"dim": t.column("dim").slice(0, 1), "block": t.column("block").slice(0, 1), "ids": [ids.astype(np.int64).tobytes()], "data": [flat.tobytes()]},
                    schema=pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("data", pa.binary())]))


def _tiler(threshold: float, dtype: str):
    def unit(data: bytes, dim: int) -> np.ndarray:
        x = np.frombuffer(data, dtype).reshape(-1, dim).astype(np.float64)
        x /= np.abs(x).max(axis=1)[:, None]  # so that no square overflows or vanishes
        return x / np.sqrt((x * x).sum(axis=1))[:, None]

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                dim, ia, da, ib, db, same = (batch.column(k)[r].as_py() for k in range(6))
                va = np.frombuffer(ia, np.int64)
                xa = unit(da, dim)
                vb, xb = (va, xa) if same else (np.frombuffer(ib, np.int64), unit(db, dim))
                na, nb, edges, _ = tile_links(xa, xb, threshold, same, va, vb)
                both = np.concatenate((va, vb))
                ids, n = np.concatenate((va, vb)), np.concatenate((na, nb))
                some = n > 0
                out_a = np.concatenate((ids[some], both[edges[:, 0]]))
                out_b = np.concatenate((np.zeros(some.sum(), np.int64), both[edges[:, 1]]))
                out_n = np.concatenate((n[some], np.zeros(len(edges), np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(out_a), pa.array(out_b), pa.array(out_n)], ["a", "b", "n"])

    return run


def cosine_links(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding)``.

    All vectors are compared, block by block: vectors are hashed into packed blocks of bounded size, each
    unordered pair of blocks is one tile, and a tile returns counts and a spanning forest, so a group of
    near copies costs its rows and not its pairs in what is shuffled. Tiles that hold pairs near the
    threshold recompute just those in double precision.

    Ids are whole numbers. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    vectors of different length. A null vec_id stands alone. Rows that repeat a vec_id are compared each but not
    with each other, and share their links' number; other columns are not read; an empty table gives none.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "cosine")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    kind = v.schema["embedding"].dataType.elementType.simpleString()
    if kind not in ("float", "double"):
        v, kind = v.withColumn("embedding", F.col("embedding").cast("array<double>")), "double"
    fine = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    n, most = good.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not n:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    blocks = max(LEAST_BLOCKS if n > LEAST_BLOCKS * 32 else 1, -(-n // min(BLOCK_ROWS, max(1, BLOCK_VALUES // most))))
    # dealt by row too: rows of one id may be very many
    packed = good.withColumns({"dim": F.size("embedding"), "block": F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks))})
    packed = scratch.pin(packed.groupBy("dim", "block").applyInArrow(_pack, "dim int, block long, ids binary, data binary"))
    left, right = (packed.select("dim", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "ids", "data")]) for s in "ab")
    # the grid of tiles: each block's numbers of the blocks from it on, so that every tile is dealt out on its own
    grid = packed.select("dim", F.col("block").alias("block_a")).repartition("dim", "block_a").withColumn("block_b", F.explode(F.sequence(F.col("block_a"), F.lit(blocks - 1).cast("long"))))
    tiles = grid.join(left, ["dim", "block_a"]).join(right, ["dim", "block_b"])
    tiles = tiles.select("dim", "ids_a", "data_a", "ids_b", "data_b", (F.col("block_a") == F.col("block_b")).alias("same"), "block_a", "block_b")
    tiles = tiles.repartition("dim", "block_a", "block_b").drop("block_a", "block_b")
    got = scratch.pin(tiles.mapInArrow(_tiler(threshold, "float32" if kind == "float" else "float64"), "a long, b long, n long"))
    counts = got.where("n > 0").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    comp = connected(got.where("n = 0").select("a", "b"), scratch)
    out = v.select("vec_id").join(counts, "vec_id", "left").join(comp.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    cid = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), cid.alias("component_id"), F.coalesce(F.col("vec_id") == cid, F.lit(True)).alias("kept"))


def op4_embeddings(spark, sf_dir):
    """All embeddings at cosine 0.9."""
    return cosine_links(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE g AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) e FROM embeddings),
h AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) n FROM g),
l AS (SELECT a.vec_id a, b.vec_id b FROM h a JOIN h b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r(v, w) AS (SELECT vec_id, vec_id FROM g UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.w),
c AS (SELECT v, min(w) m FROM r GROUP BY v)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, m AS component_id, m = vec_id AS kept FROM g JOIN c ON c.v = vec_id
"""
