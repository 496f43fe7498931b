"""Codes of vector parts: Lloyd's rounds in whole numbers, most distances saved by Yinyang's group bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, salted_join, table

#: Components become floor(SCALE * x).
SCALE = 1024
#: Vectors in a packed block, and values in it, at most.
BLOCK_ROWS, BLOCK_VALUES = 4096, 1 << 19
#: Entries of a codebook that share a lower bound, on average.
GROUP = 16
#: Whole numbers of this size make squared distances that double precision holds exactly, for parts of up to 512.
_EXACT = 1 << 20
#: Sums of larger numbers are carried in pieces of so many bits.
_LIMB = 32


def whole(flat: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): 64-bit integers, or Python's own where these could overflow."""
    big = np.abs(flat).max(initial=0.0)
    if big * SCALE <= _EXACT:
        return np.floor(flat * SCALE).astype(np.int64)
    # a double is a whole number over a power of two, so this is exact at any size
    ratios = (float(x).as_integer_ratio() for x in flat)
    return np.array([SCALE * a // b for a, b in ratios] + [None], object)[:-1]


def _floats(x: np.ndarray, shift: int) -> np.ndarray:
    """x / 2 ** shift in double precision."""
    return x.astype(np.float64) if not shift else np.array([float(int(v) / (1 << shift)) for v in x.ravel()]).reshape(x.shape)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows, in whole numbers."""
    d = x - c
    return (d * d).sum(axis=-1)


def _below(squared: np.ndarray) -> np.ndarray:
    """Square roots, rounded down."""
    return np.nextafter(np.sqrt(np.maximum(squared, 0)).astype(np.float32), np.float32(-np.inf))


@dataclass(frozen=True)
class Book:
    """A part's codebook, its entries in groups, and how far each entry moved in the last round."""

    entries: np.ndarray
    group: np.ndarray
    moved: np.ndarray
    shift: int

    def members(self) -> list[np.ndarray]:
        return [np.flatnonzero(self.group == g) for g in range(int(self.group.max(initial=-1)) + 1)]


def groups(entries: np.ndarray, shift: int, rounds: int = 5) -> np.ndarray:
    """Each entry's group: a few rounds of k-means over the entries, which are few. Any grouping is right."""
    x = _floats(entries, shift)
    n = max(1, len(x) // GROUP)
    centre = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(rounds):
        near = ((x[:, None, :] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        centre = np.array([x[near == g].mean(axis=0) if (near == g).any() else centre[g] for g in range(n)])
    return np.unique(near, return_inverse=True)[1]


def assign(x: np.ndarray, book: Book, entry: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, squared distance, lower bounds, distances computed) of the rows ``x`` after the book has moved.

    ``lower[i, g]`` is at most the distance of row i from every entry of group g but its own. Entries moved by
    ``book.moved``, so a group's bound falls by its greatest move. The own entry's distance is computed anew; a group whose bound is
    above it can't hold a nearer entry nor an equal one, and isn't scanned. Distances are in double precision;
    entries within its error of the least are compared in whole numbers, and the lower index wins a tie.
    """
    n, k = len(x), len(book.entries)
    members = book.members()
    scale = 2.0**-book.shift
    xf, cf = _floats(x, book.shift), _floats(book.entries, book.shift)
    xx, cc = (xf * xf).sum(axis=1), (cf * cf).sum(axis=1)
    drift = np.array([book.moved[m].max(initial=0.0) for m in members])
    lower = np.nextafter((lower.astype(np.float64) - drift[None, :]).astype(np.float32), np.float32(-np.inf))
    best, exact = entry.astype(np.int64), _squared(x, book.entries[entry])
    own = np.sqrt(_floats(exact, 2 * book.shift)) * (1 + 1e-12)
    # the error of |x|^2 - 2xc + |c|^2 in double precision, far from tight
    slack = (xx + cc.max(initial=0.0)) * (x.shape[1] + 4) * 2.0**-50 if k else xx
    old, second, work = best.copy(), np.zeros(lower.shape, np.float32), n
    for g, m in enumerate(members):
        rows = np.flatnonzero(lower[:, g] <= own)
        if not len(rows):
            continue
        work += len(rows) * len(m)
        d = xx[rows, None] - 2 * (xf[rows] @ cf[m].T) + cc[None, m]
        mine = m[None, :] == old[rows, None]
        d[mine] = np.inf  # its own entry's distance is known exactly
        if len(m) > 1:
            least, then = np.partition(d, 1, axis=1)[:, :2].T
        else:
            least, then = d[:, 0], np.full(len(rows), np.inf)
        # should the nearest become the row's own entry, the bound is that of the next; near ties may swap the two
        lower[rows, g], second[rows, g] = _below(least - slack[rows]), _below(then - 3 * slack[rows])
        # pairs that may be nearer than the best so far, or equal to it
        limit = np.minimum(least + 2 * slack[rows], _floats(exact[rows], 2 * book.shift) + slack[rows])
        i, j = np.nonzero(d <= limit[:, None])
        if not len(i):
            continue
        sure = _squared(x[rows[i]], book.entries[m[j]])
        order = np.lexsort((m[j], sure, i)) if sure.dtype != object else np.array(sorted(range(len(i)), key=lambda t: (i[t], sure[t], m[j[t]])))
        first = order[np.concatenate(([True], i[order][1:] != i[order][:-1]))]
        r, e, s = rows[i[first]], m[j[first]], sure[first]
        better = (s < exact[r]) | ((s == exact[r]) & (e < best[r]))
        r, e, s = r[better], e[better], s[better]
        best[r], exact[r] = e, s
    changed = np.flatnonzero(best != old)
    if len(changed):  # a bound leaves out the row's own entry, which is another one now
        now, was = book.group[best[changed]], book.group[old[changed]]
        lower[changed, now] = second[changed, now]
        lower[changed, was] = np.minimum(lower[changed, was], _below((own[changed] * (1 - 1e-9)) ** 2))
    return best.astype(np.int16), exact, lower, work


def _limbs(v: int, n: int) -> list[int]:
    """The number as n pieces, all but the last below 2 ** _LIMB: sums of pieces are pieces of the sum."""
    return [*((v >> _LIMB * i) & ((1 << _LIMB) - 1) for i in range(n - 1)), v >> _LIMB * (n - 1)]


def _sums(x: np.ndarray, entry: np.ndarray, limbs: int) -> Iterator[tuple[int, int, list[int]]]:
    """(entry, rows, sums of components in limbs) of the entries that have rows."""
    order = np.argsort(entry, kind="stable")
    ids, at = np.unique(entry[order], return_index=True)
    total = np.add.reduceat(x[order], at, axis=0)
    for e, n, row in zip(ids, np.diff(np.append(at, len(x))), total):
        yield int(e), int(n), [piece for v in row for piece in _limbs(int(v), limbs)]


class _State:
    """A block's rows between rounds: ids' bytes, components, entries and bounds a part."""

    def __init__(self, flat: bytes, entry: bytes | None, lower: bytes | None, parts: int, width: int, books: list[Book], kind: str):
        x = np.frombuffer(flat, kind).astype(np.float64)
        self.x = whole(x).reshape(-1, parts, width)
        n = len(self.x)
        if entry is None:
            self.entry = np.zeros((parts, n), np.int16)
            self.lower = [np.full((n, int(b.group.max(initial=0)) + 1), -np.inf, np.float32) for b in books]
        else:
            self.entry = np.frombuffer(entry, np.int16).reshape(parts, n)
            held, self.lower, at = np.frombuffer(lower, np.float32), [], 0
            for b in books:
                t = int(b.group.max(initial=0)) + 1
                self.lower.append(held[at : at + n * t].reshape(n, t))
                at += n * t


def _rounds(parts: int, width: int, limbs: int, books, kind: str, last: bool):
    """One assignment of blocks: their new state and, but for the last, their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = books.value
        for batch in batches:
            for r in range(batch.num_rows):
                flat, entry, lower = (batch.column(c)[r].as_py() for c in ("flat", "entry", "lower"))
                s = _State(flat, entry, lower, parts, width, shared, kind)
                entries, lowers, error, rows = [], [], 0, []
                for p, book in enumerate(shared):
                    e, d, low, _ = assign(s.x[:, p], book, s.entry[p].astype(np.int64), s.lower[p])
                    entries.append(e), lowers.append(low)
                    error = error + d
                    if not last:
                        rows += [(p, *t) for t in _sums(s.x[:, p], e, limbs)]
                n = len(s.x)
                state = [pa.array([x], pa.binary()) for x in (None if last else flat, None if last else np.stack(entries).tobytes(), None if last else np.concatenate([x.ravel() for x in lowers]).tobytes())]
                sums = pa.array([[{"part": p, "entry": e, "n": k, "total": t} for p, e, k, t in rows]], pa.list_(_SUM))
                codes = np.stack(entries, axis=1)
                hexes = ["".join(f"{v:02x}" for v in row) for row in codes.tolist()] if last else []
                errors = [int(v) if int(v) < 1 << 63 else None for v in np.atleast_1d(error)] if last and n else []
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(r, 1), batch.column("labels").slice(r, 1), *state, sums, pa.array([hexes], pa.list_(pa.string())), pa.array([errors], pa.list_(pa.int64()))], ["ids", "labels", "flat", "entry", "lower", "sums", "codes", "errors"])

    return run


_SUM = pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])
_SUM_SQL = "array<struct<part:int,entry:int,n:long,total:array<long>>>"


def _packer(width: int, kind: str):
    """Rows into blocks of bounded size, within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(width, 1)))
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                b = batch.slice(at, most)
                flat = np.zeros((b.num_rows, width), kind)
                vectors = b.column("embedding")
                size = np.diff(vectors.offsets.to_numpy())
                values = vectors.flatten().to_numpy(zero_copy_only=False)
                flat[np.arange(width)[None, :] < size[:, None]] = values
                one = lambda c: pa.array([b.column(c).to_pylist()], pa.list_(b.schema.field(c).type))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([one("vec_id"), one("label"), pa.array([flat.tobytes()], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.binary())], ["ids", "labels", "flat", "entry", "lower"])

    return run


def quantise(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code array<int> as hex digits ``code``, error), the parts' final codebooks).

    Every vector is kept in a packed block of a written table, with each part's entry and a lower bound for each
    group of entries; a round reads the blocks with the codebooks (a broadcast of ``entries`` x vector's length),
    scans the groups whose bounds fail, and writes the blocks anew with their sums, which Spark adds by (part, entry).
    The driver holds codebooks alone: ``entries`` rows a part.

    Dropped: vectors that are null or hold null or non-finite components. The first codebooks are the parts of the
    ``entries`` smallest vec_ids (repeated ids by their components, null ids last); fewer vectors make shorter
    codebooks. Vectors are cut into equal parts as if padded with zeros to the longest one's length and a
    multiple of ``parts``. Rows that repeat an id are coded each; an error beyond 64 bits is null; an empty table
    gives none, and empty codebooks. Other columns are not read. ``entries`` is at most 256: two hex digits.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "codes")
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    v = vectors.select("vec_id", "embedding", "label")
    if kind not in ("float", "double"):
        v, kind = v.withColumn("embedding", F.col("embedding").cast("array<double>")), "double"
    x = F.col("embedding")
    v = v.where(x.isNotNull() & ~F.coalesce(F.exists(x, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))), F.lit(True)))
    longest, most = v.agg(F.max(F.size("embedding")), F.max(F.array_max(F.transform("embedding", lambda y: F.abs(y.cast("double")))))).first()
    if longest is None:
        return v.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), [np.zeros((0, 0), np.int64)] * parts
    width = max(1, -(-longest // parts))
    exact = (most or 0.0) * SCALE <= _EXACT and width <= 512
    limbs = 1 if exact else max(2, -(-int(float(most or 0) * SCALE if (most or 0) < 1e300 else 2.0**1020).bit_length() // _LIMB) + 2)
    shift = 0 if exact else max(0, int(np.frexp(most)[1]) + 10)
    numpy_kind = "<f4" if kind == "float" else "<f8"
    first = v.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    start = np.zeros((len(first), parts * width))
    for i, r in enumerate(first):
        start[i, : len(r[0])] = r[0]
    start = whole(start.ravel()).reshape(len(first), parts, width)
    if not exact:
        start = start.astype(object)
    books = [Book(np.ascontiguousarray(start[:, p]), groups(start[:, p], shift), np.zeros(len(first)), shift) for p in range(parts)]
    ids, labels = v.schema["vec_id"].dataType.simpleString(), v.schema["label"].dataType.simpleString()
    held = ["ids", "labels", "flat", "entry", "lower"]
    schema = f"ids array<{ids}>, labels array<{labels}>, flat binary, entry binary, lower binary"
    state = scratch.pin(v.mapInArrow(_packer(parts * width, numpy_kind), schema))
    step = f"{schema}, sums {_SUM_SQL}, codes array<string>, errors array<long>"
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        then = scratch.pin(state.select(*held).mapInArrow(_rounds(parts, width, limbs, shared, numpy_kind, False), step))
        scratch.drop(state)
        books = _moved(then, books, width, limbs)
        state = then
    shared = spark.sparkContext.broadcast(books)
    done = scratch.pin(state.select(*held).mapInArrow(_rounds(parts, width, limbs, shared, numpy_kind, True), step).select("ids", "labels", "codes", "errors"))
    scratch.keep(done)
    row = F.explode(F.arrays_zip("ids", "labels", "codes", "errors")).alias("r")
    got = done.select(row).select(F.col("r.ids").alias("vec_id"), F.col("r.labels").alias("label"), F.col("r.codes").alias("code"), F.col("r.errors").alias("error"))
    return got, [b.entries for b in books]


def _moved(state: DataFrame, books: list[Book], width: int, limbs: int) -> list[Book]:
    """The codebooks after a round: entries are the floors of their rows' means. Sums are added by (part, entry) on
    every task first; the driver gets a row an entry."""
    s = state.select(F.explode("sums").alias("s")).select("s.*")
    n = width * limbs
    cols = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(n)]
    got = s.groupBy("part", "entry").agg(F.sum("n").alias("n"), *cols).collect()
    new = [b.entries.copy() for b in books]
    for r in got:
        for i in range(width):
            total = sum(int(r[f"t{i * limbs + j}"]) << _LIMB * j for j in range(limbs))
            new[r["part"]][r["entry"], i] = total // int(r["n"])
    out = []
    for b, entries in zip(books, new):
        moved = np.sqrt(_floats(_squared(entries, b.entries), 2 * b.shift)) * (1 + 1e-9)
        out.append(Book(entries, b.group, moved, b.shift))
    return out


def digest(books: list[np.ndarray]) -> str:
    """The SHA-256 of all components by part, entry and place."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def op13_codes(spark, sf_dir):
    """All embeddings in four parts of 256 entries after four rounds. A label's errors are added on every task first."""
    got, books = quantise(table(spark, sf_dir, "embeddings"))
    per = got.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    per = per.select(F.xxhash64(F.coalesce(F.col("label").cast("string"), F.lit(""))).alias("_h"), F.col("label").alias("_label"), "label_error", "_n")
    rows = got.withColumn("_h", F.xxhash64(F.coalesce(F.col("label").cast("string"), F.lit(""))))
    both = salted_join(rows, per, ["_h"], "_n", ["vec_id"]).where(F.col("label").eqNullSafe(F.col("_label")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


_ROUNDS = 4
_NEAR = """a{i} AS (SELECT r, part, min(struct_pack(d := list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c), e := entry)) AS best FROM p JOIN c{i} USING (part) GROUP BY r, part)"""
_MOVE = """m{i} AS (SELECT part, entry, list(v ORDER BY i) AS c FROM (SELECT p.part, a.best.e AS entry, i, floor(sum(x[i]) / count(*)) AS v FROM p JOIN a{i} a USING (r, part), range(1, 1 + len(x)) t(i) GROUP BY p.part, a.best.e, i) GROUP BY part, entry),
c{j} AS (SELECT part, entry, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} m USING (part, entry))"""
SQL = (
    """WITH k AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, vec_id, part, e[part * (len(e) // 4) + 1 : (part + 1) * (len(e) // 4)] AS x FROM k, range(4) t(part)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < 256),
"""
    + ",\n".join(f"{_NEAR.format(i=i)},\n{_MOVE.format(i=i, j=i + 1)}" for i in range(_ROUNDS))
    + f""",
{_NEAR.format(i=_ROUNDS)},
o AS (SELECT r, string_agg(format('{{:02x}}', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{_ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS digest FROM (SELECT part, entry, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM c{_ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM k JOIN o USING (r), h"""
)
