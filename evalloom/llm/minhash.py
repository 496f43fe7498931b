"""b-bit MinHash near-duplicate documents with exact confirmation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .scratch import Scratch, numbered, salted_join, sized_broadcast, table
from .words import SPACED, hashed, mix, shards, utf8


#: The chance that no band of a pair at the threshold agrees, and how many minima may be spent on it.
BAND_MISS, MAX_MINIMA = 1.25e-5, 160


def banded(percent: int, rows: int) -> int:
    """The least even number of bands of ``rows`` that miss a pair at ``percent`` with at most ``BAND_MISS``."""
    miss = 1 - (min(percent, 99) / 100) ** rows
    return 2 * math.ceil(math.log(BAND_MISS) / math.log(miss) / 2)


@dataclass(frozen=True)
class Near:
    """``shingle`` words, Jaccard ``percent`` of the union at least; ``bands`` of ``rows`` minima; ``bits`` kept of each.

    Not given, ``rows`` is the largest, and ``bands`` the least even number, that miss a pair at the
    threshold with a probability of at most ``BAND_MISS`` within ``MAX_MINIMA`` minima: 24 bands of 6 at
    0.85 (1.2e-5), 30 of 5 at 0.8 (6.7e-6).
    A pair is dropped before confirmation only if a pair at the threshold would agree so seldom with
    probability ``miss``.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 0
    rows: int = 0
    bits: int = 4
    miss: float = 1e-9
    star_rounds: int = 2
    tile: int = 512
    tile_items: int = 1 << 20

    def __post_init__(self):
        if not self.bands:
            choices = [(banded(self.percent, r), r) for r in ([self.rows] if self.rows else range(1, 17))]
            bands, rows = max((x for x in choices if x[0] * x[1] <= MAX_MINIMA), key=lambda x: x[1], default=choices[0])
            object.__setattr__(self, "bands", bands)
            object.__setattr__(self, "rows", rows)
        elif not self.rows:
            raise ValueError("bands need rows")

    @property
    def k(self) -> int:
        return self.bands * self.rows

    def least_matches(self) -> int:
        p = self.percent / 100
        p += (1 - p) / 2**self.bits
        tail, m = 0.0, 0
        while True:
            tail += math.comb(self.k, m) * p**m * (1 - p) ** (self.k - m)
            if tail > self.miss:
                return m
            m += 1


def shingle_hashes(words: np.ndarray, ptr: np.ndarray, size: int) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its ``size``-word shingles; of all words if there are fewer."""
    n = len(words)
    w = words
    if n >= size:
        sh = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            sh = mix(sh + w[k : n - size + 1 + k] + np.uint64(k + 1))
    out = []
    for a, b in zip(ptr[:-1], ptr[1:]):
        if b - a >= size:
            out.append(np.unique(sh[a : b - size + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for k in range(a, b):
                h = mix(h + w[k] + np.uint64(k - a + 101))
            out.append(h + np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_RNG = np.random.default_rng(20240607)
_MUL = _RNG.integers(1 << 62, 1 << 63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 1 << 63, 512, dtype=np.uint64)


def minima(sets: list[np.ndarray], k: int) -> np.ndarray:
    """(k, n) minima of non-empty sets."""
    flat = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    out = np.empty((k, len(sets)), np.uint64)
    for i in range(k):
        out[i] = np.minimum.reduceat((flat ^ _XOR[i]) * _MUL[i], at)
    return out


def _signer(p: Near):
    per = 64 // p.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in shards(batch, "text"):
                words, ptr = hashed(*utf8(b.column(1)), SPACED)
                sets = shingle_hashes(words, ptr, p.shingle)
                some = [i for i, s in enumerate(sets) if len(s)]
                n = np.array([len(s) for s in sets], np.int64)
                fp = np.zeros((2, len(sets)), np.uint64)
                bands: list = [None] * len(sets)
                sigs: list = [None] * len(sets)
                if some:
                    m = minima([sets[i] for i in some], p.k)
                    flat, at = np.concatenate([sets[i] for i in some]), np.concatenate(([0], np.cumsum(n[some])))[:-1]
                    fp[0, some] = np.add.reduceat(mix(flat ^ np.uint64(0x1234567)), at)
                    fp[1, some] = np.add.reduceat(mix(flat + np.uint64(0x89ABCDEF)), at)
                    key = np.zeros((p.bands, len(some)), np.uint64)
                    for r in range(p.rows):
                        key = mix(key + m[r :: p.rows] + np.arange(p.bands, dtype=np.uint64)[:, None])
                    low = mix(m) >> np.uint64(64 - p.bits)
                    packed = np.zeros((-(-p.k // per), len(some)), np.uint64)
                    for i in range(p.k):
                        packed[i // per] |= low[i] << np.uint64(p.bits * (i % per))
                    for j, i in enumerate(some):
                        bands[i], sigs[i] = key[:, j].view(np.int64), packed[:, j].view(np.int64)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).cast(pa.int64()), pa.array(n), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), pa.array(bands, longs), pa.array(sigs, longs)],
                    ["doc_id", "n_shingles", "f1", "f2", "bands", "sig"],
                )

    return run


def _set_maker(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in shards(batch, "text"):
                sets = shingle_hashes(*hashed(*utf8(b.column(1)), SPACED), size)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["rep", "items"])

    return run


def _matches(a, b, p: Near):
    """How many of the k packed fields of two signatures are equal."""
    ones = sum(1 << (p.bits * i) for i in range(64 // p.bits))
    ones -= (ones >> 63) << 64

    def differ(x, y):
        z = x.bitwiseXOR(y)
        for s in range(p.bits.bit_length() - 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, 1 << s))
        return F.bit_count(z.bitwiseAND(F.lit(ones)))

    return F.lit(p.k) - F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda s, x: s + x)


def _open_buckets(bc: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (key, rep, comp) of the buckets that hold two components."""
    active = bc.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("z"), F.count(F.lit(1)).alias("n")).where("a < z").select("key", "n")
    return salted_join(bc, scratch.pin(active), ["key"], "n", ["rep"])


def _counted(pairs: DataFrame, scratch: Scratch, side: str = "lead") -> tuple[DataFrame, tuple[int, int]]:
    """(lead, n): the pairs of each leader (or of each text of the other ``side``), with their sum and maximum."""
    n = scratch.pin(pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")))
    return n, n.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()


def _joined(pairs: DataFrame, of: DataFrame, value: str, leaders: tuple[DataFrame, tuple[int, int]], others: tuple[DataFrame, tuple[int, int]] | None = None) -> DataFrame:
    """``pairs(lead, rep)`` with ``value`` of both as ``value_a`` and ``value_b``. A leader of very many pairs has them dealt out by
    the other one; that one is in a pair a band at most, unless ``others`` counts its pairs."""
    n, known = leaders
    lead = of.select(F.col("rep").alias("lead"), F.col(value).alias(f"{value}_a")).join(n, "lead")
    both = salted_join(pairs, lead, ["lead"], "n", ["rep"], known=known)
    rep = of.select("rep", F.col(value).alias(f"{value}_b"))
    return salted_join(both, rep.join(others[0], "rep"), ["rep"], "n", ["lead"], known=others[1]) if others else both.join(rep, "rep")


def _contract(comp: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``comp(rep, met, comp)`` with the components that ``links(comp_a, comp_b)`` join made one. A component of very many
    members has them dealt out."""
    moved = scratch.pin(connected(links.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")), scratch).withColumnRenamed("node", "comp"))
    sizes = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    return scratch.pin(salted_join(comp, scratch.pin(moved.join(sizes, "comp")), ["comp"], "n", ["rep"], how="left").select("rep", "met", F.coalesce("component", "comp").alias("comp")))


def tile_forest(comp: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], p: Near) -> list[tuple[int, int]]:
    """Links among the rows of one tile that join different components: a spanning forest.

    Signatures rule pairs out first; the rest are confirmed on full sets. Rows are walked one by one
    against all earlier ones, so memory stays linear in the tile.
    """
    ones = np.uint64(sum(1 << (p.bits * i) for i in range(64 // p.bits)))
    _, root = np.unique(comp, return_inverse=True)
    least = p.least_matches()
    out = []
    for i in range(1, len(comp)):
        z = sig[:i] ^ sig[i]
        for s in range(p.bits.bit_length() - 1):
            z = z | (z >> np.uint64(1 << s))
        match = p.k - np.bitwise_count(z & ones).sum(axis=1)
        order = np.flatnonzero((match >= least) & (root[:i] != root[i]))
        for j in order[np.argsort(-match[order], kind="stable")]:
            if root[j] == root[i]:
                continue
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) * 100 < p.percent * max(len(a), len(b)):
                continue
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            inter = int((b[at] == a).sum())
            if 100 * inter >= p.percent * (len(a) + len(b) - inter):
                out.append((i, int(j)))
                root[root == root[i]] = root[j]
    return out


def _tiler(p: Near):
    def links(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows)
        key = np.stack([t.column(c).to_numpy() for c in ("key", "ti", "tj")])
        cut = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True])))
        rep, comp = t.column("rep").to_numpy(), t.column("comp").to_numpy()
        sig = t.column("sig").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(rep), -1)
        col = t.column("items").combine_chunks()
        flat, offs = col.values.to_numpy().view(np.uint64), col.offsets.to_numpy()
        a, b = [], []
        for lo, hi in zip(cut[:-1], cut[1:]):
            for i, j in tile_forest(comp[lo:hi], sig[lo:hi], [flat[offs[r] : offs[r + 1]] for r in range(lo, hi)], p):
                a.append(rep[lo + i])
                b.append(rep[lo + j])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["lead", "rep"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # at most an Arrow batch and the tile that goes on in the next
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(c).to_numpy() for c in range(3)])
            start = int(np.flatnonzero((k != k[:, -1:]).any(axis=0))[-1]) + 1 if (k != k[:, -1:]).any() else 0
            if start:
                held.append(batch.slice(0, start))
                yield links(held)
                held = [batch.slice(start)]
            else:
                first = held and [held[0].column(c)[0].as_py() for c in range(3)]
                if first and first != k[:, 0].tolist():
                    yield links(held)
                    held = []
                held.append(batch)
        if held:
            yield links(held)

    return run


def near_duplicates(docs: DataFrame, params: Near = Near()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents with one shingle set are one class from the start, so copies never meet as pairs. Class
    representatives that share a band are candidates. In each bucket all members are first compared with
    one leader, the member that meets most others in all its buckets, for ``star_rounds`` rounds: links contract components, and a leader that met all others
    leaves its bucket. A group around one text so costs its size. Buckets that still hold two components are
    compared in full, in tiles of about twice ``tile`` rows that return spanning forests.

    Candidates' similarity is first estimated from the packed low bits, corrected for chance collisions;
    pairs not ruled out are confirmed on full shingle sets. Null or empty texts link with nothing; ids are whole numbers; rows
    that repeat a doc_id share a component; a null doc_id stands alone and is kept.
    """
    p = params
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.pin(src.mapInArrow(_signer(p), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sig array<long>"))
    real = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    same = ["f1", "f2", "n_shingles"]
    classes = real.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    member = scratch.pin(salted_join(real.select("doc_id", *same), scratch.pin(classes), same, "n", ["doc_id"]).select("doc_id", "rep").distinct())
    reps = real.join(member.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "f1"])
    reps = scratch.pin(reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("size"), "bands", "sig"))
    keys = reps.select("rep", "size", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("z"), F.count(F.lit(1)).alias("n")).where("a < z").select("key", "n", F.col("n").alias("others"))
    buckets = scratch.pin(salted_join(keys, scratch.pin(shared), ["key"], "n", ["rep"]))
    # a text in the middle of a group meets the most others: such lead first
    in_play = scratch.pin(buckets.groupBy("rep").agg(F.sum("others").alias("met")))
    buckets = buckets.drop("others")

    # texts of candidates only
    play = sized_broadcast(in_play.select("rep"), 200_000)
    texts = src.join(play.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    sets = texts.mapInArrow(_set_maker(p.shingle), "rep long, items array<long>")
    sets = scratch.pin(sets)
    sigs = scratch.pin(reps.join(in_play, "rep", "left_semi").select("rep", "sig"))

    comp = in_play.withColumn("comp", F.col("rep"))
    several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    several = scratch.pin(several.select("a", "b"))
    for _ in range(p.star_rounds):
        bc = scratch.pin(buckets.join(comp, "rep"))
        live = scratch.pin(_open_buckets(bc, scratch))
        scratch.drop(bc)
        if live.isEmpty():
            break
        lead = live.groupBy("key").agg(F.min(F.struct(-F.col("met"), "rep", "comp")).alias("l"), F.count(F.lit(1)).alias("n"))
        lead = scratch.pin(lead.select("key", F.col("l.rep").alias("lead"), F.col("l.comp").alias("lcomp"), "n"))
        # of two that meet, the same one leads wherever either does
        pairs = salted_join(live, lead, ["key"], "n", ["rep"]).where("comp <> lcomp").select("lead", "rep")
        pairs = scratch.pin(pairs.distinct())
        leaders = _counted(pairs, scratch)
        likely = _joined(pairs, sigs, "sig", leaders).where(_matches(F.col("sig_a"), F.col("sig_b"), p) >= p.least_matches()).select("lead", "rep")
        likely = scratch.pin(likely)
        inter = F.size(F.array_intersect("items_a", "items_b"))
        new = scratch.pin(_joined(likely, sets, "items", leaders).where(100 * inter >= p.percent * (F.size("items_a") + F.size("items_b") - inter)).select("lead", "rep"))
        if not new.isEmpty():
            comp = _contract(comp, _joined(new, comp, "comp", leaders), scratch)
        buckets = scratch.pin(live.select("key", "rep", "size").join(lead.select("key", F.col("lead").alias("rep")), ["key", "rep"], "left_anti"))
        scratch.drop(live, lead, likely)
    # what is still open: all members against each other, in tiles that return spanning forests
    bc = scratch.pin(buckets.join(comp, "rep"))
    live = scratch.pin(_open_buckets(bc, scratch))
    if not live.isEmpty():
        # a side of a tile has about ``tile`` rows and ``tile_items`` shingles, whatever the texts' lengths
        many = F.greatest(F.ceil(F.count(F.lit(1)) / p.tile), F.ceil(F.sum("size") / p.tile_items))
        blocks = scratch.pin(live.groupBy("key").agg(many.cast("int").alias("nb"), F.count(F.lit(1)).alias("n")))
        placed = salted_join(live, blocks, ["key"], "n", ["rep"]).withColumn("i", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
        tiled = placed.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("key", F.least("i", "k").alias("ti"), F.greatest("i", "k").alias("tj"), "rep", "comp")
        # a text is in as many tiles as its buckets have blocks
        uses = tiled.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
        tiled = salted_join(tiled, scratch.pin(uses).join(sets.join(sigs, "rep"), "rep"), ["rep"], "n", ["key", "ti", "tj"]).select("key", "ti", "tj", "rep", "comp", "sig", "items")
        tiled = tiled.repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj")
        links = scratch.pin(tiled.mapInArrow(_tiler(p), "lead long, rep long").distinct())
        comp = _contract(comp, _joined(links, comp, "comp", _counted(links, scratch), _counted(links, scratch, "rep")), scratch)
    # class, then component of its representative; rows sharing an id but not a text tie classes together
    ties = several.join(comp.select(F.col("rep").alias("a"), F.col("comp").alias("ca")), "a", "left").join(comp.select(F.col("rep").alias("b"), F.col("comp").alias("cb")), "b", "left")
    tied = connected(ties.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), scratch).select(F.col("node").alias("comp"), F.col("component").alias("tied"))
    of = member.join(comp.drop("met"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep")).join(tied, "comp", "left")
    of = of.groupBy("doc_id").agg(F.min(F.coalesce("tied", "comp")).alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(of, "doc_id", "left")
    cid = F.coalesce("component_id", "doc_id")
    out = scratch.pin(out.select("doc_id", "n_shingles", cid.alias("component_id"), F.coalesce(cid == F.col("doc_id"), F.lit(True)).alias("kept")))
    scratch.keep(out)
    return out


def keep_one(docs: DataFrame, params: Near = Near()) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest doc_id, null last.

    Rows are numbered and each stands for itself: those that share an id but not a text both stay, and
    those without an id are grouped as well. Null and empty texts stay; columns whose names start with
    ``_near`` or ``_at`` are reserved, all others are kept.
    """
    scratch, own = Scratch(docs.sparkSession, "near"), Scratch(docs.sparkSession, "rows")
    rows = numbered(docs, "_near_row", own)
    near = near_duplicates(rows.select(F.col("_near_row").alias("doc_id"), "text"), params)
    near = near.select(F.col("doc_id").alias("_near_row"), F.col("component_id").alias("_near_of"))
    grouped = near.where("_near_row <> _near_of").select(F.col("_near_of"), "_near_row")
    grouped = scratch.pin(grouped.unionByName(grouped.select("_near_of", F.col("_near_of").alias("_near_row")).distinct()))
    ids = rows.select("_near_row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_near_row").alias("at"))
    placed = grouped.join(ids, "_near_row")
    best = placed.groupBy("_near_of").agg(F.min("at")["_near_row"].alias("_near_row")).select("_near_row")
    gone = scratch.pin(grouped.select("_near_row").join(best, "_near_row", "left_anti"))
    scratch.keep(gone)
    return rows.join(gone, "_near_row", "left_anti").select(*docs.columns)


def op9_minhash(spark, sf_dir):
    """All documents with three-word shingles at 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), Near(shingle=3, percent=85))


SQL = r"""
WITH RECURSIVE a AS (SELECT doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[ix : ix + 2], ' ') AS x FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - 2) + 1)) AS ix FROM a WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT md5(string_agg(x, chr(10) ORDER BY x)) AS k, min(doc_id) AS rep, doc_id FROM s GROUP BY doc_id),
g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS rep FROM c),
j AS (SELECT p.doc_id AS u, q.doc_id AS v, count(*) AS i FROM s p JOIN s q ON p.x = q.x AND p.doc_id < q.doc_id WHERE p.doc_id IN (SELECT rep FROM g) AND q.doc_id IN (SELECT rep FROM g) GROUP BY ALL),
l AS (SELECT u, v FROM j JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * i >= 85 * (a.n + b.n - i)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(v, w) AS (SELECT DISTINCT rep, rep FROM g UNION SELECT r.v, e.v FROM r JOIN e ON e.u = r.w),
m AS (SELECT v AS rep, min(w) AS component FROM r GROUP BY v),
o AS (SELECT doc_id, component FROM g JOIN m USING (rep))
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept FROM a LEFT JOIN n USING (doc_id) LEFT JOIN o USING (doc_id)
"""
