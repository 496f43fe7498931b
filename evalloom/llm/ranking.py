"""Ranked lexical search: inverted shards, posting blocks cut by dynamic programming, exact block-skipping search."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch, table
from .words import ALNUM, hashed, shards, utf8

#: Distinct terms of a block of items, which every task holds; more items are searched in several passes over the index.
BLOCK_TERMS = 1 << 19
#: Postings of a block at most; what a further block costs, in units of the list's range of impacts.
LONGEST, BLOCK_COST = 32, 8
#: Documents whose live blocks are read at a time.
STRIDE = 256
#: Tasks' results of an item are ranked in so many heaps before they meet.
HEAPS = 64


def invert(words: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, starts, docs, tfs) of a shard: distinct terms ascending, each one's postings by document."""
    doc = np.repeat(np.arange(len(ptr) - 1, dtype=np.int32), np.diff(ptr))
    order = np.argsort(words, kind="stable")  # documents ascend within a term
    w, d = words[order], doc[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    tf = np.diff(np.append(first, len(w)))
    w, d = w[first], d[first]
    head = np.ones(len(w), bool)
    head[1:] = w[1:] != w[:-1]
    at = np.flatnonzero(head)
    return w[at], np.append(at, len(w)).astype(np.int32), d, tf.astype(np.int32)


_INDEX = "ids array<long>, n_docs long, n_terms long, lengths binary, terms binary, starts binary, docs binary, tfs binary"


def _indexer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in shards(batch, "text"):
            words, ptr = hashed(*utf8(b.column(1)), ALNUM)
            length = np.diff(ptr)
            some = np.flatnonzero(length)
            ptr = np.append(ptr[some], len(words))
            terms, starts, docs, tfs = invert(words, ptr)
            blobs = (length[some].astype(np.int64), terms, starts, docs, tfs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.column(0).take(pa.array(some)).to_pylist()], pa.list_(pa.int64())), pa.array([len(some)]), pa.array([len(words)]), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)],
                ["ids", "n_docs", "n_terms", "lengths", "terms", "starts", "docs", "tfs"],
            )


def index(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """A written table of inverted shards of ``docs(doc_id, text)``: about 2 MB of whole texts each, or one longer text.
    Documents without terms are in none. Nothing is shuffled."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scratch.pin(keyed.mapInArrow(_indexer, _INDEX))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A posting's score without its term's weight, in whole numbers."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def cut(values: np.ndarray, starts: np.ndarray, longest: int = LONGEST, cost: int = BLOCK_COST) -> np.ndarray:
    """Where blocks of posting lists end, the lists' ends included: ``values[starts[i]:starts[i + 1]]`` is list i.

    A list is cut so that the sum of its blocks' maximum minus value over all postings, plus a constant for each block
    (``cost`` times the list's range), is least among all cuts into blocks of ``longest`` at most. The dynamic
    programme goes over all lists at once, a posting a step: for each it holds the best sums of the last
    ``longest`` places and the maxima from there on.
    """
    size = np.diff(starts)
    if not len(values):
        return np.zeros(0, np.int64)
    lists = np.flatnonzero(size)
    lists = lists[np.argsort(-size[lists], kind="stable")]
    begin, size = starts[lists].astype(np.int64), size[lists]
    heads = np.sort(begin)
    spread = np.zeros(len(lists), np.int64)
    where = np.searchsorted(heads, begin)
    spread = (np.maximum.reduceat(values, heads) - np.minimum.reduceat(values, heads))[where]
    block = np.maximum(spread * cost, 1)
    best = np.full((len(lists), longest), np.iinfo(np.int64).max // 4)  # least sum up to 0, 1, ... postings ago
    best[:, 0] = 0
    top = np.zeros((len(lists), longest), np.int64)  # greatest of the last 1, 2, ... postings
    width = np.arange(1, longest + 1)
    back = np.zeros(len(values), np.int16)
    live = len(lists)
    for step in range(int(size[0])):
        while size[live - 1] <= step:
            live -= 1
        v = values[begin[:live] + step]
        t, p = top[:live], best[:live]
        t[:, 1:] = t[:, :-1]
        t[:, 0] = v
        np.maximum(t, v[:, None], out=t)
        sums = p + t * width
        k = sums.argmin(axis=1)
        back[begin[:live] + step] = k + 1
        p[:, 1:] = p[:, :-1].copy()
        p[:, 0] = sums[np.arange(live), k] + block[:live]
    ends, at = [], begin + size
    while len(at):
        ends.append(at)
        at = at - back[at - 1]
        open_ = at > begin
        at, begin = at[open_], begin[open_]
    return np.sort(np.concatenate(ends))


class Lists:
    """The posting lists of a block of items in a shard: documents, impacts and variable blocks with their maxima."""

    def __init__(self, terms: np.ndarray, starts: np.ndarray, docs: np.ndarray, tfs: np.ndarray, wanted: np.ndarray, m: np.ndarray):
        at = np.searchsorted(terms, wanted)
        at[at == len(terms)] = 0
        held = np.flatnonzero(terms[at] == wanted) if len(terms) else np.zeros(0, np.int64)
        lo, n = starts[at[held]].astype(np.int64), (starts[at[held] + 1] - starts[at[held]]).astype(np.int64)
        self.starts = np.zeros(len(wanted) + 1, np.int64)  # by place among the wanted terms
        self.starts[held + 1] = n
        np.cumsum(self.starts, out=self.starts)
        take = np.repeat(lo - self.starts[held], n) + np.arange(n.sum())
        self.docs = docs[take].astype(np.int64)
        self.impact = impacts(tfs[take], m[self.docs])
        self.ends = cut(self.impact, self.starts)
        self.begins = np.concatenate((np.zeros(min(1, len(self.ends)), np.int64), self.ends[:-1]))
        self.most = np.maximum.reduceat(self.impact, self.begins) if len(self.ends) else np.zeros(0, np.int64)
        self.first, self.last = self.docs[self.begins], self.docs[self.ends - 1]
        self.block = np.searchsorted(self.ends, self.starts, "right")  # each list's first block
        self.top = np.zeros(len(wanted), np.int64)
        if len(held):
            self.top[held] = np.maximum.reduceat(self.most, self.block[held])

    def search(self, term: np.ndarray, weight: np.ndarray, n_docs: int, best: Best, ids: np.ndarray, known: np.ndarray) -> int:
        """Offer ``best`` all documents that can be among its first, by the weighted terms' postings; the number of
        postings that were read.

        The sum of the blocks' maxima over a document bounds its score. The search jumps to the next document whose
        bound isn't below the least score in ``best`` and reads the blocks that hold such documents, up to
        ``STRIDE`` documents on; every score found raises the bar. The documents of the highest bounds are read first.
        """
        if (self.top[term] * weight).sum() < best.bar:
            return 0
        lo, hi = self.block[term], self.block[term + 1]
        n = hi - lo
        b = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
        w = np.repeat(weight, n)
        edge = np.zeros(n_docs + 1, np.int64)
        np.add.at(edge, self.first[b], self.most[b] * w)
        np.add.at(edge, self.last[b] + 1, -self.most[b] * w)
        bound = np.cumsum(edge[:-1])
        read = 0
        if n_docs > STRIDE:
            head = np.sort(np.argpartition(bound, -best.size)[-best.size :])
            read += self._read(head, b, w, bound, n_docs, best, ids, known)
            bound[head] = 0
        at = 0
        while True:
            live = at + np.flatnonzero(bound[at : at + STRIDE] >= best.bar)
            if len(live):
                read += self._read(live, b, w, bound, n_docs, best, ids, known)
            at += STRIDE
            rest = bound[at:] >= best.bar
            if not rest.any():
                return read
            at += int(rest.argmax())  # the next pivot

    def _read(self, live: np.ndarray, b: np.ndarray, w: np.ndarray, bound: np.ndarray, n_docs: int, best: Best, ids: np.ndarray, known: np.ndarray) -> int:
        among = np.zeros(n_docs + 1, np.int64)
        among[live + 1] = 1
        np.cumsum(among, out=among)
        open_ = np.flatnonzero(among[self.last[b] + 1] > among[self.first[b]])
        lo, n = self.begins[b[open_]], (self.ends - self.begins)[b[open_]]
        take = np.repeat(lo + n - np.cumsum(n), n) + np.arange(n.sum())
        score = np.zeros(n_docs, np.int64)
        np.add.at(score, self.docs[take], self.impact[take] * np.repeat(w[open_], n))
        got = score[live]  # whole scores: every block over a live document is open
        some = np.flatnonzero(got >= best.bar)
        best.offer(got[some], ids[live[some]], known[live[some]])
        return len(take)


class Best:
    """The ``size`` best documents so far: by score, then known ids before null ones, then id."""

    def __init__(self, size: int):
        self.size, self.bar = size, 1
        self.score, self.id, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def offer(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        s, i, k = np.concatenate((self.score, score)), np.concatenate((self.id, ids)), np.concatenate((self.known, known))
        order = np.lexsort((i, ~k, -s))[: self.size]
        self.score, self.id, self.known = s[order], i[order], k[order]
        if len(order) == self.size:
            self.bar = int(self.score[-1])  # an equal score may still win by its id


def _counter(terms):
    """How many documents of the task's shards hold each of the wanted terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = terms.value
        df = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                have, starts = np.frombuffer(batch.column(0)[r].as_py(), np.uint64), np.frombuffer(batch.column(1)[r].as_py(), np.int32)
                _, at, mine = np.intersect1d(have, wanted, assume_unique=True, return_indices=True)
                df[mine] += (starts[at + 1] - starts[at]).astype(np.int64)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    return run


def _searcher(shared, size: int, n: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, items = shared.value
        best = [Best(size) for _ in items]
        for batch in batches:
            for r in range(batch.num_rows):
                col = lambda name, kind: np.frombuffer(batch.column(name)[r].as_py(), kind)  # noqa: E731, B023
                doc = batch.column("ids")[r].values
                known, ids = ~np.asarray(doc.is_null()), doc.fill_null(0).to_numpy()
                if not len(ids):
                    continue
                m = 75 + (25 * col("lengths", np.int64) * n) // total
                lists = Lists(col("terms", np.uint64), col("starts", np.int32), col("docs", np.int32), col("tfs", np.int32), wanted, m)
                for (_, term, weight), b in zip(items, best):
                    lists.search(term, weight, len(ids), b, ids, known)
        item = [i for (i, _, _), b in zip(items, best) for _ in b.score]
        score, ids, known = (np.concatenate([getattr(b, c) for b in best]) if best else np.zeros(0, np.int64) for c in ("score", "id", "known"))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, mask=~known.astype(bool)), pa.array(score)], ["_item", "doc_id", "score"])

    return run


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's distinct terms and how often it has them."""
    for b in batches:
        words, ptr = hashed(*utf8(b.column(1)), ALNUM)
        got = [np.unique(words[lo:hi], return_counts=True) for lo, hi in zip(ptr, ptr[1:])]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t, _ in got], pa.int64()), *(pa.array([x[k].astype(d).tobytes() for x in got], pa.binary()) for k, d in ((0, np.uint64), (1, np.int64)))], ["_item", "n", "terms", "times"])


def weight_of(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def search(docs: DataFrame, queries: DataFrame, size: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``size`` best of all ``docs(doc_id, text)`` for each row of ``queries(item_id, text)``.

    The corpus is indexed in inverted shards, a written table. Queries go in blocks of at most about ``BLOCK_TERMS``
    terms, or one longer query: each block is counted in the index for its terms' weights and then searched in all shards,
    whose posting lists are cut into blocks of their own. A task keeps the best documents of each item over its
    shards, so later ones start from a high bar; the tasks' results are ranked in heaps before an item's meet.

    Terms are told apart by 64 bits of hash. Null and empty texts have no terms, and a query without terms that the
    corpus has finds nothing. Rows that repeat a doc_id are documents of their own, and so are queries that repeat an
    item_id; a null doc_id comes after the others of its score. Ids are whole numbers; empty tables give no rows;
    other columns are not read. Texts are read whole; one longer than a shard is a shard.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranking")
    shards_ = index(docs, scratch)
    n, total = shards_.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    kept = scratch.pin(queries.select("item_id", "text", F.monotonically_increasing_id().alias("_item")))
    items = scratch.pin(kept.select("_item", "text").mapInArrow(_items, "_item long, n long, terms binary, times binary").where("n > 0"))
    weight = items.agg(F.sum(F.col("n") + 8)).first()[0] or 0  # an item without many terms has some weight too
    blocks = -(-weight // BLOCK_TERMS)
    out = None
    for i in range(blocks if n else 0):
        block = items.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == i).drop("n").collect()  # about BLOCK_TERMS terms
        found = _block(spark, shards_, [(r["_item"], np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["times"], np.int64)) for r in block], n, total, size)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return queries.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    heap = out.withColumn("_heap", F.pmod(F.spark_partition_id(), F.lit(HEAPS)))
    heap = heap.withColumn("_place", F.row_number().over(W.partitionBy("_item", "_heap").orderBy(*order))).where(F.col("_place") <= size)
    best = heap.withColumn("rank", F.row_number().over(W.partitionBy("_item").orderBy(*order))).where(F.col("rank") <= size)
    return best.join(kept.select("item_id", "_item"), "_item").select("item_id", "rank", "doc_id", "score")


def _block(spark, shards_: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], n: int, total: int, size: int) -> DataFrame:
    wanted = np.unique(np.concatenate([t for _, t, _ in items])) if items else np.zeros(0, np.uint64)
    terms = spark.sparkContext.broadcast(wanted)
    df = shards_.select("terms", "starts").mapInArrow(_counter(terms), "term long, df long").groupBy("term").agg(F.sum("df")).collect()  # a row a term of the block
    weights = np.zeros(len(wanted), np.int64)
    for term, k in df:
        weights[term] = weight_of(n, k)
    asked = []
    for i, t, times in items:
        at = np.searchsorted(wanted, t)
        w = weights[at] * times
        some = w > 0
        asked.append((i, at[some], w[some]))
    return shards_.drop("n_docs", "n_terms").mapInArrow(_searcher(spark.sparkContext.broadcast((wanted, asked)), size, n, total), "_item long, doc_id long, score long")


def op11_ranking(spark, sf_dir):
    """The 20 best documents of the whole table for every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(\"text\", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".replace('\\"', '"')
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS ws FROM benchmark),
s AS (SELECT count(*) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM d WHERE len(ws) > 0),
qt AS (SELECT q, t, count(*) AS k FROM (SELECT q, unnest(ws) AS t FROM b) GROUP BY q, t),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t, n),
g AS (SELECT p.r, t, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(ws) * n) // l)) AS g FROM p JOIN d USING (r), s),
x AS (SELECT q, r, CAST(sum(k * w * g) AS BIGINT) AS score FROM qt JOIN w USING (t) JOIN g USING (t) GROUP BY q, r HAVING sum(k * w * g) > 0),
y AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x JOIN d USING (r))
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM y JOIN b USING (q) WHERE rank <= 20
"""
