"""Benchmark decontamination with suffix arrays over training shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, table
from .words import ALNUM, hashed, shards, utf8

WINDOW = 13
#: Benchmark words held by a task at a time.
BLOCK_WORDS = 1 << 21


def suffix_array(words: np.ndarray, depth: int = 16) -> np.ndarray:
    """Positions of ``words`` by the order of their suffixes, exact to ``depth`` words (prefix doubling)."""
    n = len(words)
    _, rank = np.unique(words, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    step = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: max(n - step, 0)] = rank[step:]
        key = rank * np.int64(n + 2) + nxt
        step *= 2
        order = np.argsort(key, kind="stable" if step >= depth else None)
        k = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([1], (k[1:] != k[:-1]).astype(np.int64))))
        rank = new
        if step >= depth or rank.max(initial=0) == n:
            return order


class Index:
    """Suffix array of a shard's words, searched by all suffixes of a block of test items at once."""

    def __init__(self, words: np.ndarray, depth: int = 16):
        self.words = np.concatenate((words, np.zeros(depth, np.uint64)))  # a word's hash is never 0 in effect
        self.n = len(words)
        self.sa = suffix_array(words, depth) if self.n else np.zeros(0, np.int64)

    def _bound(self, test: np.ndarray, at: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
        """First place whose suffix isn't below (``upper``: is above) the test words [at, at + length)."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64)
        most = int(length.max(initial=0))
        while True:
            act = np.flatnonzero(lo < hi)
            if not len(act):
                return lo
            mid = (lo[act] + hi[act]) >> 1
            p, q, m = self.sa[mid], at[act], length[act]
            below = np.zeros(len(act), bool)
            open_ = np.ones(len(act), bool)
            for k in range(most):
                i = np.flatnonzero(open_ & (m > k))
                if not len(i):
                    break
                pos = p[i] + k
                inside = pos < self.n
                a, b = self.words[np.minimum(pos, self.n)], test[q[i] + k]
                less = ~inside | (a < b)
                same = inside & (a == b)
                below[i] = less & ~same
                open_[i] = same
            if upper:
                below |= open_
            lo[act] = np.where(below, mid + 1, lo[act])
            hi[act] = np.where(below, hi[act], mid)

    def ranges(self, test: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._bound(test, at, length, False), self._bound(test, at, length, True)


def windows(ptr: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, start, length) of all windows: every ``window`` words of an item, or the whole of a shorter one."""
    size = np.diff(ptr)
    count = np.where(size > 0, np.maximum(size - window + 1, 1), 0)
    item = np.repeat(np.arange(len(size)), count)
    at = ptr[:-1][item] + np.arange(count.sum()) - (np.cumsum(count) - count)[item]
    return item.astype(np.int64), at.astype(np.int64), np.minimum(size, window)[item].astype(np.int64)


def occurrences(index: Index, ptr: np.ndarray, test: np.ndarray, tptr: np.ndarray, window: int) -> np.ndarray:
    """(document, item, place in the shard, place in the test, words) of all occurrences of windows, a column
    each; an occurrence lies within one document."""
    item, at, length = windows(tptr, window)
    if not index.n or not len(at):
        return np.zeros((5, 0), np.int64)
    lo, hi = index.ranges(test, at, length)
    n = hi - lo
    of = np.repeat(np.arange(len(at)), n)
    p = index.sa[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    d = np.searchsorted(ptr, p, "right") - 1
    got = np.stack((d, item[of], p, at[of], length[of]))
    return got[:, p + length[of] <= ptr[d + 1]]


def spans(found: np.ndarray) -> np.ndarray:
    """Occurrences that follow each other in both texts, joined to verbatim matches as long as they go."""
    d, item, p, q, n = found
    found = found[:, np.lexsort((p, p - q, item, d))]
    d, item, p, q, n = found
    if not len(p):
        return found
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    return np.stack((d[first], item[first], p[first], q[first], p[last] + n[last] - p[first]))


def longest(index: Index, test: np.ndarray, tptr: np.ndarray, ptr: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every suffix of every item: how many of its first ``depth`` words, within the item, some document of
    the shard has in a row, and where. The longest match of a suffix stands beside its place in the array."""
    at = np.arange(len(test))
    left = np.minimum(np.repeat(tptr[1:], np.diff(tptr)) - at, depth)
    best, where = np.zeros(len(test), np.int64), np.full(len(test), -1)
    if not index.n:
        return best, where
    ends = np.repeat(ptr[1:], np.diff(ptr))
    # a match ends with its document: shorter prefixes may then match longer elsewhere, so lengths are halved down
    todo, size = at, left.copy()
    lo_ok, hi_no = np.zeros(len(at), np.int64), left + 1
    while len(todo):
        lo, hi = index.ranges(test, todo, size[todo])
        ok = np.full(len(todo), -1)
        for k in np.flatnonzero(hi > lo):
            p = index.sa[lo[k] : hi[k]]
            fit = p[p + size[todo[k]] <= ends[p]]
            if len(fit):
                ok[k] = fit.min()
        good = ok >= 0
        best[todo[good]], where[todo[good]] = size[todo[good]], ok[good]
        lo_ok[todo[good]], hi_no[todo[~good]] = size[todo[good]], size[todo[~good]]
        size[todo] = (lo_ok[todo] + hi_no[todo]) // 2
        todo = todo[hi_no[todo] - lo_ok[todo] > 1]
    return best, where


def _pack_items(limit: int):
    """Rows (ids, words, pointers) of (item_id, text): a block of about ``limit`` words, or of one longer item."""

    def block(ids, texts):
        words, ptr = hashed(*utf8(pa.array(texts, pa.large_string())), ALNUM)
        cols = [np.array(ids, np.int64), words.view(np.int64), ptr.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in cols], ["ids", "words", "ptr"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(text) // 2 + 1
                if held and held + n > limit:
                    yield block(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(item)
                texts.append(text)
                held += n
        if ids:
            yield block(ids, texts)

    return run


class Blocks:
    """The benchmark's hashed words where the tasks are: (item ids, words, pointers) of a block at a time.

    A benchmark of one block is broadcast, as its size is bounded. A larger one is written by Spark to the
    shared folder, a row a block, and its files are added to the application: every executor, late ones
    too, copies them to its own disk, and the driver sees their names only. They stay while the application runs.
    """

    def __init__(self, bench: DataFrame):
        spark = bench.sparkSession
        bench = bench.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
        words = bench.agg(F.sum(F.floor(F.length("text") / 2) + 1)).first()[0] or 0
        self.one, self.names = None, []
        if words <= BLOCK_WORDS:
            rows = bench.collect()
            hashes = hashed(*utf8(pa.array([r["text"] for r in rows], pa.large_string())), ALNUM)
            self.one = spark.sparkContext.broadcast((np.array([r["item_id"] for r in rows], np.int64), *hashes))
            return
        written = Scratch(spark, "bench").pin(bench.mapInArrow(_pack_items(BLOCK_WORDS), "ids binary, words binary, ptr binary"))
        for path in sorted(written.inputFiles()):
            spark.sparkContext.addFile(path)
            self.names.append(path.rsplit("/", 1)[-1])

    def read(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if self.one is not None:
            yield self.one.value
        for name in self.names:
            with pq.ParquetFile(SparkFiles.get(name)) as f:
                for b in f.iter_batches(batch_size=1):
                    ids, words, ptr = (np.frombuffer(c[0].as_py(), np.int64) for c in b.columns)
                    yield ids, words.view(np.uint64), ptr


_SPAN = "array<struct<item_id:long,item_at:int,doc_at:int,words:int>>"


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items, longest, matches) for every row of ``docs``.

    Each Arrow batch is cut into shards of whole documents; a shard's words (64-bit hashes) get a suffix
    array, and the windows of every benchmark item are binary-searched in it. All of a document's
    matches lie in its shard, so nothing is shuffled. The benchmark is a stated query set: a task holds a
    block of at most ``BLOCK_WORDS`` words of it at a time (``Blocks``), and the corpus is read once.

    ``matches`` are the verbatim matches of a window or more (or of a whole shorter item) with their places
    in item and document, in words; ``longest`` is the longest of them, 0 if there is none.
    ``longest_matches`` tells of shorter ones.

    Null and empty texts have no words; items without words or id are ignored; repeated item ids count
    once; repeated documents and those without an id are searched each; an empty table gives none; the
    other columns are not read, but for a number named ``_hit_text``, which is kept. Ids are whole numbers.
    """
    extra = [c for c in docs.columns if c == "_hit_text"]
    schema = f"doc_id long, n_words long, n_hit long, items array<long>, longest long, matches {_SPAN}" + "".join(f", {c} long" for c in extra)
    return docs.select("doc_id", "text", *extra).mapInArrow(_searcher(Blocks(bench), window), schema)


def search_shard(words: np.ndarray, ptr: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], window: int) -> tuple[np.ndarray, np.ndarray]:
    """The hit mask over a shard's words, and its ``spans``, with items by their ids and places within them."""
    index = Index(words, max(window, 16))
    hit = np.zeros(len(words) + 1, np.int64)
    out = []
    for ids, test, tptr in blocks:
        found = occurrences(index, ptr, test, tptr, window)
        np.add.at(hit, found[2], 1)
        np.add.at(hit, found[2] + found[4], -1)
        got = spans(found)
        got[3] -= tptr[got[1]]
        got[1] = ids[got[1]]
        out.append(got)
    return np.cumsum(hit[:-1]) > 0, np.concatenate(out, axis=1) if out else np.zeros((5, 0), np.int64)


def _searcher(blocks: Blocks, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in shards(batch, "text"):
                words, ptr = hashed(*utf8(b.column(1)), ALNUM)
                mask, (d, item, p, q, n) = search_shard(words, ptr, blocks.read(), window)
                c = np.concatenate(([0], np.cumsum(mask)))
                n_hit = c[ptr[1:]] - c[ptr[:-1]]
                order = np.lexsort((q, item, p))  # by document, as shards are
                d, item, p, q, n = (x[order] for x in (d, item, p, q, n))
                cut = np.searchsorted(d, np.arange(b.num_rows + 1))
                match = pa.StructArray.from_arrays([pa.array(item), *(pa.array(x.astype(np.int32)) for x in (q, p - ptr[d], n))], ["item_id", "item_at", "doc_at", "words"])
                most = np.zeros(b.num_rows, np.int64)
                np.maximum.at(most, d, n)
                items = [np.unique(item[lo:hi]).tolist() for lo, hi in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).cast(pa.int64()), pa.array(np.diff(ptr)), pa.array(n_hit.astype(np.int64)), pa.array(items, pa.list_(pa.int64())), pa.array(most), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), match), *b.columns[2:]],
                    ["doc_id", "n_words", "n_hit", "items", "longest", "matches", *b.schema.names[2:]],
                )

    return run


def longest_matches(docs: DataFrame, bench: DataFrame, depth: int = 64) -> DataFrame:
    """(item_id, item_at, words, doc_id, doc_at): for every suffix of every item the longest run of its first
    ``depth`` words at most that some document holds, and the first such place by doc_id; suffixes whose
    first word no document has are left out. A row a suffix and task is summed map-side."""
    keyed = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    out = keyed.mapInArrow(_longest_in(Blocks(bench), depth), "item_id long, item_at int, words int, doc_id long, doc_at int")
    best = F.min(F.struct((-F.col("words")).alias("less"), "doc_id", "doc_at")).alias("b")
    return out.groupBy("item_id", "item_at").agg(best).select("item_id", "item_at", (-F.col("b.less")).alias("words"), "b.doc_id", "b.doc_at")


def _longest_in(blocks: Blocks, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in shards(batch, "text"):
                words, ptr = hashed(*utf8(b.column(1)), ALNUM)
                index = Index(words, max(depth, 16))
                for ids, test, tptr in blocks.read():
                    item = np.repeat(np.arange(len(ids)), np.diff(tptr))
                    best, where = longest(index, test, tptr, ptr, depth)
                    i = np.flatnonzero(best)
                    d = np.searchsorted(ptr, where[i], "right") - 1
                    cols = [ids[item[i]], (i - tptr[item[i]]).astype(np.int32), best[i].astype(np.int32), b.column(0).cast(pa.int64()).to_numpy()[d], (where[i] - ptr[d]).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["item_id", "item_at", "words", "doc_id", "doc_at"])

    return run


def contaminated(n_hit, n_words, share: int = 20):
    return (n_hit > 0) & (share * n_hit >= n_words)


def remove_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows a twentieth or more of whose words lie in benchmark windows.

    Each goes or stays by its own text, whatever its id: equal texts fare alike, so the join is by their
    64-bit hash, which asks for no numbered copy of the rows. Rows without an id and rows that repeat one are
    judged like all others; null and empty texts stay; all columns are kept (``_hit_text`` is reserved).
    """
    rows = docs.withColumn("_hit_text", F.xxhash64("text"))
    bad = contamination(rows, bench, window).where(contaminated(F.col("n_hit"), F.col("n_words"))).select("_hit_text").distinct()
    return rows.join(bad, "_hit_text", "left_anti").select(*docs.columns)


def op5_decontaminate(spark, sf_dir):
    """All documents against the whole benchmark; repeated rows are judged each, null texts have no words."""
    c = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return c.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"), "longest")


SQL = r"""
WITH a AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
q AS (SELECT item_id, ix, least(13, len(ws)) AS n, ws[ix + 1 : ix + least(13, len(ws))] AS w FROM (SELECT *, unnest(range(greatest(1, len(ws) - 12))) AS ix FROM b WHERE len(ws) > 0)),
p AS (SELECT r, ix, n, ws[ix + 1 : ix + n] AS w FROM (SELECT r, ws, n, unnest(range(greatest(0, len(ws) - n + 1))) AS ix FROM a, (SELECT DISTINCT n FROM q))),
m AS (SELECT p.r, q.item_id, p.ix AS p, q.ix AS q, q.n FROM p JOIN q ON p.n = q.n AND p.w = q.w),
i AS (SELECT r, item_id, n, count(*) + any_value(n) - 1 AS words FROM (SELECT *, p - row_number() OVER (PARTITION BY r, item_id, p - q ORDER BY p) AS k FROM (SELECT DISTINCT * FROM m)) GROUP BY r, item_id, p - q, k, n),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS x FROM m) GROUP BY r),
o AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS ids FROM m GROUP BY r),
x AS (SELECT r, max(words) AS longest FROM i GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated, coalesce(longest, 0) AS longest
FROM a LEFT JOIN h USING (r) LEFT JOIN o USING (r) LEFT JOIN x USING (r)
"""
