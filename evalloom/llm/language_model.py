"""Language-model scores from a hierarchical Pitman-Yor model, seated by Gibbs sampling."""

from __future__ import annotations

import functools
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, table
from .words import SPACED, hashed, mix, shards, utf8

END = np.uint64(0x0E0D_0E0D_0E0D_0E0D)
_C = np.uint64(0x9E3779B97F4A7C15)
#: Tokens dealt to a box at most, but for words of more than a ``MOST_HOT``-th of all; a chunk names as many words.
BOX_TOKENS, MOST_HOT = 1 << 21, 50_000
#: Partitions of boxes or cells at most; beyond that a task takes several, one after the other.
MOST_PARTS = 20_000
#: Boxes a cell: what boxes and cells tell each other is a message a pair of them.
CELL_BOXES = 16
#: A context is told by the upper 48 bits of its word's hash: what is sent is mostly contexts.
_SHORT = np.uint64(16)


@dataclass(frozen=True)
class Model:
    """Context restaurants: one for each word seen before a word (``contexts`` = 1 word of context; with 0
    there is one for all). All share the unigram restaurant as parent, whose base is uniform over the
    training types and one unknown symbol. ``sweeps`` states are burnt, ``samples`` averaged."""

    contexts: int = 1
    sweeps: int = 2
    samples: int = 4
    theta: float = 1.0
    chunk_bytes: int = 12 << 20


# Messages: rows (b, kind, of, data) to box ``b``; ``data`` is packed arrays of numbers.
MSG = "b int, kind int, of long, data binary"
ASK, STATE, ASKED, FIRST_UP, STATS, CELL, PLACES, UP, DOWN, WORDS, OWN, TABLES, ANSWER, CHUNK = range(14)


def _small(a: np.ndarray) -> np.ndarray:
    """Whole numbers of at least 0 in as few bytes as hold them."""
    most = int(a.max(initial=0))
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one string, each compressed by planes of bytes."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
        z = pa.compress(planes, codec="zstd", asbytes=True)
        out += [struct.pack("<2sqq", a.dtype.str[1:].encode(), len(a), len(z)), z]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    at, out = 1, []
    for _ in range(data[0]):
        kind, n, size = struct.unpack_from("<2sqq", data, at)
        at += struct.calcsize("<2sqq")
        t = np.dtype(kind.decode())
        planes = np.frombuffer(pa.decompress(data[at : at + size], n * t.itemsize, codec="zstd"), np.uint8) if n else np.zeros(0, np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(t.itemsize, n).T).view(t).reshape(n))
        at += size
    return out


def _steps(a: np.ndarray) -> np.ndarray:
    """Differences of 32-bit places (they wrap); ``_sums`` undoes it."""
    return np.diff(a.astype(np.uint32), prepend=np.uint32(0))


def _sums(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=np.uint32).astype(np.int64)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += len(r[-1])
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)


def _mail(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    return _batches(rows, ["b", "kind", "of", "data"], [pa.int32(), pa.int32(), pa.int64(), pa.binary()])


def _grouped(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, dict[int, list[tuple]]]]:
    """Rows that come sorted, by the value of ``by``: (value, kind -> rows)."""
    at, held = None, {}
    for b in batches:
        for r in b.to_pylist():
            if r[by] != at:
                if held:
                    yield at, held
                at, held = r[by], {}
            held.setdefault(r["kind"], []).append(r)
    if held:
        yield at, held


def _deliver(boxes: int, read: Callable, *tables: DataFrame) -> DataFrame:
    """What ``read(b, messages)`` sends from all boxes that got messages in ``tables``."""
    all_ = tables[0]
    for t in tables[1:]:
        all_ = all_.unionByName(t)

    def run(batches):
        return _mail(m for b, held in _grouped(batches, "b") for m in read(b, held))

    parts = min(boxes, MOST_PARTS)
    return all_.repartitionById(parts, F.col("b") % parts).sortWithinPartitions("b", "kind", "of").mapInArrow(run, MSG)


def _chunks(batches: Iterator[pa.RecordBatch], limit: int):
    """(documents' ids, train flags, words, sizes) of runs of documents with about ``limit`` bytes."""
    ids: list[pa.Array] = []
    train: list[np.ndarray] = []
    words: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    held = 0

    def take():
        """What is held, in one piece; nothing of it stays here."""
        got = pa.concat_arrays(ids), np.concatenate(train), np.concatenate(words), np.concatenate(sizes)
        for x in (ids, train, words, sizes):
            x.clear()
        return got

    for batch in batches:
        for b in shards(batch, "text"):
            raw, offs = utf8(b.column(1))
            w, ptr = hashed(raw, offs, SPACED)
            words.append(np.insert(w, ptr[1:], END))
            sizes.append(np.diff(ptr) + 1)
            ids.append(b.column(0))
            train.append(b.column(2).to_numpy(zero_copy_only=False).astype(bool))
            held += len(raw)
            del raw, offs, w, ptr
            if held >= limit:
                held = 0
                yield take()
    if ids:
        yield take()


def _packer(limit: int):
    """A row a chunk: its documents' ids, training tokens, distinct words by first appearance, tokens as
    numbers of these, and the words with more than a ``MOST_HOT``-th of its training tokens."""

    def rows(batches):
        for ids, train, words, sizes in _chunks(batches, limit):
            distinct, first, of = np.unique(words, return_index=True, return_inverse=True)
            order = np.argsort(first)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            tokens = rank[of]
            learnt = np.repeat(train, sizes)
            n = np.bincount(tokens[learnt], minlength=len(order))
            much = np.flatnonzero(n * MOST_HOT > learnt.sum())
            # a word's first token is written as 0, the others as 1 + its number: cheap to compress
            code = tokens + 1
            code[first] = 0
            yield ids, int(learnt.sum()), pack(distinct[order[much]], _small(n[much])), pack(distinct[order]), pack(_small(sizes), train.view(np.uint8), _small(code))

    def run(batches):
        for ids, n, much, ws, body in rows(batches):
            one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([one, pa.array([n]), *(pa.array([x], pa.binary()) for x in (much, ws, body))], ["ids", "n", "much", "ws", "body"])

    return run


def _pairs(body: bytes, contexts: int):
    """(sizes, train, pairs' words and contexts, tokens' pairs) of a chunk; pairs stand by word and context,
    both by first appearance. A token's context is the token before it: each document ends with ``END``, so
    the first one's is ``END``."""
    sizes, train, code = unpack(body)
    code = code.astype(np.int64)
    new = code == 0
    tokens = np.where(new, np.cumsum(new) - 1, code - 1)
    v, end = int(new.sum()), int(tokens[-1])
    before = np.concatenate(([end], tokens[:-1])) if contexts else np.full(len(tokens), end)
    pairs, of = np.unique(tokens * v + before, return_inverse=True)
    return sizes.astype(np.int64), train.astype(bool), pairs // v, pairs % v, of


def _box(contexts: np.ndarray, boxes: int) -> np.ndarray:
    """The box of a word, given as a context."""
    return (mix(contexts + np.uint64(1)) % np.uint64(boxes)).astype(np.int64)


def _groups(of: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by ``of``, and each value's (value, from, to) in it."""
    order = np.argsort(of, kind="stable")
    ends = [*_starts(of[order]).tolist(), len(order)]
    return order, [(int(of[order[lo]]), lo, hi) for lo, hi in zip(ends, ends[1:])]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0))))


def _find(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of ``values`` in a sorted array, -1 where they aren't there."""
    if not len(sorted_):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return np.where(sorted_[at] == values, at, -1)


def _asker(contexts: int, boxes: int, hot: np.ndarray, slices: np.ndarray):
    """A chunk's pairs to the boxes of their words, with their training counts and places in the chunk.

    A hot word is cut into slices by context, each with a box of its own.
    """

    def rows(batches):
        for b in batches:
            for r in range(b.num_rows):
                ws = unpack(b.column("ws")[r].as_py())[0]
                sizes, train, w, c, of = _pairs(b.column("body")[r].as_py(), contexts)
                n = np.bincount(of[np.repeat(train, sizes)], minlength=len(w))
                short = ws >> _SHORT
                box = _box(short, boxes)[w]
                at = _find(hot, ws)[w]
                cut = np.flatnonzero(at >= 0)
                if len(cut):
                    part = (mix(short[c[cut]]) >> np.uint64(32)) * slices[at[cut]].astype(np.uint64) >> np.uint64(32)
                    box[cut] = _box(ws[w[cut]] + (part + np.uint64(1)) * _C, boxes)
                rank = np.empty(len(ws), np.int64)
                rank[np.argsort(ws)] = np.arange(len(ws))
                order = np.argsort(box * len(ws) + rank[w], kind="stable")
                box, w, c, n = box[order], w[order], c[order], n[order]
                chunk = b.column("chunk")[r].as_py()
                ends = [*_starts(box).tolist(), len(box)]
                for lo, hi in zip(ends, ends[1:]):
                    run = _starts(w[lo:hi])
                    size = np.diff(np.append(run, hi - lo))
                    yield int(box[lo]), ASK, chunk, pack(ws[w[lo:hi][run]], _small(size), short[c[lo:hi]], _small(n[lo:hi]), _steps(order[lo:hi]))

    return lambda batches: _mail(rows(batches))


def _by_cell(contexts: np.ndarray, boxes: int, cells: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    return _groups(_box(contexts, boxes) % cells)


def _collect_counts(boxes: int, cells: int, hot: np.ndarray):
    """A box sums its pairs: its state, what each chunk asked as numbers of it, contexts' counts to their cells."""

    def read(b, mail):
        asks = [(r["of"], unpack(r["data"])) for r in mail[ASK]]
        cat = lambda k: np.concatenate([a[k] for _, a in asks])
        words, of_word = np.unique(cat(0), return_inverse=True)
        ctx, of_ctx = np.unique(cat(2), return_inverse=True)
        codes, of = np.unique(np.repeat(of_word, cat(1).astype(np.int64)) * len(ctx) + of_ctx, return_inverse=True)
        n = np.bincount(of, cat(3)).astype(np.int64)
        known = n > 0
        w, c, n = codes[known] // len(ctx), codes[known] % len(ctx), n[known]
        k = np.bincount(w, minlength=len(words))
        base = np.cumsum(k) - k
        # numbers of what is known, from 1; 0 is unknown. Hot words follow the box's own, as other boxes may know
        # what this slice doesn't; their pairs are numbered from the box's first
        at = _find(hot, words)
        word_no = np.where(at >= 0, (k > 0).sum() + 1 + at, np.where(k > 0, np.cumsum(k > 0), 0))
        pair_no = np.where(known, np.cumsum(known) - np.where(at >= 0, 0, base)[codes // len(ctx)], 0)
        met = np.bincount(c, minlength=len(ctx)) > 0
        c, ctx, words, k = (np.cumsum(met) - 1)[c], ctx[met], words[k > 0], k[k > 0]
        yield b, STATE, b, pack(words, _small(k), ctx, _small(c), _small(n))
        run = row = 0
        for chunk, (ws, size, cs, _, place) in asks:
            yield b, ASKED, chunk, pack(_small(word_no[of_word[run : run + len(ws)]]), size, _small(pair_no[of[row : row + len(cs)]]), place)
            run, row = run + len(ws), row + len(cs)
        singles, all_ = np.bincount(c[n == 1], minlength=len(ctx)), np.bincount(c, minlength=len(ctx))
        order, to = _by_cell(ctx, boxes, cells)
        for cell, lo, hi in to:
            x = order[lo:hi]
            yield cell, FIRST_UP, b, pack(ctx[x], _small(singles[x]), _small(all_[x]))
        at, count = _find(hot, words), np.bincount(np.repeat(np.arange(len(words)), k), n, minlength=len(words)).astype(np.int64)
        cold = at < 0
        yield b, STATS, b, pack(
            np.array([(n == 1).sum(), (n == 2).sum(), (k[cold] == 1).sum(), (k[cold] == 2).sum(), cold.sum(), len(n)], np.int64), _small(at[~cold]), count[~cold], k[~cold].astype(np.int64)
        )

    return read


def _first_cells(boxes: int):
    """A cell learns its contexts: their singles, the places of each box's others, and a table a pair to start
    with. It tells a box which of the box's own words it knows as contexts."""

    def read(cell, mail):
        ups = [(r["of"], unpack(r["data"])) for r in mail[FIRST_UP]]
        ctx, of = np.unique(np.concatenate([u[0] for _, u in ups]), return_inverse=True)
        singles = np.bincount(of, np.concatenate([u[1] for _, u in ups])).astype(np.int64)
        tables = np.bincount(of, np.concatenate([u[2] for _, u in ups])).astype(np.int64)
        yield cell, CELL, cell, pack(ctx, _small(singles))
        order, to = _groups(_box(ctx, boxes))
        for b, lo, hi in to:
            yield b, OWN, cell, pack(ctx[order[lo:hi]])
        at = 0
        for b, (cs, s, k) in ups:
            x = of[at : at + len(cs)][k > s]
            at += len(cs)
            if len(x):
                yield cell, PLACES, b, pack(_small(x))
                yield b, DOWN, cell, pack(_small(tables[x]))

    return read


def _cells(boxes: int, hot: np.ndarray, sweep: int, keep: bool):
    """A cell sums its contexts' tables and tells the boxes."""

    def read(cell, mail):
        ctx, singles = unpack(mail[CELL][0]["data"])
        tables = singles.astype(np.int64)
        places = {r["of"]: unpack(r["data"])[0] for r in mail.get(PLACES, [])}
        for r in mail.get(UP, []):
            tables[places[r["of"]]] += unpack(r["data"])[0].astype(np.int64)  # a box has a context once
        for b, x in places.items():
            yield b, DOWN, cell, pack(_small(tables[x]))
        if keep:
            order, to = _groups(_box(ctx, boxes))
            for b, lo, hi in to:
                yield b, TABLES, sweep, pack(_small(tables[order[lo:hi]]))
            at = _find(hot >> _SHORT, ctx)
            yield cell, STATS, cell, pack(np.zeros(0, np.int64), _small(at[at >= 0]), tables[at >= 0])

    return read


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    return ((mix(key + np.uint64(salt * int(_C) & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _binomial(n: int, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Draws from their uniforms: exact for one trial, else Poisson below a mean of 10 and normal above."""
    if n == 1:
        return (u < p).astype(np.float64)
    mean = n * p
    out = np.zeros(len(p))
    small = mean < 10
    if small.any():
        m, us = mean[small], u[small]
        term = np.exp(-m)
        total, k = term.copy(), np.zeros(len(m))
        for j in range(1, 60):
            more = us > total
            if not more.any():
                break
            k += more
            term = term * m / j
            total += term
        out[small] = k
    if not small.all():
        m, us, q = mean[~small], u[~small], p[~small]
        t = np.sqrt(-2 * np.log(np.minimum(us, 1 - us)))  # the normal quantile by a rational approximation
        z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
        out[~small] = np.rint(m + np.where(us < 0.5, -z, z) * np.sqrt(m * (1 - q)))
    return np.clip(out, 0, n)


#: Customers of a dish whose tables are drawn exactly.
EXACT = 256


@functools.lru_cache(4)
def _arrangements(d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: weights of seating n customers at t tables, [n, t]."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    for n in range(1, EXACT):
        t = np.arange(1, n + 1)
        out[n + 1, 1 : n + 2] = np.logaddexp(out[n, : n + 1], np.append(np.log(n - d * t) + out[n, 1 : n + 1], -np.inf))
    return out


def seat(n: np.ndarray, others: np.ndarray, p0: np.ndarray, theta: float, d: float, key: np.ndarray, salt: int) -> np.ndarray:
    """Gibbs draws of the tables of ``n`` customers of one dish, given the ``others`` tables of the restaurant and
    the parent's probability ``p0`` of the dish.

    t tables of n customers weigh S(n, t) times the product of (theta + d (others + j)) p0 over j < t. Up to
    ``EXACT`` customers this is drawn from as it is; those beyond are seated after them in blocks that double,
    opening tables by the restaurant's odds.
    """
    n = n.astype(np.int64)
    t = np.minimum(n, 1).astype(np.float64)
    start = theta + d * np.maximum(others, 0.0)
    first = np.minimum(n, EXACT)
    order = np.argsort(first, kind="stable")
    order = order[np.searchsorted(first[order], 2) :]
    sizes = first[order]
    at = 0
    while at < len(order):
        k = int(sizes[at])
        to = min(int(np.searchsorted(sizes, k, "right")), at + max(1, (1 << 20) // k))
        rows = order[at:to]
        opened = np.log(start[rows, None] + d * np.arange(k)) + np.log(p0[rows, None])
        w = np.cumsum(opened, axis=1) + _arrangements(d)[k, 1 : k + 1]
        w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
        t[rows] = 1 + (w < _uniform(key[rows], salt * 64)[:, None] * w[:, -1:]).sum(axis=1)
        at = to
    done, block, step = EXACT, 8, 0
    live = np.flatnonzero(n > EXACT)
    while len(live):
        step += 1
        left = n[live] - done
        for size in np.unique(np.minimum(left, block)).tolist():
            rows = live[np.minimum(left, block) == size]
            pull = (start[rows] + d * t[rows]) * p0[rows]
            p = pull / (pull + np.maximum(done + (size - 1) / 2 - d * t[rows], 1e-9))
            t[rows] += _binomial(int(size), p, _uniform(key[rows], salt * 64 + step))
        done += block
        live = live[n[live] > done]
        block *= 2
    return np.minimum(t, n)


@dataclass(frozen=True)
class _Parent:
    """The unigram restaurant after a sweep: its totals, and the hot words' customers and tables."""

    theta: float
    d: float
    customers: float
    tables: float
    h: float
    hot: np.ndarray
    hot_customers: np.ndarray
    hot_tables: np.ndarray

    def unknown(self) -> float:
        return (self.theta + self.d * self.tables) / (self.theta + self.customers) * self.h

    def p(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.d * tables) / (self.theta + self.customers) + self.unknown()

    def seat(self, customers: np.ndarray, tables: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
        """New tables of words with these customers, which had ``tables``."""
        return seat(customers, self.tables - tables.astype(np.float64), np.full(len(customers), self.h), self.theta, self.d, key, salt)


def _sweep(m: Model, boxes: int, cells: int, d: float, parent: _Parent, salt: int, keep: bool):
    """A box seats its pairs, then its words in the unigram restaurant, by the tables of the sweep before."""

    def read(b, mail):
        words, k, ctx, c, n = unpack(mail[STATE][0]["data"])
        k, n = k.astype(np.int64), n.astype(np.int64)
        w = np.repeat(np.arange(len(words)), k)
        several = np.flatnonzero(n > 1)
        one = np.ones(len(several), np.int64)
        got = unpack(mail[WORDS][0]["data"]) if WORDS in mail else [k, np.ones(len(k), np.int64), one, 0 * one]
        p0 = parent.p(got[0].astype(np.float64), got[1].astype(np.float64))
        at = _find(parent.hot, words)
        p0[at >= 0] = parent.p(parent.hot_customers, parent.hot_tables)[at[at >= 0]]
        shared = np.bincount(c[several], minlength=len(ctx)) > 0
        mine = np.flatnonzero(shared)
        order, to = _by_cell(ctx[mine], boxes, cells)
        tables = np.zeros(len(ctx))
        if len(mine):
            tables[mine[order]] = np.concatenate([unpack(r["data"])[0] for r in mail[DOWN]])
        key = mix(words[w[several]] + mix(ctx[c[several]]) * _C)
        t = seat(n[several], tables[c[several]] - got[2].astype(np.float64), p0[w[several]], m.theta, d, key, salt)
        customers = k - np.bincount(w[several], minlength=len(words)) + np.bincount(w[several], t, minlength=len(words)).astype(np.int64)
        cold = at < 0
        seated = np.zeros(len(words))
        seated[cold] = parent.seat(customers[cold], got[1][cold], mix(words[cold]), salt + 1)
        kept = got[4:]
        if keep:
            kept += [customers, seated]
            got[3] = got[3].astype(np.int64) + t.astype(np.int64)
        yield b, WORDS, b, pack(*(_small(x) for x in (customers, seated, t, got[3], *kept)))
        sums = np.bincount(c[several], t, minlength=len(ctx))[mine]
        for cell, lo, hi in to:
            yield cell, UP, b, pack(_small(sums[order[lo:hi]]))
        yield b, STATS, b, pack(np.array([customers[cold].sum(), seated[cold].sum()], np.int64), _small(at[~cold]), customers[~cold])

    return read


def _answers(samples: int, hot_rows: np.ndarray):
    """A box's answers to the chunks: pairs' counts and tables, words' counts and tables in both restaurants.

    ``hot_rows`` has these of the hot words, a column each.
    """

    def read(b, mail):
        if ASKED not in mail:
            return
        words, k, _, _, n = unpack(mail[STATE][0]["data"])
        k, n = k.astype(np.int64), n.astype(np.int64)
        _, _, _, sums, *kept = unpack(mail[WORDS][0]["data"])
        count = np.bincount(np.repeat(np.arange(len(words)), k), n, minlength=len(words))
        row = np.zeros((1 + 3 * samples, len(words)), np.int64)
        row[0] = count
        for j in range(samples):
            row[1 + j], row[1 + samples + j] = kept[2 * j], kept[2 * j + 1]
        if OWN in mail:
            ctx = unpack(mail[OWN][0]["data"])[0]  # of one cell
            at = _find(ctx, words >> _SHORT)
            for j, r in enumerate(mail[TABLES]):
                row[1 + 2 * samples + j] = np.where(at >= 0, unpack(r["data"])[0][at].astype(np.int64), 0)
        row = np.concatenate((np.zeros((len(row), 1), np.int64), row, hot_rows), axis=1)
        t = np.ones(len(n), np.int64) * samples
        t[n > 1] = sums
        base = np.concatenate(([0], np.cumsum(k) - k, np.zeros(hot_rows.shape[1], np.int64)))
        for r in mail[ASKED]:
            word, size, pair, place = unpack(r["data"])
            word, pair = word.astype(np.int64), pair.astype(np.int64)
            at = np.repeat(base[word], size.astype(np.int64)) + pair - 1
            seen = pair > 0
            mine = np.zeros((2, len(pair)), np.int64)
            mine[0, seen], mine[1, seen] = n[at[seen]], t[at[seen]]
            yield b, ANSWER, r["of"], pack(size, place, _small(mine[0]), _small(mine[1]), *(_small(x[word]) for x in row))

    return read


def _finisher(m: Model, d: float, parents: list[_Parent], total: int, types: int):
    """A chunk's documents from its tokens and the answers; predictive probabilities are averaged over the states."""
    scale, s = total + 0.5 * (types + 1), m.samples

    def score(mail):
        sizes, _, w, c, of = _pairs(mail[CHUNK][0]["data"], m.contexts)
        own, row = np.zeros((2, len(w))), np.zeros((1 + 3 * s, int(w.max()) + 1))
        for r in mail.get(ANSWER, []):
            size, place, n, t, *words = unpack(r["data"])
            place = _sums(place)
            own[0, place], own[1, place] = n, t
            first = np.cumsum(size, dtype=np.int64) - size
            row[:, w[place[first]]] = words
        count = row[0]
        p = np.where(own[0] > 0, own[0] - d * own[1] / s, 0.0)
        for j in range(s):
            p0 = np.where(count > 0, parents[j].p(row[1 + j], row[1 + s + j]), parents[j].unknown())
            tables = row[1 + 2 * s + j]
            p += (m.theta + d * tables[c]) * p0[w] / s
        p = np.log10(p / (m.theta + (count[c] if m.contexts else total)))
        base, known = np.log10((count + 0.5) / scale)[w], (count > 0)[w].astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        return [pa.array(sizes), *[pa.array(np.add.reduceat(x[of], begin)) for x in (known, base, p)]]

    def run(batches):
        for _, mail in _grouped(batches, "of"):
            yield pa.RecordBatch.from_arrays([pa.array(mail[CHUNK][0]["ids"], pa.int64()), *score(mail)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


#: Totals, by what they are of: a box's own numbers, then numbers by hot word.
_TOTAL = "part int, at long, n long"


def _sum_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a partition's ``STATS``: numbers by place, and by the hot words' places. A row has arrays
    (numbers, places, numbers by place...)."""
    sums: dict[tuple[int, int], int] = {}
    for batch in batches:
        for data in batch.column("data"):
            numbers, at, *by_at = unpack(data.as_py())
            for part, (places, values) in enumerate([(np.arange(len(numbers)), numbers), *((at, x) for x in by_at)]):
                for key, x in zip(places.tolist(), values.tolist()):
                    sums[part, key] = sums.get((part, key), 0) + x
    if sums:
        part, at = zip(*sums)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(at, pa.int64()), pa.array(list(sums.values()), pa.int64())], ["part", "at", "n"])


def _stats(sent: DataFrame, *sizes: int) -> list[np.ndarray]:
    """What ``sent`` tells, summed by Spark: an array of each of these sizes. A row a number reaches the driver,
    however many boxes there are."""
    out = [np.zeros(n, np.int64) for n in sizes]
    told = sent.where(F.col("kind") == STATS).select("data").mapInArrow(_sum_stats, _TOTAL)
    for r in told.groupBy("part", "at").agg(F.sum("n").alias("n")).collect():
        out[r["part"]][r["at"]] = r["n"]
    return out


def score_documents(docs: DataFrame, train: Column, model: Model = Model()) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Learns from the rows where ``train`` holds. ``base_score`` is an add-half unigram log10 probability,
    ``score`` the hierarchical model's.

    Texts become chunks of numbered tokens in a written table. A chunk sends its distinct (word, context)
    pairs with their training counts to boxes by word; words with more than half a box are cut into slices by
    context, so no box grows with one word. A box sums its pairs and remembers what each chunk asked. In each
    sweep boxes seat all customers of all pairs by their contexts' tables and their words' parent
    probability of the sweep before, and send the tables of each context, summed, to the context's cell, which
    sends the total back; a cell serves several boxes, so messages stay few. Predictive probabilities are averaged over the last ``samples`` states. Answers go
    back to the chunks as whole numbers. No pair and no context is left out; what is gathered grows with them.
    Words are told apart by 64 bits of hash, contexts by 48 (of 10^8 words some 18 pairs share a restaurant).

    Ids are whole numbers. Null and empty texts are the end token alone; an untrained model (no training rows) knows only the
    unknown symbol; rows that repeat are scored each; other columns are not read; an empty table gives none.
    """
    m = model
    if m.contexts not in (0, 1):
        raise ValueError("contexts of no or one word")
    spark = docs.sparkSession
    scratch = Scratch(spark, "hpy")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("_train"))
    packed = src.mapInArrow(_packer(m.chunk_bytes), "ids array<long>, n long, much binary, ws binary, body binary")
    packed = scratch.pin(packed.withColumn("chunk", F.monotonically_increasing_id()))
    total = packed.agg(F.sum("n")).first()[0] or 0
    boxes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BOX_TOKENS))
    # a chunk names at most MOST_HOT words; those with more than half a box are at most 2 * boxes
    named = packed.select("much").mapInArrow(_named, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    named = named.where(F.col("n") * min(2 * boxes, MOST_HOT) > total).collect()
    hot = np.array([r["w"] for r in named], np.int64).view(np.uint64)
    order = np.argsort(hot)
    hot, slices = hot[order], np.array([-(-r["n"] * 2 * boxes // total) for r in named], np.int64)[order]

    cells = max(1, boxes // CELL_BOXES)
    asks = packed.select("chunk", "ws", "body").mapInArrow(_asker(m.contexts, boxes, hot, slices), MSG)
    counted = scratch.pin(_deliver(boxes, _collect_counts(boxes, cells, hot), asks), by="kind")
    of = lambda t, *kinds: t.where(F.col("kind").isin(*kinds)).select("b", "kind", "of", "data")
    numbers, hot_count, hot_c0 = _stats(counted, 6, len(hot), len(hot))
    n1, n2, one, two, types, c0 = numbers.tolist()
    types += int((hot_count > 0).sum())
    discount = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5
    d, d0, h = discount(n1, n2), discount(one, two), 1.0 / (types + 1)

    told = first = scratch.pin(_deliver(cells, _first_cells(boxes), of(counted, FIRST_UP)), by="kind")
    words, tables, parents, hot_tables = None, None, [], []
    parent = _Parent(m.theta, d0, float(c0), float(types), h, hot, hot_c0, np.minimum(hot_c0, 1))
    for sweep in range(m.sweeps + m.samples):
        keep, salt = sweep >= m.sweeps, 1000 * (sweep + 1)
        read = [of(counted, STATE), of(told, DOWN), *([of(words, WORDS)] if words else [])]
        then = scratch.pin(_deliver(boxes, _sweep(m, boxes, cells, d, parent, salt, keep), *read), by="kind")
        numbers, hot_c0 = _stats(then, 2, len(hot))
        customers, seated = numbers.tolist()
        hot_t0 = parent.seat(hot_c0, parent.hot_tables, mix(hot), salt + 1)
        parent = _Parent(m.theta, d0, float(customers + hot_c0.sum()), float(seated + hot_t0.sum()), h, hot, hot_c0, hot_t0)
        told = scratch.pin(_deliver(cells, _cells(boxes, hot, sweep, keep), of(first, CELL, PLACES), of(then, UP)), by="kind")
        if keep:
            parents.append(parent)
            hot_tables.append(_stats(told, 0, len(hot))[1])
            tables = of(told, TABLES) if tables is None else tables.unionByName(of(told, TABLES))
        words = then

    hot_rows = np.array([hot_count, *(p.hot_customers for p in parents), *(p.hot_tables for p in parents), *hot_tables], np.int64).reshape(1 + 3 * m.samples, len(hot))
    reads = [of(counted, STATE, ASKED), of(words, WORDS), of(first, OWN), *([tables] if tables else [])]
    answers = scratch.pin(_deliver(boxes, _answers(m.samples, hot_rows), *reads))
    scratch.keep(packed, answers)
    none = F.lit(None).cast("array<long>").alias("ids")
    both = packed.select(F.col("chunk").alias("of"), F.lit(CHUNK).alias("kind"), "ids", F.col("body").alias("data")).unionByName(answers.select("of", "kind", none, "data"))
    done = both.repartition("of").sortWithinPartitions("of", "kind").mapInArrow(_finisher(m, d, parents, total, types), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return done.withColumn("train_tokens", F.lit(total).cast("long"))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in range(b.num_rows):
            w, n = unpack(b.column(0)[r].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], ["w", "n"])


def perplexity(scores: DataFrame) -> DataFrame:
    """Per-token perplexity of all rows, from ``score`` and ``n_tokens``."""
    return scores.agg(F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"))


def op10_language_model(spark, sf_dir):
    """All documents; those with crc32(doc_id) mod 5 = 1 are held out."""
    from .toxicity import held_out

    out = held_out(F.col("doc_id"), 1)
    s = score_documents(table(spark, sf_dir, "documents"), ~out)
    return s.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
