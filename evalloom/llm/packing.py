"""Packing tokenised documents into as few sequences as possible by exact complements of length sums."""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch, table

#: Fixed values of the queries: tokens of a sequence, and the id that ends a document.
CAPACITY, END = 4096, 1
#: Words and other chunks between white space that a worker remembers the ids of, and characters of one at most.
REMEMBERED, CHUNK = 1 << 20, 64
#: What is encoded at a time: bytes of texts, about, chunks of them, and new words.
BYTES, AT_ONCE, WORDS = 8 << 20, 1 << 20, 1 << 14
#: A word of ASCII or Latin-1 letters, and ASCII marks that end it; no ``<``, with which added tokens begin.
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_WORD = rf"^(?P<word>{_LETTERS})(?P<marks>[!-/:;=-@\[-`{{-~]*)$"


class Encoder(dict):
    """Ids of whole texts, as unsigned 32-bit numbers, by a tokenizer file whose tokens never span white space
    and don't depend on what lies beyond it (``word_bpe_49k.json`` is such). What stands between ASCII white space is
    looked up once a batch. Words of Latin letters are encoded in lower case, apart from marks that end them and many at
    once; other chunks one by one.

    When half of ``REMEMBERED`` words and chunks of ``CHUNK`` characters are held, those of the time before that weren't
    met again go: a worker's memory is bounded, and frequent words stay.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.before: dict[str, bytes] = {}
        suffix, vocab = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)  # ids that end a word
        self.last[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of distinct words and chunks that aren't held; short ones are held from now on."""
        got = {p: self.before.pop(p, None) for p in parts}
        words = [p for p, x in got.items() if x is None and re.fullmatch(_LETTERS, p)]
        for lo in range(0, len(words), WORDS):
            some = words[lo : lo + WORDS]
            ids = self.encode(" ".join(some))
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):  # else this tokenizer doesn't mark where words end
                raw = ids.tobytes()
                got.update(zip(some, (raw[i:k] for i, k in pairwise([0, *(4 * ends).tolist()]))))
        got = {p: self.encode(p).tobytes() if x is None else x for p, x in got.items()}
        self.update((p, x) for p, x in got.items() if len(p) <= CHUNK)  # long ones are seldom seen again
        return got

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and where each text's begin and the last one's end."""
        chunks = pc.ascii_split_whitespace(texts.fill_null(""))
        out, per = [np.zeros(0, "<u4")], [np.zeros(1, np.int64)]
        for lo in range(0, len(chunks.values), AT_ONCE):
            if len(self) > REMEMBERED // 2:
                self.before = dict(self)
                self.clear()
            code = chunks.values.slice(lo, AT_ONCE).dictionary_encode()
            cut = pc.extract_regex(code.dictionary, _WORD)  # null if it is no word
            word, marks = pc.coalesce(pc.utf8_lower(pc.struct_field(cut, "word")), code.dictionary), pc.coalesce(pc.struct_field(cut, "marks"), "")
            part = pa.concat_arrays([word, marks]).dictionary_encode()
            parts = part.dictionary.to_numpy(zero_copy_only=False).tolist()
            known = list(map(self.get, parts))
            new = self.learn([p for p, x in zip(parts, known) if x is None])
            known = [new[p] if x is None else x for p, x in zip(parts, known)]
            ids, sizes = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
            both = part.indices.to_numpy().reshape(2, -1).T.ravel()  # a chunk's word, then its marks
            ids, sizes = _spread(ids, sizes, both), sizes[both].reshape(-1, 2).sum(1)
            at = code.indices.to_numpy()
            out.append(_spread(ids, sizes, at))
            per.append(sizes[at])
        return np.concatenate(out), np.cumsum(np.concatenate(per))[chunks.offsets.to_numpy()]


def _spread(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs ``at`` of ``ids``, one behind the other, where ``sizes`` cut ``ids`` into runs."""
    n = sizes[at]
    shift = (np.cumsum(sizes) - sizes)[at] - (np.cumsum(n) - n)
    return ids[np.arange(n.sum()) + np.repeat(shift, n)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of this file: what it remembers serves the tasks that follow."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _cutter(path: str, capacity: int, end: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, seen, task = encoder(path).ids, [0] * (capacity + 1), TaskContext.get().partitionId()
        for batch in batches:
            step = max(1, batch.num_rows * BYTES // max(1, batch.column(1).nbytes))
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                ids, bounds = ids_of(b.column(1))
                ids = np.insert(ids, bounds[1:], end)
                bounds += np.arange(len(bounds))  # an end a text
                doc, piece, start, length, crc, nth = [], [], [], [], [], []
                for r, (first, beyond) in enumerate(pairwise(bounds.tolist())):
                    for k, lo in enumerate(range(first, beyond, capacity)):
                        n = min(capacity, beyond - lo)
                        doc.append(r), piece.append(k), start.append(lo - first), length.append(n)
                        crc.append(zlib.crc32(ids[lo : lo + n])), nth.append(seen[n])
                        seen[n] += 1
                cols = [b.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([task] * len(doc), pa.int32()), pa.array(nth, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_nth"]
                if keep_ids:  # pieces lie one behind the other
                    cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length]), pa.int32()), pa.array(ids.view("<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def fill(free: Counter, lengths: list[int], bits: int, gap: int) -> list[int] | None:
    """One, two or three lengths with ``free`` copies whose sum is ``gap``, those with the greatest length first;
    None if there are none. Bit n of ``bits`` tells that n is free; ``lengths`` are the same, ascending."""
    if bits >> gap & 1:
        return [gap]
    most = lengths[-1] if lengths else 0
    if gap <= 2 * most and (pair := _pair(free, lengths, bits, gap)):
        return pair
    if gap <= 3 * most:
        for a in lengths[bisect_right(lengths, gap - 2) - 1 :: -1] if lengths[0] <= gap - 2 else []:
            if 3 * a < gap:
                break  # a is the greatest of the three
            free[a] -= 1
            pair = _pair(free, lengths, bits, gap - a, a)
            free[a] += 1
            if pair:
                return [a, *pair]
    return None


def _pair(free: Counter, lengths: list[int], bits: int, total: int, most: int | None = None) -> list[int] | None:
    """The pair of free lengths of ``total`` with the greatest first, which is ``most`` at most."""
    at = bisect_right(lengths, min(total - 1, most or total))
    for a in lengths[at - 1 :: -1] if at else []:
        b = total - a
        if b > a:
            return None
        if bits >> b & 1 and free[a] >= 1 + (a == b) and free[b] >= 1:
            return [a, b]
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths) patterns that use up ``counts`` (length: pieces), each of at most ``capacity`` in sum.

    A sequence opens with the greatest length left. As soon as one, two or three free lengths fill its gap exactly
    they are taken; until then it takes the greatest length that fits, its best fit. A pattern is repeated
    until too few of one of its lengths are left, so there are a few patterns a length at most: the work
    doesn't grow with the pieces.
    """
    free = Counter({n: c for n, c in counts.items() if c > 0})
    out = []
    while free:
        lengths = sorted(free)
        used: Counter = Counter()
        gap = capacity

        def take(n: int) -> None:
            used[n] += 1
            free[n] -= 1
            if not free[n]:
                lengths.remove(n)

        take(lengths[-1])
        gap -= next(iter(used))
        while gap and lengths and lengths[0] <= gap:
            bits = sum(1 << n for n in lengths)
            exact = fill(free, lengths, bits, gap)
            for n in exact or [lengths[bisect_right(lengths, gap) - 1]]:
                take(n)
                gap -= n
        free.update(used)
        times = min(free[n] // k for n, k in used.items())
        out.append((times, sorted(used.elements(), reverse=True)))
        free.subtract({n: k * times for n, k in used.items()})
        free = +free
    return out


class Places:
    """Where the ``rank``-th piece of a length goes: a row of segments for each (pattern, length)."""

    def __init__(self, patterns: list[tuple[int, list[int]]]):
        rows, done, base = [], Counter(), 0
        for times, lengths in patterns:
            off = 0
            for n, k in Counter(lengths).items():
                rows.append((n, done[n], k, base, off))
                done[n] += k * times
                off += n * k
            base += times
        rows.sort()
        self.rows = np.array(rows, np.int64).reshape(-1, 5)
        self.n_sequences = base

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by length and rank among the pieces of that length."""
        n, first, each, base, off = self.rows.T
        at = np.zeros(len(length), np.int64)
        for one in np.unique(length):
            mine, lo, hi = np.flatnonzero(length == one), *np.searchsorted(n, [one, one + 1])
            at[mine] = lo + np.searchsorted(first[lo:hi], rank[mine], "right") - 1
        inside = rank - first[at]
        return base[at] + inside // each[at], off[at] + inside % each[at] * length


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): a row a piece of every row of ``docs``.

    A document is its text's ids and ``end``; longer ones are cut into pieces of ``capacity``, the last of which may be
    shorter. Pieces are counted by length, of which there are at most ``capacity``, and ``plan`` packs these counts
    on the driver. Each piece is told apart by its rank among those of its length, so it finds its sequence and
    offset by itself: no group of pieces or sequences meets in a task, however common a length is.

    Null and empty texts are ``end`` alone; rows that repeat a doc_id or have none are packed each; an empty table
    gives none; other columns are not read. ``tokenizer`` is a file that every executor has; ``Encoder`` says
    which kind it must be. Texts are read whole; a task holds the ids of ``BYTES`` of texts, or of one longer text, beside its batch.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, _task int, _nth long" + (", ids array<int>" if keep_ids else "")
    pieces = scratch.pin(docs.select("doc_id", "text").mapInArrow(_cutter(tokenizer, capacity, end, keep_ids), schema))
    per = pieces.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_task")) - F.col("_n")  # a row a task that has the length
    starts = scratch.pin(per.select("length", "_task", "_n", before.alias("_before")))
    counts = starts.groupBy("length").agg(F.sum("_n").alias("n")).collect()  # at most ``capacity`` rows
    places = spark.sparkContext.broadcast(Places(plan({r["length"]: r["n"] for r in counts}, capacity)))
    ranked = pieces.join(starts.drop("_n").hint("merge"), ["length", "_task"]).withColumn("_rank", F.col("_before") + F.col("_nth"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = places.value.find(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank")))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *map(pa.array, at)], [*names, "sequence_id", "offset"])

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*names, "_rank").mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, spans): whole sequences of ``pack(..., keep_ids=True)``, with (doc_id, piece, offset, length) of
    what lies in them. A sequence has at most ``capacity`` ids, so its group is small."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    got = packed.groupBy("sequence_id").agg(parts.alias("p"))
    span = F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length")))
    return got.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), span.alias("spans"))


def op12_packing(spark, sf_dir):
    """All documents in sequences of 4,096 tokens of ``word_bpe_49k.json``; null texts are the end token alone."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
