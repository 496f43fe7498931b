"""Ranked search, packing and vector codes against brute force; their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from evalloom.llm import codes, packing, queries, ranking

Q = queries.queries()
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, size=20):
    """The contract's scores one document at a time."""
    ws = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in ws), sum(sum(c.values()) for _, c in ws)
    df = Counter(t for _, c in ws for t in c)
    out = []
    for item, text in items:
        got = []
        for i, c in ws:
            m = 75 + 25 * sum(c.values()) * n // total if c else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s:
                got.append((-s, i is None, i or 0))
        out += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(got)[:size], 1)]
    return out


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents and items with repeated and missing ids, odd texts, ties and columns whose names clash."""
    rng = random.Random(3)
    vocab = [*(f"w{i}" for i in range(300)), "the", "Zürich", "zürich", "don't"]
    text = lambda n: " ".join(rng.choices(vocab, [1 + 400 // (k + 1) for k in range(len(vocab))], k=n))
    rows = [(i, text(rng.randrange(1, 90))) for i in range(700)]
    rows += [(700, None), (701, ""), (702, " \n.,"), (703, "w299 " * 30_000), (None, text(9)), (None, rows[5][1]), (5, rows[5][1]), (704, rows[5][1]), (703, "w1 w2"), (705, "<|endoftext|> Ünï İ ΑΣ don't 12,5!? <b> x́ a\x1cb c")]
    items = [(1, "w1 w2 w2 zürich"), (2, "Zürich ZÜRICH w299"), (2, "w299"), (3, None), (4, ""), (5, "nowhere"), (None, "the w7"), (6, rows[5][1]), (7, "w1 " * 50)]
    out = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, score string, _heap int, length int").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, n int").coalesce(1).write.parquet(f"{out}/benchmark.parquet")
    return out, rows, items


def test_op11_against_brute_force(spark, odd):
    path, rows, items = odd
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted(map(tuple, Q["op11_ranking"](spark, path).collect()), key=key)
    assert got == sorted(ranked(rows, items), key=key)


def test_items_in_blocks_and_small_shards_rank_alike(spark, odd, monkeypatch):
    path, rows, items = odd
    docs, bench = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(str, ranking.search(docs, bench, 7).collect()))
    monkeypatch.setattr(ranking, "BLOCK_TERMS", 20)
    assert sorted(map(str, ranking.search(docs, bench, 7).collect())) == whole


@pytest.mark.parametrize("seed", range(30))
def test_blocks_are_cut_at_least_error(seed):
    rng = np.random.default_rng(seed)
    starts = np.concatenate(([0], np.cumsum(rng.integers(0, 14, 6))))
    v, longest, cost = rng.integers(0, int(rng.integers(1, 60)), starts[-1]), int(rng.integers(1, 8)), int(rng.integers(0, 3))
    ends = ranking.cut(v, starts, longest, cost)
    for a, b in zip(starts, starts[1:]):
        x = v[a:b].tolist()
        if not x:
            continue
        each = max((max(x) - min(x)) * cost, 1)

        @lru_cache(None)
        def least(i):
            return 0 if not i else min(least(i - k) + max(x[i - k : i]) * k + each for k in range(1, min(longest, i) + 1))  # noqa: B023

        mine = [int(e) for e in ends if a < e <= b]
        cuts = list(zip([a, *mine], mine))
        assert mine[-1] == b and all(q - p <= longest for p, q in cuts)
        assert sum(max(v[p:q]) * (q - p) + each for p, q in cuts) == least(len(x))


def test_search_skips_blocks_and_stays_exact():
    rng = np.random.default_rng(4)
    n = 6000
    words = np.concatenate([np.full(n // 2, 7, np.uint64), rng.integers(0, 40, n * 8, dtype=np.uint64)])
    ptr = np.sort(np.concatenate(([0, len(words)], rng.integers(0, len(words), n - 1))))
    t, s, d, f = ranking.invert(words, ptr)
    m = 75 + np.diff(ptr) // 3
    lists = ranking.Lists(t, s, d, f, np.arange(40, dtype=np.uint64), m)
    term, weight = np.array([3, 7]), np.array([50, 900])
    best = ranking.Best(20)
    read = lists.search(term, weight, n, best, np.arange(n), np.ones(n, bool))
    score = np.zeros(n, np.int64)
    for k, w in zip(term, weight):
        lo, hi = lists.starts[k], lists.starts[k + 1]
        score[lists.docs[lo:hi]] += w * lists.impact[lo:hi]
    want = np.lexsort((np.arange(n), -score))[:20]
    assert best.id.tolist() == want.tolist() and best.score.tolist() == score[want].tolist()
    assert read < sum(lists.starts[k + 1] - lists.starts[k] for k in term) / 2


def pieces_of(rows, capacity=4096):
    t = Tokenizer.from_file(TOKENIZER)
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, lo in enumerate(range(0, len(ids), capacity)):
            part = ids[lo : lo + capacity]
            yield i, k, lo, len(part), zlib.crc32(np.array(part, "<u4").tobytes())


def gapless(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and sum(n for _, n in spans) <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    return len(by)


def test_op12_against_the_tokenizer(spark, odd):
    path, rows, _ = odd
    got = Q["op12_packing"](spark, path).collect()
    assert Counter(tuple(r[:5]) for r in got) == Counter(pieces_of(rows))
    total = sum(r.length for r in got)
    assert gapless(got, 4096) == -(-total // 4096)


def test_sequences_give_the_ids_back(spark, odd):
    path, rows, _ = odd
    got = packing.pack(spark.read.parquet(f"{path}/documents.parquet"), TOKENIZER, capacity=100, end=9, keep_ids=True)
    whole = packing.sequences(got).collect()
    t = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 9]
        want.update((i, k, tuple(ids[lo : lo + 100])) for k, lo in enumerate(range(0, len(ids), 100)))
    have = Counter((s.doc_id, s.piece, tuple(r.ids[s.offset : s.offset + s.length])) for r in whole for s in r.spans)
    assert have == want and all(len(r.ids) <= 100 for r in whole)


class Counted:
    """A tokenizer that counts the calls and the characters that it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls, self.given = tokenizer, 0, 0

    def __getattr__(self, name):
        def call(x, **options):
            self.calls, self.given = self.calls + 1, self.given + sum(map(len, [x] if isinstance(x, str) else x))
            return getattr(self.tokenizer, name)(x, **options)

        return call


def encoded(e, texts):
    ids, bounds = e.ids(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_new_words_are_encoded_many_at_once_and_known_ones_never_again():
    e, rng = packing.Encoder(TOKENIZER), random.Random(5)
    e.tokenizer = Counted(tokenizer := e.tokenizer)
    words = list({"".join(rng.choices("abcdefghijklmnoprstuväéñ", k=rng.randrange(3, 12))) for _ in range(20_000)})
    texts = [" ".join(rng.choice([w, w.title(), f"{w},", f"{w}!!"]) for w in words[k::50]) for k in range(50)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoded(e, texts) == want
    assert e.tokenizer.calls <= 5 and e.tokenizer.given < 1.01 * sum(len(w) + 1 for w in words)  # words in two calls, marks, and nothing
    before = e.tokenizer.calls
    assert encoded(e, [t.upper() for t in texts]) == want and e.tokenizer.calls == before


def test_encoder_equals_the_tokenizer_on_odd_chunks(monkeypatch):
    rng, tokenizer = random.Random(6), Tokenizer.from_file(TOKENIZER)
    odd = ["'s", "'LL", "'", "<|endoftext|>", "<|END", "<", "|>", "</w>", "\u0301", "\u030c", "\u0338", "İ", "Σ", "ß", "ÿ", "À", "×", "÷", "ª", "µ", "\xa0", "\x85", "\u3000", "\x1c", "\x00", "7", "Ⅷ", "中", "Ж", "ﬁ", "=", ">", "~", "`", "\\", "]", *"abJK.,!-_"]
    texts = [None, "", " \t", *("".join(rng.choices([*odd, *" \n\x0b"], k=rng.randrange(1, 40))) for _ in range(4000)), "long" * 40 + "!! ", "x" * 5000]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    e = packing.Encoder(TOKENIZER)
    assert encoded(e, texts) == want and encoded(e, texts[::-1]) == want[::-1] and max(map(len, e)) <= packing.CHUNK
    for name, small in (("REMEMBERED", 60), ("AT_ONCE", 17), ("WORDS", 3)):
        monkeypatch.setattr(packing, name, small)
    e = packing.Encoder(TOKENIZER)
    assert encoded(e, texts[:400]) == want[:400] and len(e) + len(e.before) < 200
    e.last[:] = False  # as of a tokenizer without marks where words end
    assert encoded(e, texts[:1:-20]) == want[:1:-20]


def best_fit(counts, capacity):
    gaps = []
    for n in sorted(Counter(counts).elements(), reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=gaps.__getitem__)] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(25))
def test_plans_use_every_piece_and_beat_best_fit(seed):
    rng = random.Random(seed)
    top = rng.choice([30, 60, 100])
    counts = Counter(rng.randrange(1, top + 1) for _ in range(rng.randrange(1, 400)))
    made = packing.plan(counts, 100)
    used = Counter()
    for times, lengths in made:
        assert sum(lengths) <= 100 and times > 0
        used.update({n: k * times for n, k in Counter(lengths).items()})
    assert used == counts
    n = sum(times for times, _ in made)
    assert n <= best_fit(counts, 100) + 1
    places = packing.Places(made)
    spots = sorted((int(s), int(o), n) for n, k in counts.items() for s, o in zip(*places.find(np.full(k, n), np.arange(k))))
    assert places.n_sequences == n and all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(spots, spots[1:]))


def test_exact_fills_take_one_two_or_three():
    free = Counter({5: 1, 7: 2, 9: 1})
    bits = sum(1 << n for n in free)
    asked = lambda gap: packing.fill(free, sorted(free), bits, gap)
    assert (asked(9), asked(14), asked(16), asked(21), asked(23), asked(10), asked(30)) == ([9], [9, 5], [9, 7], [9, 7, 5], [9, 7, 7], None, None)


def test_plans_of_huge_counts_are_quick():
    made = packing.plan({n: 10**9 + n for n in range(1, 4097, 7)})
    assert len(made) < 3 * 4097


def coded(rows, parts=4, k=256, rounds=4):
    """Plain Lloyd rounds in Python's whole numbers."""
    width = max(1, -(-max((len(x) for _, x, _ in rows), default=0) // parts))
    cut = [[[math.floor(1024 * v) if v is not None else 0 for v in [*x, *[0.0] * (parts * width - len(x))][p * width : (p + 1) * width]] for p in range(parts)] for _, x, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:k]
    books = [[cut[i][p] for i in order] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for x in cut:
                mine[near(x[p], books[p])[1]].append(x[p])
            books[p] = [[sum(col) // len(mine[e]) for col in zip(*mine[e])] if e in mine else c for e, c in enumerate(books[p])]
    got = [[near(x[p], books[p]) for p in range(parts)] for x in cut]
    return [("".join(f"{e:02x}" for _, e in g), sum(d for d, _ in g)) for g in got], hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()


def vectors(n, dim, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    return (rng.integers(-3, 4, (n, dim)) * 0.37 * scale).astype(np.float32).astype(float).tolist()  # many ties


@pytest.mark.parametrize(("n", "dim", "scale"), [(420, 8, 1.0), (60, 8, 1.0), (300, 8, 1e30), (300, 8, 1e-6), (270, 10, 1.0)])
def test_op13_against_plain_lloyd(spark, tmp_path, n, dim, scale):
    rows = [(i * 3 % n, x, i % 4 if i % 5 else None) for i, x in enumerate(vectors(n, dim, 1, scale))]
    rows += [rows[0], (None, rows[3][1], 1), (n, rows[1][1][: dim - 1], 2), (n + 1, [0.0] * dim, 7)]
    bad = [(n + 2, None, 1), (n + 3, [1.0, None], 1), (n + 4, [float("nan")] * dim, 1), (n + 5, [float("inf")] * dim, None)]
    spark.createDataFrame([(*r, "x", 5) for r in rows + bad], "vec_id long, embedding array<float>, label int, code string, _n int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Q["op13_codes"](spark, str(tmp_path)).collect()
    want, digest = coded(rows)
    per = Counter()
    for (_, _, label), (_, error) in zip(rows, want):
        per[label] += error
    small = lambda v: v if v < 1 << 63 else None
    assert {r.codebooks_sha256 for r in got} == {digest}
    if scale > 1e6:
        assert Counter((r.vec_id, r.code, r.error) for r in got) == Counter((i, c, small(e)) for (i, _, _), (c, e) in zip(rows, want))
    else:
        assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == Counter((i, c, e, per[label]) for (i, _, label), (c, e) in zip(rows, want))


@pytest.mark.parametrize("shift", [0, 140])
def test_group_bounds_hold_and_save_distances(shift):
    rng = np.random.default_rng(2)
    x = rng.integers(-9, 9, (300, 4))
    x = x if not shift else np.array([[int(v) * 10**40 for v in r] for r in x], object)
    c = x[:60].copy()
    book = codes.Book(c, codes.groups(c, shift), np.zeros(60), shift)
    entry, lower, work = np.zeros(300, np.int64), np.full((300, int(book.group.max()) + 1), -np.inf, np.float32), []
    for _ in range(6):
        entry, squared, lower, n = codes.assign(x, book, entry.astype(np.int64), lower)
        work.append(n)
        assert entry.tolist() == [min(range(60), key=lambda j: (int(sum((x[i] - c[j]) ** 2)), j)) for i in range(300)]
        for i in range(0, 300, 7):
            for g, m in enumerate(book.members()):
                d = [float(sum((x[i] - c[j]) ** 2) / (1 << 2 * shift)) ** 0.5 for j in m if j != entry[i]]
                assert not d or lower[i, g] <= min(d)
        new = c.copy()
        for j in set(entry.tolist()):
            new[j] = [int(sum(int(v) for v in col)) // int((entry == j).sum()) for col in x[entry == j].T]
        moved = np.sqrt(codes._floats(codes._squared(new, c), 2 * shift)) * (1 + 1e-9)
        c, book = new, codes.Book(new, book.group, moved, shift)
    assert work[0] >= 300 * 59 and max(work[1:]) < work[0] * 2 / 3


def test_codes_without_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    got, books = codes.quantise(empty)
    assert got.collect() == [] and all(len(b) == 0 for b in books)
    with pytest.raises(ValueError, match="256"):
        codes.quantise(empty, entries=257)
