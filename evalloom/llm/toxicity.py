"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import table

# Closed word classes of the grammar in the corpus's languages. A threat is a verb aimed at a
# target; clitics are targets that may stand before their verb.
THREAT = frozenset("kill hurt destroy burn beat punish shoot crush töten schlagen vernichten zerstören tuer frapper détruire brûler matar golpear destruir quemar".split())
TARGET = frozenset("you your yours u du dir dein ihr tu vous votre ton tú usted ustedes vosotros".split())
CLITIC = frozenset("dich euch te toi os".split())
NEGATION = frozenset("not no never none without nicht kein keine nie niemals pas jamais sin nunca jamás".split())
REPORT = frozenset("said says say told quote quoted claimed wrote sagte sagt schrieb dit disait écrit dijo dice escribió".split())

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of stems.
PREFIX = (4, 5, 6, 7, 8)
#: What a token is read as: insult, threat verb, target, clitic, negation, report, other. A ``~`` marks what a
#: negation governs, a quote mark what is reported, ``@`` what is aimed at a target.
INSULT, VERB, AT, BEFORE, NO, SAID, OTHER = LETTERS = "ivtcnro"
_MARKED = (INSULT, VERB)


@dataclass(frozen=True)
class Params:
    """``max_rows`` labelled rows at most are used to fit (those with the smallest hash of doc_id). ``negated``,
    ``reported``, ``aimed`` and ``threat`` are arc weights to start from; the fit moves them along ``steps``."""

    max_rows: int = 20_000
    least_docs: int = 3
    chance: float = 0.01
    least_weight: float = 2.0
    negated: float = 0.5
    reported: float = 0.6
    aimed: float = 1.3
    threat: float = 1.0
    reach: int = 3
    steps: tuple[float, ...] = (0.5, 0.7, 1.0, 1.4, 2.0)


class Transducer:
    """A weighted finite-state transducer over letters.

    ``arcs[state, letter]`` lists (letter written, weight, next state); paths run from state 0 to a state
    of ``final``. An arc's weight multiplies the lexical weight of the token it reads; a path's score is
    the sum of these over its tokens.
    """

    def __init__(self, arcs: dict[tuple[int, str], list[tuple[str, float, int]]], final: frozenset[int]):
        self.arcs, self.final = arcs, final

    def best(self, tokens: list[list[tuple[str, float]]]) -> tuple[float, list[tuple[str, float]]] | None:
        """The greatest score of any path over tokens, each given by its readings (letter, lexical weight),
        and what that path writes; ties go to the path found first. None if no path ends."""
        live: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for readings in tokens:
            then: dict[int, tuple[float, tuple | None]] = {}
            for state, (score, past) in live.items():
                for letter, lexical in readings:
                    for out, weight, to in self.arcs.get((state, letter), ()):
                        got = score + weight * lexical
                        if to not in then or got > then[to][0]:
                            then[to] = (got, (out, lexical, past) if lexical else past)
            live = then
        ends = [live[s] for s in live if s in self.final]
        if not ends:
            return None
        score, past = max(ends, key=lambda e: e[0])
        said = []
        while past:
            said.append((past[0], past[1]))
            past = past[2]
        return score, said[::-1]


def build(states: list, finals: list, step) -> Transducer:
    """A transducer from named states (the first one starts) and ``step(state, letter)`` -> [(out, weight, next)],
    over all letters that may be written before it."""
    no = {s: i for i, s in enumerate(states)}
    letters = [*LETTERS, *(x + a + b for x in _MARKED for a in ("", "~") for b in ("", '"') if a or b)]
    arcs = {(no[s], x): [(o, w, no[t]) for o, w, t in step(s, x)] for s in states for x in letters}
    return Transducer({k: v for k, v in arcs.items() if v}, frozenset(no[s] for s in finals))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """``b`` reads what ``a`` writes: states are pairs, weights multiply. Only states that can be reached are made."""
    by_state: dict[int, list] = {}
    for (s, x), out in a.arcs.items():
        by_state.setdefault(s, []).append((x, out))
    no, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
    for p, q in todo:
        for x, out in by_state.get(p, ()):
            got = []
            for y, w, p2 in out:
                for z, v, q2 in b.arcs.get((q, y), ()):
                    if (p2, q2) not in no:
                        no[p2, q2] = len(no)
                        todo.append((p2, q2))
                    got.append((z, w * v, no[p2, q2]))
            if got:
                arcs[no[p, q], x] = got
    return Transducer(arcs, frozenset(i for (p, q), i in no.items() if p in a.final and q in b.final))


def negations(reach: int, weight: float) -> Transducer:
    """Marks insults and threats up to ``reach`` tokens after a negation."""

    def step(left, x):
        if x == NO:
            return [(x, 1.0, reach)]
        return [(x + "~", weight, left - 1) if left and x in _MARKED else (x, 1.0, max(left - 1, 0))]

    return build(list(range(reach + 1)), list(range(reach + 1)), step)


def reports(weight: float) -> Transducer:
    """Marks what follows a report verb in its clause."""
    return build([0, 1], [0, 1], lambda told, x: [(x + '"', weight, 1) if told and x[0] in _MARKED else (x, 1.0, int(told or x == SAID))])


def threats(weight: float, after: int = 2, before: int = 3) -> Transducer:
    """A verb is a threat if a target follows within ``after`` tokens or a clitic came within ``before``;
    otherwise it is like any other word. Which of these holds is guessed and must come true for a path to end."""
    idle = ("idle", 0)
    near, wait = [("near", k) for k in range(before, 0, -1)], [("wait", k) for k in range(after, 0, -1)]

    def step(state, x):
        name, k = state
        hit = x in (AT, BEFORE)
        if name == "wait":
            if hit:
                return [(x, 1.0, near[0] if x == BEFORE else idle)]
            return [(*((OTHER, 0.0) if x[0] == VERB else (x, 1.0)), ("wait", k - 1))] if k > 1 else []
        later = ("near", k - 1) if k > 1 else idle
        if x == BEFORE:
            return [(x, 1.0, near[0])]
        if x[0] != VERB:
            return [(x, 1.0, later)]
        return [(OTHER, 0.0, later), (x, weight, wait[0]), *([(x, weight, idle)] if name == "near" else [])]

    return build([idle, *near, *wait], [idle, *near], step)


def aims(reach: int, weight: float, after: int = 2) -> Transducer:
    """Marks insults within ``reach`` tokens after a target, or with one following within ``after`` (guessed, as above)."""
    idle = ("idle", 0)
    near, wait = [("near", k) for k in range(reach, 0, -1)], [("wait", k) for k in range(after, 0, -1)]

    def step(state, x):
        name, k = state
        if x in (AT, BEFORE):
            return [(x, 1.0, near[0])]
        aimed = (x + "@", weight)
        if name == "wait":
            return [(*(aimed if x[0] == INSULT else (x, 1.0)), ("wait", k - 1))] if k > 1 else []
        later = (name, k - 1) if k > 1 else idle
        if x[0] != INSULT:
            return [(x, 1.0, later)]
        return [(*aimed, later)] if name == "near" else [(x, 1.0, idle), (*aimed, wait[0])]

    return build([idle, *near, *wait], [idle, *near], step)


def grammar(p: Params) -> Transducer:
    """Negation, reported speech, threat and target transducers as one; the lexicon feeds it."""
    marked = compose(negations(p.reach, p.negated), reports(p.reported))
    return compose(compose(marked, threats(p.threat)), aims(p.reach, p.aimed))


@dataclass
class Grammar:
    """Insult transducer (words and stems with weights), the composed patterns and a calibration."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    params: Params = Params()
    slope: float = 1.0
    offset: float = -3.0

    def __post_init__(self):
        self.patterns = grammar(self.params)
        self.memo: dict[str, list[tuple[str, float]]] = {}

    def __reduce__(self):
        return Grammar, (self.words, self.stems, self.params, self.slope, self.offset)

    def insult(self, word: str) -> float:
        """The lexicon transducer: a word's weight, its longest stem's, or 0."""
        got = self.words.get(word, 0.0)
        if not got:
            for k in reversed(PREFIX):
                if len(word) >= k and word[:k] in self.stems:
                    return self.stems[word[:k]]
        return got

    def readings(self, word: str) -> list[tuple[str, float]]:
        """All that a word may be read as, with its lexical weight (1 for a threat verb, 0 for what scores nothing)."""
        got = self.memo.get(word)
        if got is None:
            w = self.insult(word)
            kinds = ((TARGET, AT), (CLITIC, BEFORE), (NEGATION, NO), (REPORT, SAID))
            got = ([(INSULT, w)] if w else []) + ([(VERB, 1.0)] if word in THREAT else []) + [(x, 0.0) for words, x in kinds if word in words] or [(OTHER, 0.0)]
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[word] = got
        return got

    def clause(self, tokens: list[str]) -> float:
        """The score of the best path through one clause."""
        got = self.patterns.best([self.readings(t) for t in tokens])
        return got[0] if got else 0.0

    def _clauses(self, text: str | None) -> Iterator[list[list[tuple[str, float]]]]:
        """The readings of each clause that holds an insult or a threat verb."""
        if not text:
            return
        low, readings = text.lower(), self.readings
        if not any(readings(w)[0][1] for w in set(_WORD.findall(low))):
            return
        held: list = []
        some = False
        for t in _TOKEN.findall(low):
            if t[0].isalpha():
                r = readings(t)
                some = some or r[0][1] > 0
                held.append(r)
            elif held:
                if some:
                    yield held
                held, some = [], False
        if some:
            yield held

    def text(self, text: str | None) -> float:
        """The sum over clauses of their best paths' scores; 0 for null and empty texts."""
        return sum((got[0] for c in self._clauses(text) if (got := self.patterns.best(c))), 0.0)

    def written(self, text: str | None) -> dict[str, float]:
        """The lexical weight that the best paths write, by letter and marks."""
        sums: dict[str, float] = {}
        for c in self._clauses(text):
            for out, w in (self.patterns.best(c) or (0, []))[1]:
                sums[out] = sums.get(out, 0.0) + w
        return sums

    def probability(self, raw: float) -> float:
        z = self.slope * math.log1p(raw) + self.offset
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def held_out(doc_id: Column, k: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == k, F.lit(False))


def _counter(known: frozenset[str] | None):
    """Rows that hold each word; with ``known`` words, each stem of other words. The term '' counts the rows."""

    def terms(text: str | None) -> set[str]:
        words = set(_WORD.findall((text or "").lower()))
        return words if known is None else {w[:k] for w in words - known for k in PREFIX if len(w) > k}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for toxic in (0, 1):
                n: Counter[str] = Counter()
                for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if y == toxic:
                        n.update(terms(text))
                        n[""] += 1
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array([toxic] * len(n), pa.int32()), pa.array(list(n.values()), pa.int64())], ["term", "toxic", "n"])

    return run


def _telling(rows: DataFrame, p: Params, known: frozenset[str] | None = None) -> list[tuple[str, float, float]]:
    """(term, weight, certainty) of the words, or stems of other words, that toxic rows hold more often than
    chance over all terms tried allows (Chernoff bound, Bonferroni); at most what ``max_rows`` rows hold."""
    counts = rows.mapInArrow(_counter(known), "term string, toxic int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c")
    )
    counts = counts.persist()
    try:
        total, tried = counts.where("term = ''").first(), counts.count()
        if not total or not total["t"] or not total["c"]:
            return []
        nt, nc = total["t"], total["c"]
        weight = F.log((F.col("t") + 0.5) / (nt + 1)) - F.log((F.col("c") + 0.5) / (nc + 1))
        n, q, pi = F.col("t") + F.col("c"), F.col("t") / (F.col("t") + F.col("c")), nt / (nt + nc)
        kl = n * (q * F.log(q / pi) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - pi))).otherwise(0.0))
        got = counts.where((F.col("t") >= p.least_docs) & (q > pi) & (F.col("term") != "")).select("term", weight.alias("w"), kl.alias("kl"))
        got = got.where((F.col("kl") >= math.log(tried / p.chance)) & (F.col("w") >= p.least_weight)).collect()
    finally:
        counts.unpersist()
    return sorted(((r["term"], float(r["w"]), float(r["kl"])) for r in got), key=lambda r: (-r[2], -len(r[0]), r[0]))


_SKETCH = ("_k1", "_k2", "_k3")


def _sketcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = []
        for t in b.column(0).to_pylist():
            w = (t or "").lower().split()
            grams = [" ".join(w[i : i + 3]).encode() for i in range(max(1, len(w) - 2))]
            keys.append([min(zlib.crc32(g, seed) for g in grams) for seed in range(len(_SKETCH))])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([k[i] for k in keys], pa.int64()) for i in range(len(_SKETCH)))], ["text", "toxic", *_SKETCH])


def _thinned(rows: DataFrame) -> DataFrame:
    """Near copies of a text would make all its words look toxic: of rows of one label that share a least 3-word
    hash, as texts do with a chance of their similarity, one is learnt from (the one with the least hash of
    its text, whatever the partitions)."""
    keyed = rows.mapInArrow(_sketcher, "text string, toxic int, " + ", ".join(f"{k} long" for k in _SKETCH))
    keyed = keyed.select("toxic", F.struct(F.xxhash64("text").alias("h"), "text", *_SKETCH).alias("r"))
    for k in _SKETCH:
        keyed = keyed.groupBy("toxic", F.col(f"r.{k}").alias("_k")).agg(F.min("r").alias("r")).select("toxic", "r")
    return keyed.select("r.text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Grammar:
    """Learn the insult transducer, the patterns' arc weights and the calibration from labelled rows outside
    the held-out fold.

    Labels that are null are ignored, repeated ones count as toxic if any is. At most ``max_rows`` rows
    are used, chosen by a hash; all terms of these rows that pass the test make the lexicon. The fit doesn't
    depend on how rows are dealt out. Without labels of both kinds the grammar knows no insults.
    """
    p = params
    y = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    y = y.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").select("text", "toxic")  # at most max_rows ids
    rows = _thinned(rows).persist()
    g = Grammar(params=p)
    g.words = {term: w for term, w, _ in _telling(rows, p)}
    if not g.words:
        rows.unpersist()
        return g
    for term, w, _ in _telling(rows, p, frozenset(g.words)):  # the surest first; neither what it begins nor what begins it adds any
        if not any(term.startswith(s) or s.startswith(term) for s in g.stems):
            g.stems[term] = w
    marks = rows.mapInArrow(_writer(g), "toxic int, marks map<string,double>").collect()  # at most max_rows small maps
    rows.unpersist()
    return _weigh(g, [(r["marks"], r["toxic"]) for r in marks])


def _writer(g: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [list(g.written(t).items()) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("toxic")), pa.array(got, pa.map_(pa.string(), pa.float64()))], ["toxic", "marks"])

    return run


def _weigh(g: Grammar, rows: list[tuple[dict[str, float], int]]) -> Grammar:
    """Arc weights and calibration by likelihood: one weight after the other is moved along ``steps`` from
    where it starts, each step away costing as much as one row's certainty, until none gains."""
    p = g.params
    marks = sorted({m for r, _ in rows for m in r})
    x = np.array([[r.get(m, 0.0) for m in marks] for r, _ in rows]).reshape(len(rows), len(marks))
    y = np.array([t for _, t in rows], float)

    def fitted(q: Params) -> tuple[float, float, float]:
        w = np.array([(q.negated if "~" in m else 1.0) * (q.reported if '"' in m else 1.0) * (q.aimed if "@" in m else 1.0) * (q.threat if m[0] == VERB else 1.0) for m in marks])
        slope, offset, likelihood = _calibrate(np.log1p(x @ w), y)
        moved = sum(abs(math.log(getattr(q, k) / getattr(p, k))) for k in names)
        return likelihood - moved, slope, offset

    names = ("negated", "reported", "aimed", "threat")
    best, value = p, fitted(p)
    for _ in range(2):
        for k in names:
            for f in p.steps:
                q = replace(best, **{k: getattr(p, k) * f})
                got = fitted(q)
                if got[0] > value[0] + 1e-9:
                    best, value = q, got
    return Grammar(g.words, g.stems, best, value[1], value[2])


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, offset and log likelihood of a logistic regression of y on x, by Newton steps with a small ridge."""
    # equal values are summed first
    keys, of = np.unique(np.round(x, 3), return_inverse=True)
    n, t = np.bincount(of, minlength=len(keys)), np.bincount(of, y, minlength=len(keys))
    a, b = 1.0, -2.0
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(a * keys + b, -30, 30)))
        e, w = t - n * q, n * q * (1 - q)
        ga, gb = (e * keys).sum() - 0.02 * a, e.sum()
        haa, hab, hbb = (w * keys * keys).sum() + 0.02, (w * keys).sum(), w.sum() + 1e-6
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(abs(da), abs(db), 1.0)
        a, b = a + 2 * da / (1 + size), b + 2 * db / (1 + size)
    q = np.clip(1 / (1 + np.exp(-np.clip(a * keys + b, -30, 30))), 1e-12, 1 - 1e-12)
    return float(a), float(b), float((t * np.log(q) + (n - t) * np.log(1 - q)).sum())


def _scorer(g: Grammar, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [g.text(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(k)) for k in keys] + [pa.array(raw, pa.float64())], [*keys, "raw"])

    return run


def score(docs: DataFrame, g: Grammar) -> DataFrame:
    """(doc_id, raw, score, predicted) for every row, whole texts, no shuffle; only the text is scored."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = docs.select("doc_id", "text").mapInArrow(_scorer(g, ["doc_id"]), f"doc_id {kind}, raw double")
    z = F.least(F.greatest(F.lit(g.slope) * F.log1p("raw") + F.lit(g.offset), F.lit(-40.0)), F.lit(40.0))
    got = got.withColumn("score", 1 / (1 + F.exp(-z)))
    return got.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def remove_toxic(docs: DataFrame, g: Grammar) -> DataFrame:
    """``docs`` without the rows predicted toxic, each judged by its own text; no shuffle.

    Rows without an id and rows that repeat one are judged like all others; null and empty texts stay.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [g.probability(g.text(t)) < 0.5 for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark, sf_dir):
    """Scores all documents; null texts score as empty ones, repeated rows are scored each; an empty table gives none."""
    docs = table(spark, sf_dir, "documents")
    g = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, g).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
