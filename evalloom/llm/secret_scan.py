"""Secret scanning: base patterns and sliding-window entropy of candidate strings."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import table

# The base patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "entropy")

#: A candidate: unbroken characters of the widest class.
LEAST = 16
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: Strings that look random but are not secret: UUIDs, dates and times, runs of one character, rulers and numbers,
#: paths and names of lower-case words, words in one case and CamelCase names of words of 3 letters or more.
ALLOW = re.compile(
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|\d{4}-\d\d-\d\d(?:T[\d-]*)?|(.)\1*|[0-9_=+/-]+|(?:/?[a-z]+(?:[-_/][a-z]+)*/?)|[A-Z]+(?:[-_][A-Z]+)*|[a-z]*(?:[A-Z][a-z]{2,})+"
)
#: Per character class: its runs of ``LEAST`` or more, window length and least bits a character in a full window;
#: a run shorter than the window is held to the same share of the most that its length allows.
CLASSES = (
    ("hex", re.compile(rf"[0-9a-f]{{{LEAST},}}|[0-9A-F]{{{LEAST},}}"), 20, 2.9),
    ("alnum", re.compile(rf"[A-Za-z0-9]{{{LEAST},}}"), 20, 3.5),
    ("base64", re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"), 24, 3.9),
)


def window_entropy(s: str, width: int) -> float:
    """The largest Shannon entropy (bits a character) of any window of ``width`` characters.

    A window's entropy is log2(w) - (sum of c log2 c) / w; moving it by one changes two counts.
    """
    w = min(width, len(s))
    if not w:
        return 0.0
    xlog = [0.0] + [c * math.log2(c) for c in range(1, w + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    best = math.inf
    for i, ch in enumerate(s):
        if i >= w:
            out = s[i - w]
            c = counts[out]
            total += xlog[c - 1] - xlog[c]
            counts[out] = c - 1
        c = counts.get(ch, 0)
        total += xlog[c + 1] - xlog[c]
        counts[ch] = c + 1
        if i >= w - 1 and total < best:
            best = total
    return math.log2(w) - best / w


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Spans of candidates' runs of a character class whose best window has enough entropy for the class.

    Classes go from the narrowest: a run is looked at only outside what a narrower class has found. A
    candidate or a run that ``ALLOW`` fits is suppressed whole, whatever its entropy.
    """
    out: list[tuple[int, int]] = []
    for m in _CANDIDATE.finditer(text):
        s, at = m[0], m.start()
        if ALLOW.fullmatch(s):
            continue
        found: list[tuple[int, int]] = []
        for _, runs, width, bits in CLASSES:
            for r in runs.finditer(s):
                if any(a < r.end() and r.start() < b for a, b in found) or ALLOW.fullmatch(r[0]):
                    continue
                w = min(width, len(r[0]))
                if window_entropy(r[0], w) * math.log2(width) >= bits * math.log2(w):
                    found.append(r.span())
        out += [(at + a, at + b) for a, b in sorted(found)]
    return out


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind; base spans always stay."""
    if not text:
        return []
    out = []
    low = text.lower()
    if "password" in low or "passwd" in low or "secret" in low or "token" in low or "api" in low:
        out += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    # a run of 16 or more is a maximal run, so the longer pattern gives the same matches
    out += [(2, *m.span()) for m in LONG_HEX.finditer(text)]
    out += [(3, *span) for span in entropy_spans(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted((a, k, b) for k, a, b in out)]


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, spans) for every row: ``spans`` is an array of (kind, start, end, found).

    A map over Arrow batches: no shuffle, whole texts, nothing kept between rows. Null or empty text has
    no spans; repeated rows are scanned each; other columns are not read.
    """
    schema = docs.select(key).schema.simpleString()[7:-1] + ", spans array<struct<kind:string,start:int,end:int,found:string>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("found", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [[(k, s, e, t[s:e]) for k, s, e in scan(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[dict(zip(("kind", "start", "end", "found"), x)) for x in r] for r in got], kind)], [key, "spans"])

    return docs.select(key, text).mapInArrow(run, schema)


def op8_secrets(spark, sf_dir):
    """Counts and digests of all documents' spans; a null text counts as empty."""
    d = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return d.select("doc_id", count("assign"), count("access"), count("hex"), count("entropy"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
