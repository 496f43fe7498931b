"""The training-corpus pipeline: toxicity, line dedup, near-duplicates, decontamination, source mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``. What holds for every stage: an empty table
stays empty, and other columns than those of ``documents`` pass through with their values, whatever their names.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import decontaminate, lines, minhash, mixing, toxicity
from evalloom.llm.scratch import delete, delete_at_exit, shared_dir, table
from evalloom.session import bound_batches
from evalloom.session import ship as shipped


def ship(spark: SparkSession) -> SparkSession:
    """Workers get the package and batches of a bounded size."""
    return bound_batches(shipped(spark))


#: The columns of ``documents``.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
_REST = "other_columns"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _apart(stage: Stage) -> Stage:
    """Other columns travel as one struct, so that none of their names meets one that an operator uses."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        rest = [c for c in docs.columns if c.lower() not in DOCUMENT]
        if not rest:
            return stage(spark, docs, sf_dir)
        name = lambda c: F.col("`" + c.replace("`", "``") + "`")
        own = [c for c in docs.columns if c not in rest]
        out = stage(spark, docs.select(*own, F.struct(*[name(c) for c in rest]).alias(_REST)), sf_dir)
        made = [c for c in out.columns if c != _REST and c not in own]
        told = {c.lower() for c in made}
        back = [F.col(c) if c in own else F.col(_REST).getField(c).alias(c) for c in docs.columns if c in own or c.lower() not in told]
        return out.select(*back, *made)

    return run


@_apart
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar, fitted on the labels, doesn't call toxic. Rows without an id and rows
    that repeat one are judged by their own texts; null and empty texts stay; all columns are kept."""
    return toxicity.remove_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@_apart
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines seen earlier, equal ones of any length; a document that loses all it had goes. n_chars
    follows the text. Each row loses its own lines, those without an id come last; null and empty texts stay."""
    got = lines.dedup_lines(docs, min_exact=1, by_row=True)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kept = got.where(F.coalesce(~emptied, F.lit(True)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


@_apart
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8), whatever the rows' ids; null and
    empty texts stay."""
    return minhash.keep_one(docs).select(*docs.columns)


@_apart
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with less than a twentieth of their words in benchmark windows; each row is judged by its own text."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


@_apart
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy taken, in mixing order, with ``size, source_size, target, taken, copy`` (these names are
    replaced). Rows that repeat an id or have none are taken each; rows without words never are."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL can't express the first stage's fitted grammar.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; an empty table stays empty.

    What a stage wrote goes once the next one is written, the last one's when the driver's Python ends."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    delete_at_exit(spark, base)
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            delete(spark, f"{base}/{before}")
        before = name
    return docs
