"""Programs that make datasets and requests of source rows: import, and prepare."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keys import case_id
from .operators import evaluate, families, quality
from .operators.digests import sequence_digest
from .operators.quality import DataQualityError, require
from .sources import readers, sinks

#: Families of a study and of its pilot (true, false), those of a request, variants asked for, and fields that
#: no request may hold.
STUDY, PILOT, REQUEST, VARIANTS = 50, (3, 2), 5, quality.VARIANTS
FORBIDDEN = frozenset(("model_is_robust", "historic_label", "model_id", "answer", "solution", "permutation_type"))


def canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def source_rows(spark: SparkSession, source: str) -> DataFrame:
    """(_pos, model_id, dataset_id, problem_id, original_problem, model_is_robust, permutation_type) of a file's rows, each checked.

    Ids and texts must be non-empty strings and labels booleans. ``permutation_type`` is a list of strings, or null if it isn't
    one: a list, JSON of a list, or a plain string as its only element.
    """
    r = readers.study_records(spark, source, keep=("model_id", "dataset_id", "problem_id", "original_problem", "model_is_robust", "permutation_type"))
    texts = ("model_id", "dataset_id", "problem_id", "original_problem")
    kinds = F.expr("schema_of_variant(try_variant_get(v, '$.permutation_type', 'variant'))")
    listed = F.expr("try_variant_get(v, '$.permutation_type', 'array<variant>')")
    items = F.when(F.size(listed) == F.size(F.filter(listed, lambda x: (F.schema_of_variant(x) == "STRING") & (F.try_variant_get(x, "$", "string") != ""))), F.transform(listed, lambda x: F.try_variant_get(x, "$", "string")))
    plain = readers.string_list(F.expr("try_variant_get(v, '$.permutation_type', 'string')"))
    permutation = F.when(F.startswith(kinds, F.lit("ARRAY")) & (F.size(listed) > 0), items).when(kinds == "STRING", plain)
    got = r.select("_pos", *[readers.exact("v", c, "STRING").alias(c) for c in texts], readers.exact("v", "model_is_robust", "BOOLEAN").alias("model_is_robust"), permutation.alias("permutation_type"))
    for c in texts:
        require(got.where(F.coalesce(F.col(c) == "", F.lit(True))).select("_pos"), f"rows with invalid {c}")
    require(got.where(F.col("model_is_robust").isNull()).select("_pos"), "rows with invalid model_is_robust")
    return got


def cases_of(rows: DataFrame) -> DataFrame:
    """(_order, id, model_id, dataset_id, problem_id, permutation_type, original_problem, model_is_robust): one case a key, in the keys' order;
    a key with two texts or labels, and rows without a list of permutations, are errors."""
    key = ["model_id", "dataset_id", "problem_id", "permutation_type"]
    wrong = F.col("permutation_type").isNull() | (F.size("permutation_type") == 0) | F.exists("permutation_type", lambda p: p.isNull() | (p == ""))
    require(rows.where(F.coalesce(wrong, F.lit(True))).select("_pos"), "rows with invalid permutation_type")
    require(quality.conflicts(rows, key, ["original_problem"]), "keys with two problem statements")
    require(quality.conflicts(rows, key, ["model_is_robust"]), "keys with two labels")
    one = families.keep_first(rows.select(*key, "original_problem", "model_is_robust", "_pos"), key, "_pos").drop("_pos")
    cases = one.withColumn("id", case_id(*[F.col(c) for c in key]))
    require(quality.duplicates(cases, "id"), "two keys of one id")
    return evaluate.numbered_in_order(cases, *key, out="_order")


def import_rows(spark: SparkSession, source: str, output: str, flat: bool = False, **told: str) -> dict:
    """Source rows as a dataset: ``input/cases.jsonl`` and ``reference/labels.jsonl`` in the keys' order, and ``metadata.json``.

    A case's problem is an object of text and permutations, or the text alone if ``flat``, which is what ``ingest`` reads.
    ``told`` (dataset, revision, config, split) goes into the metadata as it is.
    """
    rows = source_rows(spark, source)
    cases = cases_of(rows).persist()
    try:
        n, kept, true = rows.count(), cases.count(), cases.where("model_is_robust").count()
        if not kept:
            raise DataQualityError("no source rows")
        problem: Column = F.col("original_problem") if flat else F.struct("original_problem", "permutation_type")
        sinks.write_json_lines(cases.select("_order", "id", "model_id", problem.alias("problem")), f"{output}/input/cases.jsonl", "_order", "overwrite")
        sinks.write_json_lines(cases.select("_order", "id", F.col("model_is_robust").alias("is_robust")), f"{output}/reference/labels.jsonl", "_order", "overwrite")
        made = {"schema_version": 1, "source": source, **told, "source_rows": n, "cases": kept, "duplicate_rows_removed": n - kept, "label_counts": {"false": kept - true, "true": true}}
        sinks.write_json(f"{output}/metadata.json", made)
        return made
    finally:
        cases.unpersist()


def study_families(rows: DataFrame, study: int = STUDY) -> DataFrame:
    """(place, family_id, dataset_id, problem_id, original_problem, historic_label, source_rows, model_id): half a study of either
    label, by hash, the pilot's first; both parts are in the order of their hashes."""
    found = families.families(rows)
    chosen = families.pilot_first(families.stratified(found, "family_id", "historic_label", study // 2, strict=True), "historic_label", *PILOT)
    order = F.struct(~F.col("pilot"), families.hash_order(F.col("family_id")))
    return families.batches(chosen, order, 1).withColumnRenamed("batch", "place").drop("rank", "pilot")


def prepare(spark: SparkSession, source: str, output: str, study: int = STUDY, **told: str) -> dict:
    """Requests for variants of a study's families, which tell neither labels nor models.

    Written: all families' texts in the order of their ids' hashes as lines (``source/all_original_tasks.jsonl``), the study as one
    request and in requests of five, the first of which is the pilot (``requests``), what each family is (``.source-mapping.jsonl``),
    and ``.source-metadata.json`` with counts and digests. Rows of several models, and families with two texts or
    labels, are errors.
    """
    rows = source_rows(spark, source).persist()
    try:
        models = rows.select("model_id").distinct().limit(2).collect()
        if len(models) != 1:
            raise DataQualityError("rows must be of one model")
        key = ["dataset_id", "problem_id"]
        require(quality.conflicts(rows, key, ["original_problem"]), "families with two texts")
        require(quality.conflicts(rows, key, ["model_is_robust"]), "families with two labels")
        found = families.families(rows).withColumn("_o", families.hash_order(F.col("family_id")))
        chosen = study_families(rows, study).orderBy("place").collect()  # a study's
        tasks = [{"family_id": r["family_id"], "original_problem": r["original_problem"]} for r in chosen]
        whole = found.select(F.struct("_o", "family_id").alias("_order"), "family_id", "original_problem")
        if quality.forbidden_fields(whole.schema, FORBIDDEN) or FORBIDDEN & {k for t in tasks for k in t}:
            raise DataQualityError("a request holds a field that it may not")
        sinks.write_json_lines(whole, f"{output}/source/all_original_tasks.jsonl", "_order", "overwrite")
        requests = {f"study{study}": tasks, **{f"batches/batch-{i // REQUEST + 1:02d}": tasks[i : i + REQUEST] for i in range(0, len(tasks), REQUEST)}}
        for name, part in requests.items():
            sinks.write_json(f"{output}/requests/{name}.json", {"tasks": part})
        mapping = found.select(F.struct("_o", "family_id").alias("_order"), "family_id", "dataset_id", "problem_id", "historic_label", "source_rows", "model_id")
        sinks.write_json_lines(mapping, f"{output}/.source-mapping.jsonl", "_order", "overwrite")
        count = lambda df, c: {str(r[0]).lower(): r[1] for r in df.groupBy(c).count().collect()}  # noqa: E731 two rows
        digest = sequence_digest(rows, ["_pos"], ["model_id", "dataset_id", "problem_id", "original_problem", "model_is_robust"]).first()
        made = {
            "schema_version": 1, **told, "source_rows": rows.count(), "families": found.count(), "source_digest": [digest["digest_1"], digest["digest_2"]],
            "study_families": len(tasks), "pilot_families": sum(PILOT), "variants_per_family_requested": VARIANTS, "study_variants_requested": len(tasks) * VARIANTS,
            "source_row_historic_label_counts": count(rows, "model_is_robust"), "family_historic_label_counts": count(found, "historic_label"),
            "study_historic_label_counts": {str(y).lower(): sum(r["historic_label"] is y for r in chosen) for y in (False, True)},
            "input_sha256": {name.rpartition("/")[2].replace("-", "_"): hashlib.sha256(canonical({"tasks": part}).encode()).hexdigest() for name, part in requests.items()},
        }
        sinks.write_json(f"{output}/.source-metadata.json", made)
        return made
    finally:
        rows.unpersist()

