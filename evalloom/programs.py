"""Whole programs over folders: predict a dataset's cases, score predictions, split a study, check a response."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluate, families, inference, quality, study
from .preparation import import_rows, prepare
from .session import local_session, ship, work_dir
from .sources import files, readers, sinks
from .training import export_run, fit


def _called_once(cases: DataFrame, predict) -> DataFrame:
    """``run_batches`` written once: putting rows in ranges reads them twice, and a submission is called once a model."""
    made, path = evaluate.run_batches(cases, predict), work_dir(cases.sparkSession, "called")
    made.write.parquet(path)
    return cases.sparkSession.read.schema(made.schema).parquet(path)


def ingest(spark: SparkSession, source: str, output: str, submission: str) -> dict:
    """``cases.jsonl`` of ``source`` through the submission's function: ``predictions.jsonl`` and ``ingestion_summary.json``."""
    cases = readers.load_cases(spark, f"{source}/cases.jsonl")
    made = _called_once(cases, inference.participant(spark, submission))
    sinks.write_json_lines(made, f"{output}/predictions.jsonl", "_pos")
    done = readers.load_predictions(spark, f"{output}/predictions.jsonl")[0]  # the function isn't called again
    return sinks.write_record(evaluate.ingestion_summary(done), f"{output}/ingestion_summary.json")


def score(spark: SparkSession, source: str, output: str) -> dict:
    """``scores.json`` of ``labels.jsonl`` and ``predictions.jsonl``, in ``ref`` and ``res`` of ``source`` if there are such."""
    at = {k: f"{source}/{k}" if files.exists(spark, f"{source}/{k}") else source for k in ("ref", "res")}
    got, malformed = readers.load_predictions(spark, f"{at['res']}/predictions.jsonl")
    one = evaluate.score(readers.load_labels(spark, f"{at['ref']}/labels.jsonl"), got, malformed)
    return sinks.write_record(one.select("accuracy", "coverage", "invalid_predictions"), f"{output}/scores.json")


def split(spark: SparkSession, source: str, output: str, fraction: float, seed: int, model: str | None = None, mixed: bool = False) -> None:
    """A study's rows as disjoint ``train`` and ``validation`` families, with both classes to train on. If ``mixed``, texts may have two labels."""
    if not 0 < fraction < 1:
        raise quality.DataQualityError("the fraction must lie between 0 and 1")
    rows = readers.read_study(spark, source, model, mixed)
    sides = families.group_split(rows, "family_id", fraction, seed)
    if sides.count() < 2:
        raise quality.DataQualityError("a split needs two families")
    both = rows.join(sides, "family_id")
    study.check_split(both.where("split = 'train'"), both.where("split = 'validation'"))
    sinks.write_split(rows, sides, "family_id", output, seed=seed, validation_fraction=fraction)


def respond(spark: SparkSession, request: str, response: str) -> list[dict]:
    """The rules that a response to a request breaks."""
    tasks = lambda path, kind: spark.read.option("multiLine", True).schema(f"tasks array<struct<{kind}>>").json(path).select(F.explode("tasks").alias("t")).select("t.*")
    asked = tasks(request, "family_id string, original_problem string")
    said = tasks(response, "family_id string, variants array<struct<variant_id string, problem string>>")
    variants = said.select("family_id", F.explode_outer("variants").alias("v")).select("family_id", "v.*")
    return [r.asDict() for r in quality.check_response(variants, asked).where("violations > 0").collect()]


def judge(spark: SparkSession, cases: str, labels: str, submission: str, output: str) -> dict:
    """A submission over a file of cases against a file of labels: predictions, their summary and scores in ``output``."""
    made = _called_once(readers.load_cases(spark, cases), inference.participant(spark, submission))
    sinks.write_json_lines(made, f"{output}/predictions.jsonl", "_pos")
    done, malformed = readers.load_predictions(spark, f"{output}/predictions.jsonl")
    summary = sinks.write_record(evaluate.ingestion_summary(done), f"{output}/ingestion_summary.json")
    one = evaluate.score(readers.load_labels(spark, labels), done, malformed)
    return summary | sinks.write_record(one.select("accuracy", "coverage", "invalid_predictions"), f"{output}/scores.json")


def export(spark: SparkSession, root: str, name: str, extractor: str, output: str) -> list[str]:
    """``export_run`` with the extractor's source read from a file."""
    return export_run(spark, root, name, files.read_text(spark, extractor), output)


#: Each program's function, its places in order and its options.
PROGRAMS = {
    "ingest": (ingest, ("source", "output", "submission"), {}),
    "score": (score, ("source", "output"), {}),
    "judge": (judge, ("cases", "labels", "submission", "output"), {}),
    "split": (split, ("source", "output"), {"fraction": 0.2, "seed": 0, "model": None, "mixed": False}),
    "respond": (respond, ("request", "response"), {}),
    "import": (import_rows, ("source", "output"), {"flat": False, "dataset": "", "revision": "", "config": "default", "split": ""}),
    "prepare": (prepare, ("source", "output"), {"study": 50, "dataset": "", "revision": "", "config": "default", "split": ""}),
    "fit": (fit, ("source", "root", "results"), {"folds": 5, "seed": 42}),
    "export": (export, ("root", "name", "extractor", "output"), {}),
}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="evalloom", description=__doc__)
    sub = p.add_subparsers(dest="program", required=True)
    for name, (f, places, options) in PROGRAMS.items():
        a = sub.add_parser(name, help=(f.__doc__ or "").split(".")[0])
        for x in places:
            a.add_argument(x)
        for x, default in options.items():
            if default is False:
                a.add_argument(f"--{x}", action="store_true")
            else:
                a.add_argument(f"--{x}", type=type(default) if default is not None else str, default=default)
    a = vars(p.parse_args(argv))
    spark = ship(SparkSession.getActiveSession() or local_session())
    program = a.pop("program")
    got = PROGRAMS[program][0](spark, **a)
    print(json.dumps(got, sort_keys=True))
    return int(program == "respond" and bool(got))
