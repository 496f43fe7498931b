"""Programs that train: a regressor of feature rows, and the export of a run's head as a submission."""

from __future__ import annotations

import hashlib
import io
import json
import platform
import zipfile
from pathlib import Path

import numpy
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import heads
from .functions.tokens import METRICS
from .operators import artifacts, quality, selection
from .operators.quality import DataQualityError, require
from .sources import files, readers, sinks

#: A feature row's columns beside the metrics.
TARGET, LABEL, GROUP = "absolute_accuracy_decay", "model_is_robust", "original_problem"
CONSTANT = ("feature_model_id", "generation_config_json", "source_dataset", "source_revision")


def check_features(rows: DataFrame, folds: int) -> DataFrame:
    """The rows with numbers as doubles, if a grouped cross-validation can be made of them; else what is wrong."""
    quality.require_columns(rows, *METRICS, TARGET, LABEL, GROUP, *CONSTANT, "model_id")
    if rows.schema[LABEL].dataType.simpleString() != "boolean":
        raise DataQualityError(f"{LABEL} must hold booleans")
    if folds < 2:
        raise DataQualityError("folds are 2 at least")
    fine = F.coalesce(quality.in_unit(F.col(TARGET)), F.lit(False))
    for what, bad in {f"{LABEL} without value": F.col(LABEL).isNull(), f"{GROUP} without value": F.col(GROUP).isNull(), f"{TARGET} that isn't a finite number of [0, 1]": ~fine}.items():
        require(rows.where(bad).select(GROUP).limit(3), f"rows with {what}")
    require(quality.conflicts(rows, [GROUP], [LABEL]), "groups with two labels")
    quality.require_classes(rows, GROUP, LABEL, folds)
    several = [c for c in CONSTANT if not quality.single_value(rows, c)]
    if several:
        raise DataQualityError(f"several values of {several}")
    if rows.limit(folds).count() < folds:
        raise DataQualityError("fewer rows than folds")
    return rows.withColumns({c: F.col(c).cast("double") for c in (*METRICS, TARGET)})


def fit(spark: SparkSession, source: str, root: str, results: str, folds: int = 5, seed: int = 42, grid: list[selection.Candidate] | None = None) -> dict:
    """The best of a grid of regressors over completed feature shards, refitted on all rows and exported to ``root``; ``results``
    gets every candidate's metrics and where the artifact comes from."""
    rows = check_features(readers.parquet_shards(spark, source), folds)
    first = rows.select(*CONSTANT).first()
    config = artifacts.GenerationConfig.of(json.loads(first["generation_config_json"]))
    grid = grid or selection.grid(("boosted", "extra", "forest"))
    best, model, tried, baseline = selection.select_model(rows, list(METRICS), GROUP, LABEL, TARGET, grid, folds, seed)
    one = next(r for r in tried if r["identifier"] == best.identifier)
    n, groups = rows.agg(F.count(F.lit(1)), F.count_distinct(GROUP)).first()
    told = {
        "selected_params": {"family": best.family, "trees": best.trees, "depth": best.depth, "identifier": best.identifier},
        "cv_results": {"selection_metric": "balanced_accuracy", "tie_breakers": ["accuracy", "mae", "identifier"], "best": one, "mean_baseline": baseline, "candidates": tried},
        "training_provenance": {**{c: first[c] for c in CONSTANT if c != "generation_config_json"}, "source_model_ids": sorted(str(r[0]) for r in rows.select("model_id").distinct().collect()), "target_column": TARGET, "label_column": LABEL, "group_column": GROUP, "row_count": n, "group_count": groups, "n_splits": folds, "seed": seed},
        "library_versions": {"python": platform.python_version(), "numpy": numpy.__version__, "pyspark": pyspark.__version__},
    }
    manifest = artifacts.payload(first["feature_model_id"], config, {"kind": "spark"}, one["decision_threshold"], **told)
    artifacts.export(spark, root, manifest, model, rows.limit(50))
    place = artifacts.candidates(root, first["feature_model_id"])[0]
    held = files.walk(spark, place)
    made = {"artifact_path": place, "artifact_size_bytes": sum(n for _, n in held), "artifact_sha256": {p: hashlib.sha256(files.read_bytes(spark, f"{place}/{p}")).hexdigest() for p, _ in held if not p.rpartition("/")[2].startswith((".", "_"))}, "decision_threshold": one["decision_threshold"], **told}
    sinks.write_json(results, made)
    return made


ENTRY = '''"""A trained head over the features that this folder's extractor makes of the problems."""

import json
from pathlib import Path

import extractor
import head

RECORD = json.loads((Path(__file__).parent / "head.json").read_text(encoding="utf-8"))
MODEL = json.loads((Path(__file__).parent / "run.json").read_text(encoding="utf-8"))["settings"]["model"]


def are_robust(model_id, problems):
    if head.canonical(model_id) != head.canonical(MODEL):
        raise ValueError("this head belongs to another model")
    return head.decisions(RECORD, extractor.features(problems)) if problems else []
'''


def export_run(spark: SparkSession, root: str, name: str, extractor: str, output: str) -> list[str]:
    """A completed run's head as an archive that is a submission: solution.py, the head, its functions, the run's record and
    ``extractor`` (the source of a module with ``features(problems)``, a list of vectors). The names in it.

    The run must have recorded its head's digest as the artifact ``head.json``, which must still be right, and the model in
    its settings. The archive is new and appears whole.
    """
    record = json.loads(files.read_text(spark, f"{root}/{name}/result.json"))
    if record["status"] != "completed":
        raise DataQualityError(f"the run has {record['status']}, not completed")
    kept = files.read_bytes(spark, f"{root}/{name}/head.json")
    if record.get("artifacts", {}).get("head.json") != hashlib.sha256(kept).hexdigest():
        raise DataQualityError("the run's head isn't the one that it recorded")
    if not isinstance(record["settings"].get("model"), str):
        raise DataQualityError("the run's settings name no model")
    compile(extractor, "extractor.py", "exec")
    parts = {"solution.py": ENTRY.encode(), "head.json": kept, "head.py": Path(heads.__file__).read_bytes(), "extractor.py": extractor.encode(), "run.json": json.dumps(record, sort_keys=True).encode()}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, data in sorted(parts.items()):
            z.writestr(zipfile.ZipInfo(n), data)
    files.write_bytes(spark, output, out.getvalue(), overwrite=False)
    return sorted(parts)
