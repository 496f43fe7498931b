"""Probe artifacts: single probes as NPZ arrays, ensembles as JSON; looked up by model, read without unpickling."""

from __future__ import annotations

import io
import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import ALIASES
from ..sources import files
from .artifacts import safe_id
from .inference import probe_predictions
from .quality import DataQualityError

#: What an artifact must hold, and the one way of scoring that is known.
ENTRIES = ("model_id", "layer_index", "weights", "bias", "threshold")
VERSION, KIND, STRATEGY = 2, "all_folds_layers_seed_probe_ensemble", "best_layer_mean_margin"
FOLDER, ENSEMBLE, SINGLE = "probe_artifacts", "probe_artifact.json", "probe_artifact.npz"
SCHEMA = "model_id string, system_prompt string, best_layer int, layer string, probe string, weights array<double>, bias double, threshold double"


def places(root: str, model_id: str) -> list[str]:
    """Where a model's artifact may lie, the most specific first: by its name as ensemble or single probe, then generic ones."""
    own = safe_id(model_id)
    named = [f"{root}/{FOLDER}/{own}.{kind}" for kind in ("json", "npz")] if own else []
    return [*named, f"{root}/{ENSEMBLE}", f"{root}/{FOLDER}/{ENSEMBLE}", f"{root}/{SINGLE}"]


def of_arrays(data: bytes) -> list[tuple]:
    """The probe of an NPZ archive as a row; archives with pickled objects are refused."""
    try:
        with np.load(io.BytesIO(data), allow_pickle=False) as z:
            held = {name: z[name] for name in z.files}
    except Exception as e:  # no archive, or one with objects
        raise DataQualityError(f"no archive of plain arrays: {e}") from e
    missing = sorted({*ENTRIES} - {*held})
    if missing:
        raise DataQualityError(f"the archive lacks {missing}")
    one = lambda name, kind: kind(held[name].reshape(-1)[0]) if held[name].size == 1 else _wrong(name)
    weights = np.asarray(held["weights"], np.float32).reshape(-1)
    if not weights.size or not np.isfinite(weights).all():
        raise DataQualityError("weights must be finite numbers, one at least")
    layer = one("layer_index", int)
    prompt = one("system_prompt", str) if "system_prompt" in held else ""
    return [(one("model_id", str), prompt, layer, str(layer), "0", weights.astype(float).tolist(), one("bias", float), one("threshold", float))]


def _wrong(name: str):
    raise DataQualityError(f"{name} must be one value")


def of_ensemble(text: str) -> list[tuple]:
    """An ensemble's probes as rows: those of every group, layer and seed."""
    try:
        p = json.loads(text)
    except ValueError as e:
        raise DataQualityError(f"no JSON: {e}") from e
    if not isinstance(p, dict):
        raise DataQualityError("an ensemble must be an object")
    strategy = p.get("recommended_strategy") or {}
    rules = {
        "schema_version": type(p.get("schema_version")) is int and p["schema_version"] == VERSION, "artifact_type": p.get("artifact_type") == KIND, "groups": isinstance(p.get("groups"), list) and bool(p["groups"]),
        "best_layer_index": type(p.get("best_layer_index")) is int, "recommended_strategy": isinstance(strategy, dict) and (not strategy or strategy.get("name") == STRATEGY),
    }
    wrong = [k for k, fine in rules.items() if not fine]
    if wrong:
        raise DataQualityError(f"the ensemble has invalid {wrong}")
    best = int(strategy.get("layer_index", p["best_layer_index"]))
    out = []
    for g, group in enumerate(p["groups"]):
        for layer, probe in group.get("probes", {}).items():
            weights, bias, threshold = (np.asarray(probe[k], np.float32) for k in ("weights", "bias", "threshold"))
            weights = weights.reshape(1, -1) if weights.ndim == 1 else weights
            bias, threshold = bias.reshape(-1), threshold.reshape(-1)
            if weights.ndim != 2 or not len(weights) == bias.size == threshold.size:
                raise DataQualityError(f"group {g} has probes of several numbers for layer {layer}")
            for seed, w in enumerate(weights.astype(float).tolist()):
                out.append((str(p.get("model_id") or ""), str(p.get("system_prompt") or ""), best, str(layer), f"{g}.{seed}", w, float(bias[seed]), float(threshold[seed])))
    return out


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """The probes of artifact files (``SCHEMA``): files, folders or patterns. Each is read whole by the task that parses it."""
    import pandas as pd

    def run(frames):
        for f in frames:
            for name, content in zip(f["path"], f["content"]):
                rows = of_arrays(content) if name.endswith(".npz") else of_ensemble(content.decode("utf-8"))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def find(spark: SparkSession, root: str, model_id: str) -> DataFrame | None:
    """The probes of the first of ``places`` that has a file, or None; an alias stands for its model."""
    place = next((p for p in places(root, ALIASES.get(model_id, model_id)) if files.exists(spark, p)), None)
    return None if place is None else read_probes(spark, place)


def predictions(cases: DataFrame, root: str, encode: Callable[[DataFrame, int, str], DataFrame]) -> DataFrame:
    """(id, margin, is_robust) for ``cases(id, model_id, ...)``: each model's cases against its artifact's probes of the layer
    to be read, by their mean margin; False where a model has none. ``encode(cases, layer, system_prompt)`` gives
    (id, features). Models are listed on the driver, as they are few."""
    spark, out = cases.sparkSession, None
    for row in cases.select("model_id").distinct().orderBy("model_id").collect():
        mine = cases.where(F.col("model_id").eqNullSafe(row["model_id"]))
        found = find(spark, root, row["model_id"]) if row["model_id"] else None
        if found is None:
            got = probe_predictions(mine, None, 0, encode)
        else:
            first = found.select("best_layer", "system_prompt").first()
            if first is None:
                raise DataQualityError(f"the artifact of {row['model_id']} holds no probes")
            got = probe_predictions(mine, found, first["best_layer"], lambda c, layer, prompt=first["system_prompt"]: encode(c, layer, prompt))
        out = got if out is None else out.unionByName(got)
    return cases.select("id", F.lit(None).cast("double").alias("margin"), F.lit(False).alias("is_robust")).limit(0) if out is None else out
