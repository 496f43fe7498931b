"""Trained artifacts: validated manifests with an estimator, looked up, loaded and exported."""

from __future__ import annotations

import json
import math
import re
import uuid
from dataclasses import asdict, dataclass, field, fields
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import ALIASES
from ..functions.tokens import METRICS
from ..sources import files
from .quality import DataQualityError


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def _positive(x) -> bool:
    return type(x) is int and x >= 1


def _unit(x) -> bool:
    return _number(x) and 0 <= x <= 1


@dataclass(frozen=True)
class GenerationConfig:
    """How answers were generated and summarised. Each field's rule stands beside it."""

    max_prompt_length: int = field(default=2048, metadata={"rule": _positive})
    max_new_tokens: int = field(default=4096, metadata={"rule": _positive})
    batch_size: int = field(default=8, metadata={"rule": _positive})
    cache_implementation: str = field(default="static", metadata={"rule": lambda x: x == "static"})
    chat_template_role: str = field(default="user", metadata={"rule": lambda x: x == "user"})
    do_sample: bool = field(default=False, metadata={"rule": lambda x: x is False})
    min_k_fraction: float = field(default=0.20, metadata={"rule": lambda x: _unit(x) and x > 0})
    high_conf_threshold: float = field(default=0.90, metadata={"rule": _unit})
    low_conf_threshold: float = field(default=0.10, metadata={"rule": _unit})

    def __post_init__(self):
        wrong = [f.name for f in fields(self) if not f.metadata["rule"](getattr(self, f.name))]
        if wrong:
            raise ValueError(f"not allowed: { {k: getattr(self, k) for k in wrong} }")

    @classmethod
    def of(cls, values: dict) -> GenerationConfig:
        """From exactly the known keys."""
        known = {f.name for f in fields(cls)}
        if not isinstance(values, dict) or set(values) != known:
            raise ValueError(f"keys must be {sorted(known)}")
        return cls(**values)


class Predictor(Protocol):
    """What an estimator must do: add ``out`` to rows that hold its features."""

    def predict(self, rows: DataFrame, out: str = "score") -> DataFrame: ...


@dataclass(frozen=True)
class Linear:
    """A linear estimator as columns; what is missing counts as the feature's median."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float = 0.0
    medians: tuple[float, ...] | None = None

    def predict(self, rows: DataFrame, out: str = "score") -> DataFrame:
        terms = F.lit(float(self.bias))
        for i, (name, w) in enumerate(zip(self.features, self.weights)):
            x = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
            terms = terms + F.lit(float(w)) * (F.coalesce(x, F.lit(float(self.medians[i]))) if self.medians else F.col(name).cast("double"))
        return rows.withColumn(out, terms)


@dataclass(frozen=True)
class Fitted:
    """A fitted Spark pipeline."""

    model: object

    def predict(self, rows: DataFrame, out: str = "score") -> DataFrame:
        return self.model.transform(rows).withColumnRenamed("prediction", out)


SCHEMA, KIND = 1, "regressor"
_MAPPINGS = ("selected_params", "cv_results", "training_provenance", "library_versions")


@dataclass(frozen=True)
class Artifact:
    model_id: str
    config: GenerationConfig
    estimator: Predictor
    threshold: float
    payload: dict


def payload(model_id: str, config: GenerationConfig, estimator: dict, threshold: float, **mappings: dict) -> dict:
    """A checked manifest; ``estimator`` is {"kind": "linear", "weights", "bias", "medians"} or {"kind": "spark"}."""
    made = {"schema_version": SCHEMA, "artifact_type": KIND, "model_id": model_id, "feature_names": list(METRICS), "generation_config": asdict(config), "estimator": estimator, "decision_threshold": threshold}
    return check({**{k: {} for k in _MAPPINGS}, **mappings, **made})


def check(p: object) -> dict:
    """The manifest, or an error that names what is wrong with it."""
    if not isinstance(p, dict):
        raise DataQualityError("an artifact must be an object")
    rules = {
        "schema_version": lambda x: type(x) is int and x == SCHEMA, "artifact_type": lambda x: x == KIND, "model_id": lambda x: isinstance(x, str) and bool(x),
        "feature_names": lambda x: isinstance(x, (list, tuple)) and list(x) == list(METRICS), "decision_threshold": _number,
        "estimator": lambda x: isinstance(x, dict) and (x.get("kind") == "spark" or x.get("kind") == "linear" and len(x.get("weights", ())) == len(METRICS) and all(map(_number, x["weights"]))),
        **{k: lambda x: isinstance(x, dict) for k in _MAPPINGS},
    }
    wrong = [k for k, ok in rules.items() if not ok(p.get(k))]
    if wrong:
        raise DataQualityError(f"the artifact has invalid {wrong}")
    try:
        GenerationConfig.of(p.get("generation_config"))
    except (TypeError, ValueError) as e:
        raise DataQualityError(f"the artifact has an invalid generation_config: {e}") from e
    return p


def safe_id(model_id: str) -> str:
    """The driver's counterpart of ``keys.safe_model_id``."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", model_id).strip("_")


def candidates(root: str, model_id: str) -> list[str]:
    """Where a model's artifact may lie, the most specific place first."""
    own = safe_id(model_id)
    return [*([f"{root}/{own}"] if own else []), f"{root}/generic"]


def load(spark: SparkSession, root: str, model_id: str, generic: bool = False) -> Artifact | None:
    """The artifact of a model (or of what its alias stands for); None where there is none or it is another model's.

    Manifests are JSON and estimators numbers or saved Spark pipelines: nothing is unpickled.
    """
    wanted = ALIASES.get(model_id, model_id)
    places = candidates(root, wanted)[: None if generic else 1]
    place = next((p for p in places if files.exists(spark, f"{p}/manifest.json")), None)
    if place is None:
        return None
    p = check(json.loads(files.read_text(spark, f"{place}/manifest.json")))
    if p["model_id"] != wanted and not (generic and place.endswith("/generic")):
        return None
    e = p["estimator"]
    if e["kind"] == "spark":
        from pyspark.ml import PipelineModel

        estimator: Predictor = Fitted(PipelineModel.load(f"{place}/model"))
    else:
        estimator = Linear(METRICS, tuple(e["weights"]), e.get("bias", 0.0), tuple(e["medians"]) if e.get("medians") else None)
    return Artifact(p["model_id"], GenerationConfig.of(p["generation_config"]), estimator, float(p["decision_threshold"]), p)


def export(spark: SparkSession, root: str, manifest: dict, model=None, sample: DataFrame | None = None) -> Artifact:
    """Write an artifact aside, read it back, compare its scores of ``sample`` with the model's, then move it in place."""
    check(manifest)
    place = candidates(root, manifest["model_id"])[0]
    aside = f"{root}/.{uuid.uuid4().hex[:8]}"
    inside = candidates(aside, manifest["model_id"])[0]
    try:
        if model is not None:
            model.save(f"{inside}/model")
        files.write_text(spark, f"{inside}/manifest.json", json.dumps(manifest, sort_keys=True))
        back = load(spark, aside, manifest["model_id"])
        if back is None:
            raise DataQualityError("the artifact can't be read back")
        if model is not None and sample is not None:
            made = Fitted(model).predict(sample, "_one")
            both = back.estimator.predict(made.drop(*set(made.columns) - {*sample.columns, "_one"}), "_two")  # in one job: a sample may be of other rows in a second one
            if not both.where(~F.col("_one").eqNullSafe(F.col("_two"))).isEmpty():
                raise DataQualityError("the artifact read back scores otherwise")
        files.replace(spark, inside, place)
    finally:
        files.delete(spark, aside)
    return load(spark, root, manifest["model_id"])
