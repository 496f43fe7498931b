"""Applying a head's record to vectors with numpy alone: this file travels with exported heads."""

from __future__ import annotations

import numpy as np

#: Model ids that stand for another checkpoint.
ALIASES = {"qwen3-8b:low": "deepseek-ai/DeepSeek-R1-0528-Qwen3-8B"}


def canonical(model_id: str) -> str:
    return ALIASES.get(model_id, model_id)


def probabilities(record: dict, features) -> np.ndarray:
    """One probability a vector: standardised, through the hidden ReLU layer if there is one, then a sigmoid."""
    x = np.asarray(features, float)
    mean, std = np.asarray(record["mean"], float), np.asarray(record["std"], float)
    if x.ndim != 2 or x.shape[1] != len(mean):
        raise ValueError(f"features must be vectors of {len(mean)}")
    z = (x - mean) / std
    if record["hidden"]:
        z = np.maximum(z @ np.asarray(record["hidden"], float).T + np.asarray(record["hidden_bias"], float), 0)
    logit = z @ np.asarray(record["weights"], float) + record["bias"]
    if not np.isfinite(logit).all():
        raise ValueError("the head gave a value that isn't finite")
    e = np.exp(-np.abs(logit))
    return np.where(logit >= 0, 1 / (1 + e), e / (1 + e))


def decisions(record: dict, features) -> list[bool]:
    return [bool(p >= record["threshold"]) for p in probabilities(record, features)]
