"""Hidden states of prompts: one loaded model a task, batches of like lengths, checked masks and layers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame

#: A prompt is the text itself, or the text in the model's chat form.
TEMPLATES = ("plain", "chat")


class StateModel(Protocol):
    """What a loaded model must do."""

    def chat(self, text: str) -> str:
        """The text as a user's turn that awaits an answer."""

    def encode(self, prompts: list[str], max_length: int, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of [prompts, positions], cut at ``max_length``; special tokens are added to plain prompts."""

    def states(self, ids: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
        """[prompts, positions, width] for each layer."""


class Layers(tuple):
    """Distinct numbers of layers, in the order in which their states are joined."""

    def __new__(cls, numbers):
        numbers = tuple(numbers)
        if not numbers or not all(type(n) is int and n >= 0 for n in numbers) or len({*numbers}) < len(numbers):
            raise ValueError("layers must be distinct numbers of at least 0")
        return super().__new__(cls, numbers)

    def of(self, mask, states) -> np.ndarray:
        """Each row's states at its last real position: [rows, layers x width]."""
        mask = np.atleast_2d(np.asarray(mask))
        real = mask.cumsum(axis=1).argmax(axis=1) if mask.size else np.zeros(len(mask), int)  # where the count is first full
        if mask.ndim != 2 or not mask.size or not {*np.unique(mask).tolist()} <= {0, 1} or 0 in mask.sum(axis=1):
            raise ValueError("every text needs a mask of 0 and 1 with a real token")
        if len(states) <= max(self):
            raise ValueError("there is no such layer")
        layers = [np.asarray(states[n], float) for n in self]
        if any(h.ndim != 3 or h.shape[:2] != mask.shape for h in layers):
            raise ValueError("states must have the mask's shape")
        return np.hstack([np.take_along_axis(h, real[:, None, None], axis=1)[:, 0] for h in layers])


@dataclass(frozen=True)
class Spec:
    """How prompts are made and which states are read."""

    layers: tuple[int, ...]
    max_length: int = 2048
    template: str = "plain"
    batch: int = 8

    def __post_init__(self):
        object.__setattr__(self, "layers", Layers(self.layers))
        if not all(type(n) is int and n >= 1 for n in (self.max_length, self.batch)) or self.template not in TEMPLATES:
            raise ValueError(f"not allowed: length {self.max_length}, batch {self.batch}, template {self.template}")


def hidden_states(rows: DataFrame, key: str, text: str, load: Callable[[], StateModel], spec: Spec, profile=None) -> DataFrame:
    """(key, features): the states of every row's prompt at its last real position, layer after layer.

    ``load`` is called once a task that has rows, on its worker. Within each Arrow batch texts are taken by length, so
    that a model's batch has little padding; what a batch holds has no effect on a row's features. ``profile`` is a Spark
    resource profile for these tasks alone (say, one with a GPU). Texts must be non-empty strings; masks are 0 and 1 with a
    real token each, no longer than the limit; features must be finite and of one width.
    """
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, width = None, None
        for f in frames:
            if not len(f):
                continue
            if not all(isinstance(t, str) and t.strip() for t in f[text]):
                raise ValueError("texts must be non-empty strings")
            model = model or load()
            f = f.iloc[f[text].str.len().argsort(kind="stable")]
            for at in range(0, len(f), spec.batch):
                part = f.iloc[at : at + spec.batch]
                plain = spec.template == "plain"
                ids, mask = (np.asarray(x) for x in model.encode([t if plain else model.chat(t) for t in part[text]], spec.max_length, plain))
                if mask.shape != ids.shape or len(mask) != len(part) or mask.ndim != 2 or mask.shape[1] > spec.max_length:
                    raise ValueError(f"ids and masks must be of one shape, {len(part)} by {spec.max_length} at most")
                got = Layers(spec.layers).of(mask, model.states(ids, mask))
                width = width or got.shape[1]
                if got.shape != (len(part), width) or not np.isfinite(got).all():
                    raise ValueError("features must be finite and of one width")
                yield pd.DataFrame({key: part[key].to_numpy(), "features": list(got)})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, features array<double>", profile=profile)
