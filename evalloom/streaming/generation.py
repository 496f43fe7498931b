"""Confidence metrics of responses while their steps arrive: one distribution a response is held, until its token is known."""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.tokens import generation_metrics

#: An event: the distribution over the next token after ``step`` tokens, and the token that the one before it led to (null
#: at step 0). One without logits ends the response.
EVENT = "resp_id long, step long, token long, logits array<double>"
#: What is known of a step once its token has been told.
STEP = "resp_id long, step long, token long, log_prob double, prob double, entropy double, top1_prob double, margin double, top1_id long, is_top1 boolean"
_KNOWN = STEP.removeprefix("resp_id long, ")
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def reduced(logits: np.ndarray) -> tuple[np.ndarray, float, float, float, int]:
    """(log probabilities, entropy, top probability, its lead over the second, top id); NaN terms of the entropy count nothing."""
    x = np.asarray(logits, float)
    x = x - x.max()
    lp = x - np.log(np.exp(x).sum())
    p = np.exp(lp)
    two = np.sort(lp)[::-1][:2]
    lead = np.exp(two[0]) - np.exp(two[1]) if len(two) > 1 else float("nan")
    return lp, float(-np.nan_to_num(p * lp, nan=0.0, posinf=0.0, neginf=0.0).sum()), float(np.exp(two[0])), float(lead), int(lp.argmax())


class Responses(StatefulProcessor):
    """State of a response: the next step, the last step's distribution, what is known of the steps before, and events that came early.

    Events that repeat a step or come after the end of a batch's response are ignored; others wait for the steps before them.
    When the end has come all steps are told at once and the state goes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "step long")
        self.pending = handle.getValueState("pending", "log_probs array<double>, entropy double, top1_prob double, margin double, top1_id long")
        self.known = handle.getListState("known", _KNOWN)
        self.early = handle.getMapState("early", "step long", "token long, logits array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(rows).sort_values("step", kind="stable")
        at = self.at.get()[0] if self.at.exists() else 0
        last = self.pending.get() if self.pending.exists() else None
        waiting = {s: (t, x) for s, t, x in zip(got["step"], got["token"], got["logits"]) if s >= at}
        new, ended = [], False
        while not ended:
            if at in waiting:
                token, logits = waiting.pop(at)
            elif self.early.containsKey((at,)):
                token, logits = self.early.getValue((at,))
                self.early.removeKey((at,))
            else:
                break
            if last is not None:
                token = int(token)
                lp = float(last[0][token])
                new.append((at - 1, token, lp, float(np.exp(lp)), last[1], last[2], last[3], last[4], last[4] == token))
            ended = logits is None or not len(logits)
            if not ended:
                lp, *rest = reduced(logits)
                last = (lp.tolist(), *rest)
            at += 1
        if ended:
            steps = [*(tuple(r) for r in self.known.get()), *new] if self.known.exists() else new
            for s in (self.at, self.pending, self.known, self.early):
                s.clear()
            yield pd.DataFrame([(key[0], *s) for s in steps], columns=[c.split()[0] for c in STEP.split(", ")])
            return
        self.at.update((at,))
        if last is not None:
            self.pending.update(last)
        if new:
            self.known.appendList(new)
        for s, (t, x) in waiting.items():
            self.early.updateValue((int(s),), (None if pd.isna(t) else int(t), None if x is None else [float(v) for v in x]))

    def close(self) -> None:
        pass


@contextlib.contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    name, value = _PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextlib.contextmanager
def _by_value() -> Iterator[None]:
    """This module's classes travel with their code: the worker that starts a stateful operator on the driver imports
    from the session's own paths only, not from added files."""
    module = sys.modules[__name__]
    cloudpickle.register_pickle_by_value(module)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(module)


def finished_steps(events: DataFrame) -> DataFrame:
    """(``STEP``) of each response of a stream of ``EVENT`` rows, in the batch that brings its last event. A response's state is its own
    key's: the logits of one step, ten numbers for every other, and what came early."""
    with _by_value():
        return events.groupBy("resp_id").transformWithStateInPandas(Responses(), STEP, "Append", "None")


def write_metrics(events: DataFrame, path: str, checkpoint: str, valid: Callable[[Column], Column], **limits) -> None:
    """``generation_metrics`` of finished responses, appended to ``path`` as their last events arrive; runs through what is there
    and stops, to go on from the checkpoint. ``valid`` says of a token column which tokens count. A batch is a folder of its
    own, so one that is done again after a failure replaces itself."""
    spark = events.sparkSession

    def put(batch: DataFrame, n: int) -> None:
        steps = batch.withColumn("valid", valid(F.col("token")))
        generation_metrics(steps, "resp_id", **limits).write.mode("overwrite").parquet(f"{path}/batch={n}")

    with _rocks(spark):
        finished_steps(events).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
