"""Runs under a time budget and on record: jobs that outlive the budget are stopped, every outcome is written down."""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
import threading
import time
import traceback
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..sources import files
from .cache import content_digest
from .quality import DataQualityError

#: A run's states, and those that may follow each; a name's form.
NEXT = {None: {"running"}, "running": {"completed", "failed", "interrupted"}}
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,79}")
#: Seconds between two rounds of stopping jobs, as new ones may start.
AGAIN = 0.2
_INTERRUPT = "spark.job.interruptOnCancel"


class Deadline:
    """A time budget: ``check`` raises once it is spent, and ``over`` stops Spark's jobs too."""

    def __init__(self, seconds: float, clock=time.monotonic):
        self.clock, self.end = clock, clock() + seconds

    def left(self) -> float:
        return self.end - self.clock()

    def check(self) -> None:
        if self.left() <= 0:
            raise TimeoutError("the time budget is spent")

    @contextlib.contextmanager
    def over(self, spark: SparkSession) -> Iterator[None]:
        """Jobs started inside are stopped when the budget is spent, whatever stage they are in; then it's a TimeoutError.

        Jobs bear a tag of their own, so others of the session go on. Python code between jobs isn't stopped, but
        its next job is, and the budget is checked at the end.
        """
        sc, tag, done = spark.sparkContext, f"budget-{uuid.uuid4().hex[:12]}", threading.Event()
        before = sc.getLocalProperty(_INTERRUPT)

        def watch() -> None:
            wait = max(self.left(), 0)
            while not done.wait(wait):
                if self.left() <= 0:
                    with contextlib.suppress(Exception):  # the session may have gone
                        sc.cancelJobsWithTag(tag)
                wait = AGAIN if self.left() <= 0 else self.left()

        watcher = threading.Thread(target=watch, daemon=True)
        sc.addJobTag(tag)
        sc.setInterruptOnCancel(True)  # tasks stop too
        watcher.start()
        try:
            yield
        except Exception as e:
            if self.left() <= 0 and not isinstance(e, TimeoutError):
                raise TimeoutError("the time budget is spent") from e
            raise
        finally:
            done.set()
            watcher.join()
            sc.removeJobTag(tag)
            sc.setLocalProperty(_INTERRUPT, before)
        self.check()


def code_digests() -> dict[str, str]:
    """The SHA-256 of each of this package's files."""
    root = Path(__file__).parent.parent
    return {str(p.relative_to(root)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(root.rglob("*.py"))}


Input = DataFrame | Callable[[], DataFrame]


def table_digests(tables: dict[str, Input]) -> dict[str, list]:
    """Content digests; a function reads its table anew, where a DataFrame keeps the files that it found first."""
    read = {name: t() if callable(t) else t for name, t in sorted(tables.items())}
    return {name: list(content_digest(df, *df.columns).first()) for name, df in read.items()}


class Journal:
    """A run's record at ``root/name/result.json``, rewritten at each transition of its state.

    As a context it gives the record, to which the caller may add. Names are simple and new, and one run at a time holds
    ``root/run.lock``. Inputs and code are digested at the start and compared at the end: a run during which either
    changed has failed. ``outputs`` names files or folders whose digests a completed run records; those that are missing fail it.
    With ``seconds`` the run is under a ``Deadline``, at ``deadline``.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, inputs: dict[str, Input], settings: dict | None = None, outputs: dict[str, str] | None = None, seconds: float | None = None):
        if not NAME.fullmatch(name):
            raise DataQualityError("a run needs a simple name")
        self.spark, self.folder, self.lock = spark, f"{root}/{name}", f"{root}/run.lock"
        self.inputs, self.outputs, self.seconds, self.deadline = inputs, outputs or {}, seconds, None
        self.record = {"name": name, "status": None, "scientific_status": "unreviewed", "settings": settings or {}}

    def _to(self, status: str, **more) -> None:
        if status not in NEXT.get(self.record["status"], ()):
            raise RuntimeError(f"a run can't go from {self.record['status']} to {status}")
        self.record |= more | {"status": status}
        files.write_text(self.spark, f"{self.folder}/result.json", json.dumps(self.record, sort_keys=True, allow_nan=False))

    def __enter__(self) -> dict:
        if files.exists(self.spark, self.folder):
            raise FileExistsError(f"there is a run at {self.folder}")
        files.write_text(self.spark, self.lock, self.record["name"], overwrite=False)
        self._budget = contextlib.ExitStack()
        try:
            self._to("running", started_at=time.time(), source_files=code_digests())
            self.record["inputs"] = table_digests(self.inputs)
            if self.seconds is not None:
                self.deadline = Deadline(self.seconds)
                self._budget.enter_context(self.deadline.over(self.spark))
        except BaseException as e:
            self._end(e)
            raise
        return self.record

    def __exit__(self, kind, error: BaseException | None, trace) -> None:
        try:
            if self._budget.__exit__(kind, error, trace):
                error = None
            elif error is None:
                self._unchanged()
        except BaseException as e:
            self._end(e)
            raise
        self._end(error)

    def _unchanged(self) -> None:
        if code_digests() != self.record["source_files"]:
            raise DataQualityError("the code changed during the run")
        if table_digests(self.inputs) != self.record["inputs"]:
            raise DataQualityError("the inputs changed during the run")
        self.record["artifacts"] = {name: self._digest(path) for name, path in sorted(self.outputs.items())}

    def _digest(self, path: str) -> dict[str, str] | str:
        found = files.walk(self.spark, path)
        if not found:
            raise DataQualityError(f"the run left nothing at {path}")
        one = {p: hashlib.sha256(files.read_bytes(self.spark, f"{path}/{p}" if p else path)).hexdigest() for p, _ in found if not p.rpartition("/")[2].startswith((".", "_"))}
        return one if set(one) != {""} else one[""]

    def _end(self, error: BaseException | None) -> None:
        try:
            if error is None:
                return self._to("completed", finished_at=time.time())
            files.write_text(self.spark, f"{self.folder}/error.txt", "".join(traceback.format_exception(error)))
            self._to("interrupted" if isinstance(error, KeyboardInterrupt) else "failed", error_type=type(error).__name__, finished_at=time.time())
        finally:
            files.delete(self.spark, self.lock)
