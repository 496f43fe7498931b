"""Participants' folders on the workers: modules, packages and data files of a submission, apart from any other's."""

from __future__ import annotations

import contextlib
import hashlib
import importlib
import importlib.util
import io
import os
import sys
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from types import ModuleType

from pyspark import SparkFiles
from pyspark.sql import SparkSession

from ..sources import files
from .quality import DataQualityError

#: Bytes of a submission at most: it passes through the driver once.
MOST_BYTES = 1 << 30
#: The file and the function of a submission, and the name its module goes by.
FILE, FUNCTION, MODULE = "solution.py", "are_robust", "participant_solution"


class Package:
    """A folder whose top names (modules, packages) are imported from it while it is active, whatever else bears them.

    Python keeps modules by name for a whole worker, which serves several submissions. So a package keeps its
    own: they are in ``sys.modules`` while it is active, and what they hid comes back afterwards.
    """

    def __init__(self, folder: str):
        self.folder = folder
        self.names = {MODULE, *(n.removesuffix(".py") for n in os.listdir(folder) if n.endswith(".py") or os.path.isdir(f"{folder}/{n}"))}
        self.modules: dict[str, ModuleType] = {}
        with self.active():
            self.function = self._load()

    def _taken(self) -> dict[str, ModuleType]:
        return {k: sys.modules.pop(k) for k in [k for k in sys.modules if k.partition(".")[0] in self.names]}

    @contextlib.contextmanager
    def active(self) -> Iterator[None]:
        hidden, entry, wrote = self._taken(), str(self.folder), sys.dont_write_bytecode
        sys.modules.update(self.modules)
        sys.path.insert(0, entry)
        sys.dont_write_bytecode = True  # the folder is Spark's
        importlib.invalidate_caches()
        try:
            yield
        finally:
            self.modules = self._taken()
            sys.modules.update(hidden)
            sys.dont_write_bytecode = wrote
            with contextlib.suppress(ValueError):  # unless the code has removed it
                sys.path.remove(entry)

    def _load(self) -> Callable:
        spec = importlib.util.spec_from_file_location(MODULE, f"{self.folder}/{FILE}")
        module = importlib.util.module_from_spec(spec)
        sys.modules[MODULE] = module
        spec.loader.exec_module(module)
        found = getattr(module, FUNCTION, None)
        if not callable(found):
            raise DataQualityError(f"{FILE} must define {FUNCTION}(model_id, problems)")
        return found

    def __call__(self, model_id: str, problems: list[str]) -> list[bool]:
        with self.active():  # modules may be imported only now
            return self.function(model_id, problems)


_LOADED: dict[str, Package] = {}


def loaded(name: str) -> Package:
    """The worker's package of an archive that Spark has brought; loaded once a worker."""
    if name not in _LOADED:
        _LOADED[name] = Package(os.path.join(SparkFiles.getRootDirectory(), name))
    return _LOADED[name]


def _zipped(spark: SparkSession, folder: str) -> bytes:
    """The folder, or an archive of one, as an archive that is the same for the same files; compiled and hidden ones are left out."""
    if folder.endswith(".zip"):
        return _archive({n: b for n, b in _unzipped(files.read_bytes(spark, folder)).items() if _wanted(n)})
    found = [(p, n) for p, n in files.walk(spark, folder) if _wanted(p)]
    if sum(n for _, n in found) > MOST_BYTES:
        raise DataQualityError(f"a submission has {MOST_BYTES} bytes at most")
    return _archive({p: files.read_bytes(spark, f"{folder}/{p}") for p, _ in found})


def _wanted(path: str) -> bool:
    return not any(x.startswith(".") or x == "__pycache__" for x in path.split("/")) and not path.endswith((".pyc", ".pyo"))


def _unzipped(data: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        found = [i for i in z.infolist() if not i.is_dir()]
        if sum(i.file_size for i in found) > MOST_BYTES:
            raise DataQualityError(f"a submission has {MOST_BYTES} bytes at most")
        if any(i.filename.startswith("/") or ".." in i.filename.split("/") for i in found):
            raise DataQualityError("a submission's paths must lie in its folder")
        return {i.filename: z.read(i) for i in found}


def _archive(parts: dict[str, bytes]) -> bytes:
    if FILE not in parts:
        raise DataQualityError(f"a submission must have {FILE} at its root")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p, data in sorted(parts.items()):
            z.writestr(zipfile.ZipInfo(p), data)
    return out.getvalue()


def shipped(spark: SparkSession, folder: str) -> str:
    """Bring a folder from any store to all workers as an archive, which Spark unpacks there; its name. A folder that
    has come before isn't sent again."""
    data = _zipped(spark, folder)
    name = f"submission-{hashlib.sha256(data).hexdigest()[:24]}"
    if not any(a.endswith(f"#{name}") for a in _sent(spark)):
        local = os.path.join(tempfile.mkdtemp(prefix="submission-"), f"{name}.zip")  # the driver's file server reads it
        with open(local, "wb") as f:
            f.write(data)
        spark.sparkContext.addArchive(f"{local}#{name}")
        _sent(spark).add(f"{local}#{name}")
    return name


_SENT: dict[str, set[str]] = {}


def _sent(spark: SparkSession) -> set[str]:
    return _SENT.setdefault(spark.sparkContext.applicationId, set())


def check_loads(spark: SparkSession, name: str) -> None:
    """Load the package on a worker: what is wrong with it is an error before any case is tried."""
    import pyarrow as pa

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = []
            for _ in range(b.num_rows):
                try:
                    loaded(name)
                    said.append(None)
                except BaseException as e:  # noqa: BLE001 opaque code, which may even try to exit
                    said.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([pa.array(said, pa.string())], ["error"])

    said = spark.range(1, numPartitions=1).mapInArrow(load, "error string").first()["error"]
    if said is not None:
        raise DataQualityError(f"the submission doesn't load: {said}")
