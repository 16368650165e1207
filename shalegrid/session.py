"""Session settings, and the package on the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
_OWN: list[str] = []
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a session in one process (local, as in tests) gets an own folder; on a cluster that is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="shalegrid-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return _OWN[0]


def workspace(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder for a table that a query writes; release() deletes it, as does the driver's end."""
    top = f"{shared_dir(spark)}/shalegrid/{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_at_end)
    _MADE.append(top)
    return f"{top}/{label}"


def made() -> int:
    """How many paths workspace() has given out that still stand; a mark for release()."""
    return len(_MADE)


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes what workspace() has given out after the mark, but for the paths in keep."""
    stay = [t for t in _MADE[since:] if any(k.startswith(t) for k in keep)]
    for top in _MADE[since:]:
        if top not in stay:
            where = spark._jvm.org.apache.hadoop.fs.Path(top)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _MADE[since:] = stay


def discard(spark: SparkSession, path: str) -> None:
    """Deletes one path that workspace() gave out, whose table nothing reads any more."""
    at = next((i for i, t in enumerate(_MADE) if path.startswith(t)), None)
    if at is not None:
        _MADE.append(_MADE.pop(at))
        release(spark, len(_MADE) - 1)


def _at_end() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            release(spark)
        except Exception:  # the session has ended: nothing can be deleted through it
            _MADE.clear()


_SHIPPED: set[str] = set()


def build(master: str | None = None, name: str = "shalegrid", **settings: str) -> SparkSession:
    """A session with this library's settings; more can be given with dots as underscores doubled."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once for each application, for functions that run in Python workers."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="shalegrid-src-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
