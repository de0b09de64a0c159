"""Intermediate tables in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset and the session is local (tests on one
machine) a folder of our own is used; on a cluster a folder that executors do not share would lose data, so that raises.
What is written here outlives a lost executor, so it also cuts lineage.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []
_PATH_OF: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_RUN: ContextVar[Run | None] = ContextVar("run", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or one of our own where that is unset and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="helixspark-")
    return _OWN[app]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: evaluated once, lineage cut, columns prunable.

    The shuffle files of the write are deleted with its end, for the written table replaces them.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    kept = spark.read.schema(df.schema).parquet(path)
    _PATH_OF[kept] = path
    return kept


def once(df: DataFrame, name: str) -> DataFrame:
    """``df`` as :func:`keep` returns it; a table that it returned stays as it is."""
    return df if df in _PATH_OF else keep(df, name)


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder in the shared one, for files that are no Parquet; it is deleted like the tables."""
    path = f"{shared_dir(spark)}/helixspark-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    if (run := _RUN.get()) is not None:
        run.written.append((spark, path))
    return path


def drop(df: DataFrame) -> None:
    """Delete a table that :func:`keep` returned, once nothing reads it any more."""
    _delete([w for w in _WRITTEN if w[1] == _PATH_OF.get(df)])


def _delete(items: list[tuple[SparkSession, str]]) -> None:
    for item in items:
        if item in _WRITTEN:
            _remove(*item)
            _WRITTEN.remove(item)


class Run:
    """The tables that :func:`keep` writes inside ``with`` blocks of this object, in the thread that entered them.

    ``release`` deletes these alone, so runs side by side in one process leave each other's tables be.  What a run inside
    another leaves belongs to the outer one.
    """

    def __init__(self):
        self.written: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> Run:
        self._before = _RUN.set(self)
        return self

    def __exit__(self, *_) -> None:
        _RUN.reset(self._before)
        if (outer := _RUN.get()) is not None:
            outer.written += self.written

    def release(self, *but: DataFrame) -> None:
        """Delete the run's tables, all but the tables ``but`` that :func:`keep` returned."""
        stays = {_PATH_OF[df] for df in but}
        _delete([w for w in self.written if w[1] not in stays])
        self.written = [w for w in self.written if w[1] in stays]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean() -> None:
    """Delete every table written by this process.  Runs at exit; call it earlier only when no result is pending."""
    while _WRITTEN:
        item = _WRITTEN.pop()
        try:
            _remove(*item)
        except Exception:  # the session has ended: the shared folder's owner clears it
            _WRITTEN.clear()
    while _OWN:
        shutil.rmtree(_OWN.popitem()[1].removeprefix("file://"), ignore_errors=True)


atexit.register(clean)
