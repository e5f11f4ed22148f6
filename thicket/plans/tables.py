"""Tables in the shared folder that cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders written in the innermost ``scratch``.
_scope: ContextVar[list[str] | None] = ContextVar("scratch", default=None)
#: Folders that a table handed out still reads, and the session that goes with them.
_left: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is absent a temporary folder is made and set, but only if everything runs on this machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="thicket-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialise(df: DataFrame, name: str, written: list[str] | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back, so that it outlives the executors that made it. ``written``: a list that
    notes its folder, for ``remove``; without it the table goes at the end of the innermost ``scratch``, or else of the program, as a table that
    was handed out may be read until then."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    scope = _scope.get()
    if written is not None:
        written.append(path)
    elif scope is not None:
        scope.append(path)
    else:
        _left.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, written: list[str]) -> None:
    """Deletes tables that nothing reads any more."""
    for path in written:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    written.clear()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end: what is to stay must have been computed by then."""
    own: list[str] = []
    token = _scope.set(own)
    try:
        yield
    finally:
        _scope.reset(token)
        remove(spark, own)


@contextlib.contextmanager
def scratch_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A path in the shared folder that is removed at the end."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove(spark, [path])


@atexit.register
def _sweep() -> None:
    for spark, path in _left:
        with contextlib.suppress(Exception):  # the session has stopped
            remove(spark, [path])
