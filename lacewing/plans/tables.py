"""Written tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: dict[str, SparkSession] = {}
_passing: ContextVar[list[DataFrame] | None] = ContextVar("_passing", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a folder of our own in a session
    that runs in one process (tests); a cluster has to name one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lacewing-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go once it is written, not when the driver's garbage is collected."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, so a lost executor costs no recomputation
    of earlier stages, and the shuffle files of those stages go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lacewing-{uuid.uuid4().hex}"
    with _shuffles_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if (scope := _passing.get()) is not None:
        scope.append(out)
    return out


@contextlib.contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that settle writes inside are deleted at the end. The function given settles a table that outlives it."""
    outer, scope = _passing.get(), []
    token = _passing.set(scope)

    def kept(df: DataFrame) -> DataFrame:
        out = settle(df)
        scope.pop()
        if outer is not None:
            outer.append(out)
        return out

    try:
        yield kept
    finally:
        _passing.reset(token)
        for df in scope:
            discard(df)


def discard(df: DataFrame) -> None:
    """Delete a table that settle wrote and that nothing will read again."""
    path = getattr(df, "_written_to", None)
    if path and _written.pop(path, None):
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
            return


atexit.register(_sweep)
