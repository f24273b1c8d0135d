"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None
#: Paths settled inside each open block of ``intermediates``, innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def build_session(cores: str = "*", app: str = "spectraloom") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where it is unset, a local session sets a folder of its own, removed when Python
    ends; on a cluster a machine-local folder would be lost with its machine.
    """
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="spectraloom-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", _own_folder)
    return _own_folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage (a lost executor re-reads files instead of recomputing), pins
    non-deterministic columns, and gives Catalyst the true size in bytes, so that
    a later join broadcasts this side only if it really is below
    ``spark.sql.autoBroadcastJoinThreshold``.  Inside a block of ``intermediates`` the
    table lives until the block ends.
    """
    return _settled(df, label, _scopes.get()[-1:])


def settle_outside(df: DataFrame, label: str = "settled", blocks: int = 1) -> DataFrame:
    """Like ``settle``, but the table outlives the ``blocks`` innermost blocks of ``intermediates``."""
    scopes = _scopes.get()
    return _settled(df, label, scopes[: max(0, len(scopes) - blocks)][-1:])


def _settled(df: DataFrame, label: str, owner: tuple[list[str], ...]) -> DataFrame:
    spark = df.sparkSession
    path = new_path(spark, label)
    for paths in owner:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables settled inside the block when it ends, also by an error.

    Blocks nest.  A DataFrame that leaves a block must read none of its tables: it is
    written with ``settle_outside`` first.
    """
    paths: list[str] = []
    outer = _scopes.get()
    _scopes.set((*outer, paths))
    try:
        yield
    finally:
        _scopes.set(outer)
        for path in paths:
            _remove(spark, path)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Inside the block each query's shuffle files go when it ends, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
