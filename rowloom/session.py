"""Session defaults and the folder shared by all executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def build_session(name: str = "rowloom", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and skew-join handling switched on."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder; a
    cluster without it is an error, since a driver-local path would not be
    visible to the executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="rowloom-")
    return _local_dirs[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    path = f"{shared_dir(spark).rstrip('/')}/rowloom/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def discard(spark: SparkSession) -> None:
    """Delete what this session wrote below the shared folder by ``fresh_path`` and ``settle``.

    Results that are not stored elsewhere can't be read after it; call it when they are.
    """
    context = spark.sparkContext
    for path in _written.pop(context.applicationId, []):
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run inside it delete their shuffle files as they end.

    Otherwise the files stay until the driver collects garbage.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def settle(df: DataFrame, name: str, passing: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, and later readers survive the loss of any executor. With ``passing``, the shuffle files
    of the write go as it ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with passing_shuffles(spark) if passing else nullcontext():
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def release(df: DataFrame) -> None:
    """Delete what ``settle`` wrote for ``df``; call it when nothing will read that any more."""
    context = df.sparkSession.sparkContext
    _written[context.applicationId].remove(df._settled)
    place = context._jvm.org.apache.hadoop.fs.Path(df._settled)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
