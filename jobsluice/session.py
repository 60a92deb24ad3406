"""Session settings for local runs, and where jobs put materialised tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: str = "8", memory: str = "8g", app: str = "jobsluice") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Executors of a cluster do not share a machine's own folders, so one is made
    only where driver and executors are a single local process.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="jobsluice-"))
    return _LOCAL[0]


_LOCAL: list[str] = []
# The folder that this thread's run writes to, while it has one of its own.
_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Everything materialised inside goes to one folder, deleted at the end.

    What is to last must have been written elsewhere by then.
    """
    path = f"{scratch_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    outer = _SCOPE.set(path)
    try:
        yield
    finally:
        _SCOPE.reset(outer)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage like a reliable checkpoint, survives the loss of any
    executor, and gives later joins exact file sizes to plan with.
    """
    spark = df.sparkSession
    base = _SCOPE.get() or scratch_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
