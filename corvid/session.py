"""Session defaults and tables shared by the driver and all executors."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints"

_written: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = 8, app: str = "corvid") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read: spark.checkpoint.dir, else a default for a local master alone."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(LOCAL_CHECKPOINT_DIR)
    return LOCAL_CHECKPOINT_DIR


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/corvid/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def shared_table(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    It cuts the lineage as checkpoint() does, survives lost executors, is columnar and
    compressed, and gives the optimizer exact sizes.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Shared tables written inside are removed at the end, but for those given to the function it yields.

    What leaves such a block has to be computed by then, or hang on kept tables alone.
    """
    before, kept = len(_written), set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.shared_path)
        return table

    try:
        yield keep
    finally:
        inside = _written[before:]
        del _written[before:]
        for owner, path in inside:
            if path in kept:
                _written.append((owner, path))
            else:
                remove_path(owner, path)


def release(spark: SparkSession) -> int:
    """Remove all shared tables of this session, when no query that made them is read any more; how many."""
    mine = [x for x in _written if x[0] is spark]
    _written[:] = [x for x in _written if x[0] is not spark]
    for _, path in mine:
        remove_path(spark, path)
    return len(mine)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            remove_path(spark, path)
        except Exception:  # the JVM has gone: nothing can be deleted any more
            return
