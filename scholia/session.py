"""Session, table and scratch-folder helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch sent to Python; a longer row travels alone.
BATCH_BYTES = 4_000_000


def local_session(app: str = "scholia", cores: str | int = 8, partitions: int = 8) -> SparkSession:
    """A session for one machine: tests, bench and ad-hoc use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SCHOLIA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the one set on the context.

    Where neither is set, a session on one machine gets a temporary folder; a
    cluster must name one, since no other machine sees the driver's.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="scholia-checkpoint-"))
        current = context._jsc.sc().getCheckpointDir()
    return named or current.get()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """SQL settings for what runs inside."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES):
    """Arrow batches of at most `size` bytes for what runs inside, whatever the length of its rows."""
    return settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(size)})


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder; any executor may be lost afterwards."""
    shared_dir(df.sparkSession)
    with bounded_batches(df.sparkSession):
        return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage like checkpointed, for large tables: as compressed Parquet in the shared folder, after which the shuffle files that led to it go.

    Rows keep neither their order nor their partitions.
    """
    return Scratch(df.sparkSession, "stored").write(df, "rows")


def as_row(df: DataFrame) -> Column:
    """All columns of df as one struct, so that columns added beside it clash with none of them."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])


class Scratch:
    """Parquet tables in the shared folder that live as long as one operator call.

    Written tables have known sizes, so the planner broadcasts a side only when
    it is under spark.sql.autoBroadcastJoinThreshold.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scholia-{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        # Once a table is written, nobody reads the shuffle files that led to it.
        with bounded_batches(self.spark), settings(self.spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self, *names: str) -> None:
        """Delete the named tables, or all."""
        for name in names or ("",):
            path, files = self._path(name)
            files.delete(path, True)

    def keep(self, *names: str) -> None:
        """Delete all tables but the named ones, which a lazy result still reads."""
        root, files = self._path()
        if files.exists(root):
            self.drop(*[name for x in files.listStatus(root) if (name := x.getPath().getName()) not in names])
