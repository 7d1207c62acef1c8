"""Session set-up, the shared work folder and lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

# A side is broadcast by hand only after it was counted and found below this.
BROADCAST_ROWS = 200_000


def build_session(app: str = "flowtide", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """Session with the settings the operators rely on.

    ``partitions`` is a starting point only: adaptive execution merges small
    shuffle partitions and splits skewed ones.  On a cluster leave ``master``
    to spark-submit and size ``partitions`` to the shuffle volume
    (about 128-200 MB per partition).
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the workers, once per application.

    Python functions then load there from wherever the driver was started.
    """

    def send():
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.basename(os.path.dirname(os.path.abspath(__file__)))
        staged = tempfile.mkdtemp(prefix=f"{name}-ship-")
        shutil.copytree(os.path.join(root, name), os.path.join(staged, "src", name), ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(staged, name), "zip", os.path.join(staged, "src")))
        return True

    keep(spark, "shipped package", send)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's checkpoint folder.

    Only a local-mode session without the setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="flowtide-"))
        current = sc.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/flowtide-{uuid.uuid4().hex}/{name}"


def small_table(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """An aggregate that is expected to be small, evaluated once.

    Up to ``limit`` rows it comes back as a local table to broadcast, so that
    joining it moves no row of the large side.  A larger one is stored and
    joined by shuffle, where adaptive execution splits skewed keys.
    """
    head = df.limit(limit + 1).collect()
    if len(head) > limit:
        return cut(df)
    return broadcast(df.sparkSession.createDataFrame(head, df.schema))


_kept: dict[tuple, object] = {}


def keep(spark: SparkSession, name: str, make):
    """The value of ``make()``, made once per application."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def cut(df: DataFrame) -> DataFrame:
    """Store ``df`` as Parquet in the shared folder and continue from the stored copy.

    The result survives lost executors, later steps read only the columns they
    need, and columns that depend on the physical placement of rows (partition
    numbers) become plain data.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
