"""Session helpers: one place that builds a SparkSession for tests/bench and
resolves the shared checkpoint folder.

On a cluster the session is created by the platform; the library only reads
``spark.checkpoint.dir`` from it.  A local folder is used only when that
setting is absent on a session that runs on one machine (tests, bench).
"""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                        app: str = "quill") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # test tables are one row group, hence one task: deal their rows out (clusters leave this unset)
        .config("spark.quill.minInputPartitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("QUILL_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    Only a session on one machine may go without: it gets a private folder.
    On a cluster an unset folder is an error, because a machine-local one
    would lose every other executor's part of a table."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not is_local(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set; name a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="quill-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def is_local(master: str) -> bool:
    """Whether driver and tasks run in one JVM (``local-cluster`` does not)."""
    return re.fullmatch(r"local(\[.*\])?", master) is not None


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session, so that Python
    stages can import it wherever the session was started."""
    sc = spark.sparkContext
    if getattr(sc, "_quill_shipped", False):
        return
    sc._quill_shipped = True
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quill-ship-"), "quill.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("quill", os.path.relpath(full, root)))
    sc.addPyFile(path)


def table_path(spark: SparkSession) -> str:
    """A new path in the shared folder; tables of one application lie together,
    so they can be removed when it has ended."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/quill-tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


#: Spark then removes the shuffles of an action when it has ended; it keeps them until the driver collects its garbage otherwise.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession):
    """Actions that are not repeated leave no shuffle files: what was written is read from then on."""
    before = spark.conf.get(_CLEANED, None)
    spark.conf.set(_CLEANED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANED)
        else:
            spark.conf.set(_CLEANED, before)


def materialize(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Cut lineage: write ``df`` once as a Parquet table in the shared folder
    named by ``spark.checkpoint.dir`` and read it back.  It is computed once,
    survives executor loss, and keeps later plans small (a plan that
    references its own input several times grows with every stage)."""
    spark = df.sparkSession
    path = table_path(spark)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    with _shuffles_removed(spark):
        w.parquet(path)
    return spark.read.parquet(path)
