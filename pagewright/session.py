"""Session helpers: defaults for stand-alone use, shipping the package, checkpoints."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A session on one machine, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("pagewright").config("spark.driver.memory", memory)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster; once a session, and not in local mode."""
    context = spark.sparkContext
    if context.master.startswith("local[") or context.master == "local" or getattr(context, "_pagewright_sent", False):
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    name = f"pagewright-{context.applicationId}.zip"
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:  # the folder all machines see
        place = spark._jvm.org.apache.hadoop.fs.Path(shared, name)
        stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
        stream.write(packed.getvalue())
        stream.close()
        target = place.toString()
    else:  # read by the driver's own file server only
        target = os.path.join(tempfile.mkdtemp(prefix="pagewright"), name)
        Path(target).write_bytes(packed.getvalue())
    context.addPyFile(target)
    context._pagewright_sent = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is set and all runs on this machine, as in tests."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all machines of the cluster see")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pagewright-checkpoint"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df on reliable shared storage and cut its lineage."""
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """Partitions for a shuffle before a kernel: what the session sets, and no fewer than there are cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, by: int = 1) -> DataFrame:
    """Spread a scan over the cores where it has fewer partitions than they are; a large scan stays as it is.

    For scans with filters and projections only: counting the partitions of anything else would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism * by
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
