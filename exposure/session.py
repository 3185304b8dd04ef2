"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: str | int = "*", app: str = "exposure", **conf: str) -> SparkSession:
    """Session for tests and local benchmarks; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8" if cpus == "*" else str(cpus),
        "spark.sql.adaptive.enabled": "true",
        # small local shuffles carry little data but much work per row: keep the cores busy
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python functions find it wherever they run.

    Spark serves the archive from the driver and puts it on the workers' path.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="exposure-"), "exposure.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster; only an unconfigured local session gets a folder of its own."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    if not folder:
        used = context._jsc.sc().getCheckpointDir()
        folder = None if used.isEmpty() else used.get()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} is not set; a cluster needs a shared checkpoint folder")
    folder = tempfile.mkdtemp(prefix="exposure-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table to the shared folder and go on from there.

    The plan that follows starts at a parquet scan, so lost executors re-read it instead of repeating the work
    before it, and filters and columns are pushed into the scan.
    """
    spark = df.sparkSession
    run = spark.sparkContext.applicationId
    path = f"{checkpoint_dir(spark)}/exposure-{run}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
