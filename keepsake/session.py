"""Session settings the jobs rely on."""

from __future__ import annotations

import re
import tempfile

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import keepsake


def local_session(cpus: int | str = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("keepsake")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    """Settings that change results (UTC, strict date patterns) or that plans count on (AQE).

    Partition counts and memory stay with the cluster's own configuration.
    """
    # The few Python helpers travel with the plan, so executors need no copy of the package.
    if keepsake.__name__ not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(keepsake)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.legacy.timeParserPolicy", "CORRECTED")
    # Rows of whole texts: a batch of the default 10,000 takes a Python worker some hundred megabytes.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    # Folders are listed by as many tasks as there are cores, not by one task each: a listing of a thousand folders is short.
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(spark.sparkContext.defaultParallelism))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only in a single process (tests, a laptop) a temporary folder may take its place.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="keepsake-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current
