"""Session defaults. On a cluster the submit configuration wins; these only fill gaps."""

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cpus="8", shuffle_partitions=None, app="hydroq"):
    """A local session for tests and benchmarks; its scratch folder is removed at exit."""
    scratch = tempfile.mkdtemp(prefix="hydroq-ckpt-")
    atexit.register(shutil.rmtree, scratch, ignore_errors=True)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("HYDROQ_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", shuffle_partitions or cpus)
        .config("spark.checkpoint.dir", scratch)
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
