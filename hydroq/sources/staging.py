"""Intermediate tables in the shared folder of the session."""

import atexit
import os
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

_STAGED = {}  # application id: (session, paths)


def shared_folder(spark):
    """The folder named by spark.checkpoint.dir. A local master without one gets a temporary folder, removed at exit."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        base = tempfile.mkdtemp(prefix="hydroq-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
        return base
    raise ValueError("spark.checkpoint.dir is not set; name a folder that all executors can reach")


def scratch_dir(spark, name):
    """A fresh folder below the shared one."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def stage(df, name):
    """Write a reduced frame to the shared folder and read it back.

    The lineage ends at the files, so a lost executor costs no recomputation, and the planner knows
    the real size: it broadcasts the table in later joins only below its broadcast limit and falls
    back to a shuffled join above it. The files stay until ``release`` or the end of the driver.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    key = spark.sparkContext.applicationId
    if key not in _STAGED:
        _STAGED[key] = (spark, [])
        atexit.register(_forget, key)
    _STAGED[key][1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_all(frames):
    """Stage several independent frames at the same time; returns them by name."""
    with ThreadPoolExecutor(max_workers=len(frames)) as pool:
        staged = {name: pool.submit(stage, frame, name) for name, frame in frames.items()}
        return {name: job.result() for name, job in staged.items()}


def release(spark):
    """Delete the staged tables of this application; call it when the results made of them are written."""
    _, paths = _STAGED.get(spark.sparkContext.applicationId, (None, []))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def _forget(key):
    spark, _ = _STAGED.get(key, (None, []))
    try:
        if spark is not None and spark.sparkContext._jsc is not None:
            release(spark)
    except Exception:  # the driver's JVM may be gone; the files lie below the folder the cluster named
        pass
