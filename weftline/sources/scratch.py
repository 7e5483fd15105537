"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: The folder of this process's tables by application, removed at exit.
_roots: dict[str, str] = {}
#: What Spark takes a table to need in memory, times its files' size.  Columns that repeat are some 80 times smaller in a file,
#: and by the size of the files alone tables of hundreds of MB are sent to the driver and broadcast.
FACTOR, TIMES = "spark.sql.sources.fileCompressionFactor", "100.0"

#: Spark's setting by which an execution removes its shuffle files at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Held while settings and _roots change; how many tables are being written, and SHUFFLE_CLEANUP before the first of them.
_lock, _writing = threading.RLock(), {"n": 0, "before": "false"}
#: on: this thread works on a step of together.
_within = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Where it is unset, a temporary one on a single machine; a cluster's
    executors would each write to their own disks, so there it is an error."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def remove(path: str, conf) -> None:
    """Deletes a folder of scratch files; conf is the session's Hadoop configuration."""
    from pyspark import SparkContext

    try:
        where = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may have ended; the files are scratch
        return


def scratch_root(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    with _lock:
        if app not in _roots:
            _roots[app] = f"{shared_dir(spark)}/weftline/linkage-{uuid.uuid4().hex}"
            atexit.register(remove, _roots[app], spark.sparkContext._jsc.hadoopConfiguration())
    return _roots[app]


def together(spark: SparkSession, *steps: Callable) -> list:
    """What the steps (functions without arguments) return, two worked on at once: jobs on small tables leave most of a cluster idle.

    Steps within a step take their turns, as each job under way costs the driver memory.  The first error is raised.
    """
    if getattr(_within, "on", False):
        return [step() for step in steps]

    def run(step: Callable):
        _within.on = True
        try:
            return step()
        finally:
            _within.on = False

    with ThreadPoolExecutor(2) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(run), step) for step in steps]
        return [x.result() for x in running]


def _cleaned(spark: SparkSession, begins: bool) -> None:
    """Sets SHUFFLE_CLEANUP while any table is being written."""
    with _lock:
        if begins and not _writing["n"]:
            _writing["before"] = spark.conf.get(SHUFFLE_CLEANUP, "false")
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        _writing["n"] += 1 if begins else -1
        if not _writing["n"]:
            spark.conf.set(SHUFFLE_CLEANUP, _writing["before"])


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back: later steps neither recompute it nor carry its plan, and a lost executor loses nothing.

    Its shuffle files go as soon as it is written.  The tables of a process are removed when it ends.  A session that leaves FACTOR at Spark's 1.0 gets TIMES from now on.
    """
    spark = df.sparkSession
    if float(spark.conf.get(FACTOR)) == 1.0:
        spark.conf.set(FACTOR, TIMES)
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _cleaned(spark, True)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        _cleaned(spark, False)
    return spark.read.schema(df.schema).parquet(path)
