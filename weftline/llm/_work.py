"""Written intermediate tables, and joins and ranks that stay even when one key is hot."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting by which an execution removes its shuffle files at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Number of salts over which a hot key is dealt.
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a temporary one if driver and executors are one process; else an error, as executors would write to their own disks.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Work:
    """Tables of one run, written to the shared folder so that later steps read them
    rather than recompute them, and survive the loss of any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        atexit.register(self._remove, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read back.  Its shuffle files go as soon as it is written, as nothing reads them any more."""
        path, done = f"{self.root}/{name}", self.spark.conf.get(SHUFFLE_CLEANUP, "false")
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(SHUFFLE_CLEANUP, done)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        self._remove(f"{self.root}/{name}")

    def _remove(self, path: str) -> None:
        try:
            where = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.conf).delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended; the files are scratch
            return


def finished(spark: SparkSession, path: str) -> bool:
    """Whether Spark has written the table in path to its end."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def salt_of(*cols: Column | str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def ascii_lower(col: Column | str) -> Column:
    """A-Z to a-z and nothing else."""
    col = F.col(col) if isinstance(col, str) else col
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # Of plain ASCII the built-in function does just that, and sooner.
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, up, up.lower()))
