"""Tables that an operator writes and reads again, in the folder that the cluster shares.

They cut lineage: a lost executor costs a re-read, not a re-run of all that came before. The folder is
``spark.checkpoint.dir``. A session in one process (``local`` masters, as in tests) that doesn't set it gets a
local one; on a cluster a local folder would lose rows, so there its absence is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Lets Spark delete a write's shuffle files as soon as the write is over.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The shared folder's path, without a closing slash."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        path = _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="quillgrid-"))
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{folder(spark)}/quillgrid/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write ``df`` as Parquet; the shuffle files that it took are deleted afterwards."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.mode(mode).parquet(path)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    write(df, path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path that this module gave out."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Steps:
    """Kept tables of one job, by name, that can be dropped once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = new_path(self.spark, name)
        write(df, self.paths[name])
        return self.spark.read.schema(df.schema).parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        for name in names:
            drop(self.spark, self.paths.pop(name))
