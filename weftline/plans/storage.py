"""Tables that cut lineage, written where every executor can read them.

Iterative operators write each round as Parquet into the folder that the
session names in ``spark.checkpoint.dir``: a lost executor then only costs the
tasks it was running. Nothing here uses executor-local storage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The setting by which a query's shuffle files go when it ends, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session.

    ``spark.checkpoint.dir`` as set; where it is unset, a temporary folder in
    local mode (tests), and an error on a cluster, as a folder of one machine
    would be lost with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="weftline-")
    context.setCheckpointDir(made)
    return context.getCheckpointDir().rstrip("/")


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def is_file(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _file_system(spark, path)
    return fs.exists(hadoop) and fs.getFileStatus(hadoop).isFile()


class Scratch:
    """A folder of written tables that belong to one run of one operator.

    ``keep`` writes a table and reads it back; ``drop`` and ``forget`` delete
    one that no later step reads. What is left is deleted when the session
    ends, as lazy results still read it. What a table's own plan shuffled is
    deleted as soon as it is written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.made = 0
        self.kept: list[tuple[DataFrame, str]] = []
        fs, path = _file_system(spark, self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def write(self, df: DataFrame, by: str | None = None) -> str:
        """Write a table, in folders by the values of a column where ``by`` names one."""
        self.made += 1
        path = f"{self.root}/{self.made:04d}"
        writer = df.write.option("compression", "zstd")
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            (writer.partitionBy(by) if by else writer).parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return path

    def read(self, schema, *paths: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def keep(self, df: DataFrame, by: str | None = None) -> DataFrame:
        path = self.write(df, by)
        made = self.read(df.schema, path)
        self.kept.append((made, path))
        return made

    def forget(self, *tables: DataFrame) -> None:
        """Delete tables that keep gave and no later step reads."""
        for table in tables:
            for entry in [e for e in self.kept if e[0] is table]:
                self.kept.remove(entry)
                self.drop(entry[1])

    def drop(self, path: str) -> None:
        fs, hadoop = _file_system(self.spark, path)
        fs.delete(hadoop, True)
