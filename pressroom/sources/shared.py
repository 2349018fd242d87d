"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset a local folder serves a local session; a cluster has to set it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="pressroom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def mounted(spark: SparkSession) -> str | None:
    """A new folder in the shared one, as a path of the machine's own; None if the shared folder isn't one of files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def stored(df: DataFrame) -> DataFrame:
    """Writes df once to the shared folder and reads it again: lineage ends there, and losing executors doesn't lose it."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Grouped:
    """Tables bucketed by `by` and sorted inside a bucket: all rows of a key lie together, in order, and what groups, joins or
    ranks by the key needs no exchange. Their files are in the shared folder, their names in the session's catalogue until `drop`."""

    def __init__(self, spark: SparkSession, by: str, buckets: int):
        self.spark, self.by, self.buckets, self.names = spark, by, buckets, []

    def store(self, df: DataFrame, *order: str, dealt: bool = False) -> DataFrame:
        """dealt: df comes from tables of this kind, with no exchange between, so that it needn't be dealt again."""
        name = f"grouped_{uuid.uuid4().hex}"
        own = df if dealt else df.repartition(self.buckets, self.by)
        own.write.format("parquet").option("path", folder(self.spark)).bucketBy(self.buckets, self.by).sortBy(self.by, *order).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def drop(self, keep: int = 0) -> None:
        """Forgets all tables but the last `keep`."""
        gone, self.names = self.names[: len(self.names) - keep], self.names[len(self.names) - keep :]
        for name in gone:
            self.spark.sql(f"drop table if exists {name}")
