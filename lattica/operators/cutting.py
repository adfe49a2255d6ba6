"""Cutting the lineage of iterations in the shared folder that the cluster names, and giving the space back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A local session that names none, as in tests, gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lattica-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Workspace:
    """A folder of its own in the shared folder: tables written there and read again, which cuts their lineage, until they are dropped."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.made = spark, f"{shared_folder(spark)}/work-{uuid.uuid4().hex}", 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def path(self) -> str:
        self.made += 1
        return f"{self.folder}/{self.made}"

    def keep(self, df: DataFrame, **options: str) -> DataFrame:
        path = self.path()
        df.write.options(**options).parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(found)] = found, path
        return found

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables that keep() made, and passes over others; they must not be read any more."""
        for t in tables:
            if t is not None and id(t) in self.paths:
                self.remove(self.paths.pop(id(t))[1])

    def free(self) -> None:
        """Deletes all that is left."""
        self.paths.clear()
        self.remove(self.folder)

    def remove(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
