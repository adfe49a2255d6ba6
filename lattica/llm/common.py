"""Shared pieces of the corpus operators: reading tables, cutting lineage, Arrow row mapping, bounded samples.

Every operator selects only the columns it is told to use, so further columns, whatever their names, never clash with
the names that it makes itself.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. A local session that names none, as in tests, gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lattica-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written to the checkpoint folder: later reads survive the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables written to a folder of their own in the checkpoint folder and read again, which cuts their lineage; dropped by name."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.made = spark, f"{checkpoint_dir(spark)}/lattica-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.folder}/{self.made}"
        df.write.parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(found)] = path
        return found

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that keep() made; they must not be read any more."""
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(t)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Gives freed memory of this Python worker back to the system: idle workers of earlier tasks count against their executor too."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow, with batches of at most BATCH_ROWS rows in this session from here on: rows hold whole texts, and a batch must fit a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df.mapInArrow(run, schema)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """fn over each Arrow batch; rows are independent, so tasks can be run again anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out

    return in_arrow(df, run, schema)


_BUILT: dict[str, object] = {}


class Shared:
    """A model for Python workers: its plain state is broadcast, and each worker builds the model from it once.

    The state must be of bounded size, which is for the caller to see to.
    """

    def __init__(self, spark: SparkSession, state: object, build: Callable[[object], object]) -> None:
        self.state, self.build, self.key = spark.sparkContext.broadcast(state), build, uuid.uuid4().hex

    def get(self) -> object:
        if self.key not in _BUILT:
            _BUILT.clear()
            _BUILT[self.key] = self.build(self.state.value)
        return _BUILT[self.key]


def hash_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """At most `rows` rows of df: those with the smallest hash of key, the same at every run and at any partitioning.

    Only hashes are ordered; the wide rows are filtered by the last of them. Rows of equal key share a hash, so a final
    limit keeps the bound where one key fills the sample.
    """
    h = F.xxhash64(key)
    top = df.select(h.alias("h")).orderBy("h").limit(rows).agg(F.max("h").alias("h")).first()
    if top is None or top["h"] is None:
        return df.limit(0)
    return df.where(h <= F.lit(top["h"])).limit(rows)


def by_bytes(items: Sequence[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of items of at most `limit` bytes together, or of one item."""
    start, size = 0, 0
    for k, x in enumerate(items):
        if size and size + len(x) > limit:
            yield start, k
            start, size = k, 0
        size += len(x)
    if start < len(items):
        yield start, len(items)


def utf8(column: pa.Array) -> list[bytes]:
    """The bytes of each text of an Arrow string column; null is the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
