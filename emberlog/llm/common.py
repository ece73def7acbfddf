"""Helpers shared by the corpus operators: shared scratch tables and Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch are handled in slices of about so many bytes of text.
SLICE_BYTES = 4 << 20
#: Bytes of the batches that Spark sends to Python; JVM and worker hold one each.
BATCH_BYTES = "8m"


_made: list["Scratch"] = []


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by BATCH_BYTES in this session, unless it sets a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


class Scratch:
    """Written tables in the folder that the cluster names in ``spark.checkpoint.dir``.

    A table cuts the lineage, survives the loss of any executor and keeps column
    pruning.  Where the setting is absent, a folder of this machine is used in local mode
    only, as driver and executors are then one process; on a cluster that is an error.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.gettempdir() + "/emberlog-checkpoints"
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        _made.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete a table, or without a name all of them, when no later plan reads it."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let Spark's cleaner delete the shuffle files of finished steps now, not at some later collection."""
        gc.collect()
        self.spark._jvm.System.gc()


def sweep(kept: Scratch) -> None:
    """Delete the tables of all scratch folders made since ``kept``: what they led to is written."""
    at = _made.index(kept) + 1
    for scratch in _made[at:]:
        scratch.drop()
    del _made[at:]


_held: dict[tuple, object] = {}


def held(key: tuple, make):
    """What ``make`` gives, kept by a worker until it is asked for something else.

    Workers serve one operator after another; only the last one's tables stay in memory.
    """
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Drop what a worker holds for another operator, and give the memory back to the system."""
    if _held:
        _held.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Return freed memory to the system: an idle worker counts against its executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, column: str, tables: bool = False):
    """Cut record batches so that ``column`` holds about SLICE_BYTES in each piece.

    Tasks that use no tables of ``held`` first drop those of the operator before.
    """
    if not tables:
        let_go()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column(batch.schema.get_field_index(column)).nbytes
        step = max(1, int(batch.num_rows * SLICE_BYTES / max(size, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    batch = None
    give_back()


def replaced(batch: pa.RecordBatch, drop: list[str], add: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch without the columns ``drop`` and with the columns ``add`` at its end."""
    keep = [n for n in batch.schema.names if n not in drop and n not in add]
    return pa.RecordBatch.from_arrays(
        [batch.column(batch.schema.get_field_index(n)) for n in keep] + list(add.values()),
        names=keep + list(add),
    )
