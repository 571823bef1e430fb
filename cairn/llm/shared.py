"""What the operators share: the folder that driver and executors share, written tables, and Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

#: Bytes of text that a task works on at a time; a longer text comes alone.
BATCH_BYTES = 1 << 20
#: Rows that Spark hands to a Python worker at a time, by small_batches.
BATCH_ROWS = 512
ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a new temporary one is set in a local session, and a cluster is refused: its executors do not share such a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: the operators need a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cairn/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Sets Spark's Arrow batches to BATCH_ROWS rows in this session, unless it has a size of its own. By default they have 10,000 rows, so that a whole input split of texts stands in one batch, in the executor and again in its Python worker."""
    if spark.conf.get(ROWS_SETTING, None) is None:
        spark.conf.set(ROWS_SETTING, str(BATCH_ROWS))


def give_back() -> None:
    """Returns the memory that this Python worker has freed to the system. Workers are reused, and without this a stage's freed memory counts beside the next stage's."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut by bytes of one string column, so that memory follows neither the row count nor the longest batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = size.cumsum() // limit
        start = 0
        for i in range(1, len(at) + 1):
            if i == len(at) or at[i] != at[start]:
                yield batch.slice(start, i - start)
                start = i


def carried(docs: DataFrame, run, names: dict[str, str]) -> DataFrame:
    """All columns of docs with what run(text column) returns for each batch beside them, as the columns `names` (to type); a column of that name gives way. After each of Spark's batches freed memory goes back to the system."""
    kept = [f for f in docs.schema.fields if f.name not in names or f.name == "text"]
    out = [f for f in kept if f.name not in names]

    def each(batches):
        for whole in batches:
            for batch in slices(iter([whole])):
                new = run(batch.column("text"))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in out), *new], names=[*(f.name for f in out), *names])
                del batch, new
            del whole
            give_back()

    ddl = StructType([*out, *(StructField(n, StructType.fromDDL(f"x {t}")["x"].dataType) for n, t in names.items())])
    return docs.select(*(f.name for f in kept)).mapInArrow(each, ddl)
