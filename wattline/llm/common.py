"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a null document id inside the operators; it sorts first.
NO_ID = -(2**63)


#: Rows that a Python worker holds at once; texts are wide, so the default of 10,000 would be tens of MB in every copy.
ROWS_AT_ONCE = 2000
#: And bytes, where `hold_few_bytes` asks for it.
BYTES_AT_ONCE = 8_000_000


def hold_few_rows(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))


def hold_few_bytes(spark: SparkSession) -> None:
    """Batches of a few MB too, for long jobs: a batch lies in the JVM and in its worker, and both keep what they once had."""
    hold_few_rows(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_AT_ONCE))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    hold_few_rows(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only in local mode where none is configured (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wattline-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of steps that are done and that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    release(spark)
    df.write.parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.step_path = path
    return out


def discard(*steps: DataFrame) -> None:
    """Delete what materialise wrote; only for steps that every reader has read and written on."""
    for step in steps:
        context = step.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(step.step_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def id_column(docs: DataFrame, name: str) -> Column:
    """A document's id as a whole number; ids of other types count, and are ordered, by a 64-bit hash. Null, like -2^63, is NO_ID."""
    whole = isinstance(docs.schema[name].dataType, T.IntegralType)
    own = F.col(name).cast("long") if whole else F.when(F.col(name).isNotNull(), F.xxhash64(name))
    return F.coalesce(own, F.lit(NO_ID))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as set them apart from all columns, upper and lower case alike."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def text_column(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def utf8_parts(column: pa.Array, most: int = 1_000_000):
    """Slices of a string array of about `most` bytes each: (first row, bytes, offsets)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TYPES = {"long": T.LongType, "int": T.IntegerType, "string": T.StringType, "boolean": T.BooleanType, "double": T.DoubleType, "binary": T.BinaryType}


def schema(fields: str) -> T.StructType:
    """`name type, name type`, without a running session; a type in <> is an array's."""
    out = T.StructType()
    for field in fields.split(","):
        name, kind = field.split()
        out.add(name, T.ArrayType(_TYPES[kind[1:-1]]()) if kind[0] == "<" else _TYPES[kind]())
    return out
