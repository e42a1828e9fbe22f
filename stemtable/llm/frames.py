"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemtable.session import freed_shuffles
from stemtable.streaming.sinks import shared_folder

# The place of rows without an id: behind all others.
LAST_ID = 2**63 - 1


def released(run: Callable) -> Callable:
    """A function over Arrow batches that gives freed memory back to the system when its task ends.

    Workers are reused by later tasks and stages, and allocators keep what arrays have left behind.
    """

    def with_release(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return with_release


def shipped(spark: SparkSession, content) -> Callable:
    """Broadcast an object; the result opens it in a task.

    Broadcasts name the classes of their objects, and a worker that was started
    elsewhere does not find them.  Here they travel with the object, like the
    functions of this package.
    """
    data = spark.sparkContext.broadcast(cloudpickle.dumps(content))
    return lambda: pickle.loads(data.value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back.

    Cuts the lineage: what several later steps read is computed once, and a lost
    executor only repeats reading it.
    """
    return stored(df, name)[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``written``, and the folder, for tables that are ``removed`` before the session ends."""
    folder = shared_folder(df.sparkSession, name)
    with freed_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder that ``stored`` made, once no plan reads it any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small fixed table of literals, without Python on the executors."""
    if not rows:
        return spark.createDataFrame([], schema)
    names = [field.split()[0] for field in schema.split(", ")]

    def value(x) -> Column:
        return F.array(*[F.lit(y) for y in x]) if isinstance(x, list) else F.lit(x)

    structs = [F.struct(*[value(x).alias(n) for n, x in zip(names, row, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``id, text``, and other columns as they are; rows without id come last."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), "text", *more)


def text_mark(text: Column) -> Column:
    """A 64-bit hash of a text; with the id it is the key of a document."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit(1))


def packed(docs: DataFrame) -> DataFrame:
    """``id, text, row``: the other columns of ``docs`` in one struct, whatever they are called."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return texts(docs, F.struct(*others, F.lit(True).alias("_packed")).alias("row"))


def unpacked(df: DataFrame, columns: Sequence[str], **more: Column) -> DataFrame:
    """``columns`` of the documents that were ``packed``, then ``more``; a new one replaces one of its name."""
    kept = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in columns if c not in more]
    return df.select(*kept, *[c.alias(n) for n, c in more.items()])


def boxed(columns: Sequence[str]) -> Column:
    """The columns as one struct whose fields are numbered, so that no name can clash."""
    return F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.lit(True).alias("box"))


def unboxed(box: str, columns: Sequence[str], without: Sequence[str] = ()) -> list[Column]:
    """The columns that were ``boxed``, but for those that new ones replace."""
    return [F.col(box)[f"c{i}"].alias(c) for i, c in enumerate(columns) if c not in without]
