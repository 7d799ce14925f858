"""What the operators share: the shared folder, lineage cuts, text helpers."""

from __future__ import annotations

import ctypes
import gc
import uuid
import zlib

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used where no folder is set and all tasks run on the driver's machine.
LOCAL_SHARED = "file:///tmp/checkpoints"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; our own only where none is set and the master is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or LOCAL_SHARED).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the session's file system closes."""
    path = f"{shared_dir(spark)}/plazalake-{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    Cuts the lineage so that a lost executor costs a re-read, not a recomputation.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that cut() made and nothing needs any more."""
    spark = table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if path.rsplit("/", 1)[-1].startswith("plazalake-"):
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of one key that a join leaves to one task, and keys with more that are broadcast, 16 bytes each.
HOT, HOT_KEYS = 1 << 20, 200_000


def join_hot(many: DataFrame, one: DataFrame, key: str, sizes: DataFrame | None = None) -> DataFrame:
    """many joined with the row that `one` has for its key; rows of a key that has over HOT are dealt to several tasks.

    sizes holds the key and n, its number of rows in many; it is counted if not given.
    """
    if sizes is None:
        sizes = many.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = sizes.where(F.col("n") > HOT).select(key, F.ceil(F.col("n") / HOT).cast("int").alias("_parts"))
    n_hot = hot.count()
    if not n_hot:
        return many.join(one, key)
    if n_hot <= HOT_KEYS:
        hot = F.broadcast(hot)
    parts = F.coalesce("_parts", F.lit(1))
    left = many.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(*many.columns), parts).cast("int")).drop("_parts")
    right = one.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [key, "_part"]).drop("_part")


_slot: dict = {}


def hold(key, make):
    """What make() gives, kept in a worker between tasks until something else is held.

    A worker runs the stages of many operators, one after the other; only the
    vocabulary, model or cache of the one it works on stays in memory.
    """
    if key not in _slot:
        _slot.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)
        _slot[key] = make()
    return _slot[key]


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def crc_fold(doc_id, parts: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts


def slices(batches, text_index: int, most_bytes: int = 8 << 20):
    """Split Arrow batches so that the text of a slice stays near most_bytes; a longer text stands alone."""
    for batch in batches:
        texts, begin, held = batch.column(text_index), 0, 0
        for i, size in enumerate(pa.compute.binary_length(texts).to_pylist()):
            if i > begin and held + (size or 0) > most_bytes:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size or 0
        if batch.num_rows > begin:
            yield batch.slice(begin)
