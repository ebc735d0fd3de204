"""What the operators ask of a Spark session."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def give_back() -> None:
    """Returns freed memory to the machine: Python workers live on from stage to stage, and what the allocators hold would add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it has no such call
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` over the batches of a task, after which the worker holds no memory of it."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def by_key(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each run of equal keys, of batches that are sorted by the key columns (which hold no null)."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
        change = np.ones(b.num_rows, bool)
        change[1:] = False
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        at = np.append(np.flatnonzero(change), b.num_rows).tolist()
        for i, j in zip(at[:-1], at[1:], strict=True):
            now = tuple(c[i].item() for c in columns)
            if now != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(b.slice(i, j - i))
    if held:
        yield key, pa.Table.from_batches(held)


def checkpoint_place(spark: SparkSession) -> str:
    """The shared folder spark.checkpoint.dir; only on one machine (a local master, as in tests) a temporary one where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            place = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(place)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared checkpoint folder."""
    checkpoint_place(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """Like ``checkpointed``, but as a compressed table with a known life: the rows, and a function that deletes them."""
    spark = df.sparkSession
    sc = spark.sparkContext
    path = f"{checkpoint_place(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)

    def drop() -> None:
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)

    return spark.read.schema(df.schema).parquet(path), drop


def bounded_batches(spark: SparkSession) -> None:
    """Batches of 8 MB between Spark and Python, unless the session asks for a size of its own: long texts then cost no more memory than short ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64MB", "67108864"):
        spark.conf.set(name, "8m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, by: int):
    """crc32 of the column as text, modulo ``by``; -1 for null, which belongs to no fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(by), F.lit(-1))


def labelled(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """One row per labelled id with ``y`` 0 or 1; null labels and ids whose rows disagree are left out."""
    return (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label).alias("y"), F.max(label).alias("top"))
        .where("y = top")
        .select("id", F.col("y").cast("int").alias("y"))
    )


def bounded_sample(rows: DataFrame, limit: int) -> DataFrame:
    """``limit`` rows at most, chosen by a hash of their id: the same rows on every run."""
    return rows.orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(limit)


def sampled_texts(docs: DataFrame, chosen: DataFrame, limit: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``y`` and ``t`` (bytes) of the chosen rows (id, y), ``limit`` bytes of text at most together.

    An id with several texts gives the one with the least hash.  Texts over a
    64th of the limit are left out, then ids by the order of ``bounded_sample``
    once the limit is reached, so what comes to the driver is bounded in bytes
    and the same on every run.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).join(F.broadcast(chosen), "id").withColumn("h", F.xxhash64("t"))
    sized = rows.groupBy("id").agg(F.min(F.struct(F.col("h").alias("h"), F.octet_length("t").alias("size"))).alias("f")).select("id", "f.h", "f.size").where(F.col("size") <= limit // 64)
    running = Window.orderBy(F.xxhash64(F.lit("sample"), "id"), "id").rowsBetween(Window.unboundedPreceding, 0)  # over no more rows than were chosen
    kept = sized.withColumn("total", F.sum("size").over(running)).where(F.col("total") <= limit).select("id", "h")
    return rows.join(F.broadcast(kept), ["id", "h"]).dropDuplicates(["id"]).select("id", "y", "t")


def cpu_parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


__all__ = ["bounded_batches", "bounded_sample", "by_key", "checkpoint_place", "checkpointed", "cpu_parallelism", "give_back", "labelled", "lean", "remainder", "sampled_texts", "stored", "table"]
