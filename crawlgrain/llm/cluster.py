"""What the operators need of the cluster: durable cuts of lineage and sizes."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgrain.cuts import durable  # noqa: F401  (operators take it from here)
from crawlgrain.cuts import shared_folder as checkpoint_dir

#: A side of a join is broadcast up to so many bytes, by a count of its rows.
BROADCAST_BYTES = 32 << 20
#: Bits of the filter that stands in for a larger side: 32 MB at most.
FILTER_BITS = 28
_PAGE_BITS = 15  # of one row of Spark's bitmaps


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate data."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame) -> DataFrame:
    """The rows, as a Parquet table in the shared folder."""
    return written_to(df)[0]


def written_to(df: DataFrame) -> tuple[DataFrame, str]:
    """written(), and the table's path, for removed() once nothing reads it any more."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def small(df: DataFrame, row_bytes: int, limit: int | None = None) -> bool:
    """Whether a side of a join, counted, is within the bound of a broadcast."""
    return df.count() * row_bytes <= (BROADCAST_BYTES if limit is None else limit)


def parted(df: DataFrame, keys: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is surely not among keys, rows whose key may be), by a filter of bounded size.

    keys has one column, of longs that are hashes or spread like them; nulls match
    nothing. The filter is a bitmap of at most 2 ** FILTER_BITS bits, joined by
    broadcast in pages; rows aren't shuffled.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS)).cast("long")
    name = keys.columns[0]
    placed = keys.select(place(F.col(name)).alias("_place"))
    pages = placed.groupBy(F.shiftright("_place", _PAGE_BITS).alias("_page")).agg(F.bitmap_construct_agg(F.col("_place").bitwiseAND(F.lit((1 << _PAGE_BITS) - 1))).alias("_bits"))
    byte = F.expr(f"cast(conv(hex(substring(_bits, cast(shiftright(_at & {(1 << _PAGE_BITS) - 1}, 3) as int) + 1, 1)), 16, 10) as int)")
    hit = F.coalesce(F.call_function("shiftright", byte, F.expr("cast(_at & 7 as int)")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    marked = df.withColumn("_at", place(key)).join(F.broadcast(pages), F.shiftright("_at", _PAGE_BITS) == F.col("_page"), "left").withColumn("_hit", hit).drop("_at", "_page", "_bits")
    return marked.where(~F.col("_hit")).drop("_hit"), marked.where("_hit").drop("_hit")


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a text column over all rows."""
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_groups(batches: Iterator[pa.RecordBatch], column: str, rows: int) -> Iterator[pa.Table]:
    """Tables of at least about `rows` rows, but the last, that cut no run of equal values of `column`."""
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows >= rows:
            n = pc.index(held.column(column), held.column(column)[held.num_rows - 1]).as_py()
            if n:
                yield held.slice(0, n).combine_chunks()
                held = held.slice(n)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Gives what a Python worker, which lives on, has freed back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidied(task: Task) -> Task:
    """The task, which gives back what it has freed at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()

    return run
