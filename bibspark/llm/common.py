"""What the training-data operators share: reading tables, joins of bounded size, component labelling."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialize, scratch_dir

__all__ = ["bounded_batches", "connected_components", "discard", "give_back", "join_sliced", "materialize", "resident", "scratch_dir", "small", "table", "vacate"]
Made = TypeVar("Made")
#: Rows and bytes of a side up to which it is broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
#: Rows of one key that a task of a sliced join gets of its large side, about.
SLICE_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of long texts stay small, so a Python worker's memory doesn't follow the texts' length times rows.

    These settings count when a query runs, not when it is made, so the session keeps them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


_resident: dict[object, object] = {}


def resident(key: object, make: Callable[[], Made]) -> Made:
    """What make() returned for key. A Python worker, which outlives a stage, keeps one such object at a time."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def give_back() -> None:
    """Return freed memory to the system; else a worker keeps its largest task's memory through the stages that follow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


def vacate() -> None:
    """A task that needs its worker's memory for its own rows frees what an earlier stage has left there."""
    _resident.clear()
    give_back()


def discard(*tables: DataFrame, collect: bool = True) -> None:
    """Delete scratch tables once all that was built on them is written; with collect, shuffle files of finished steps
    that the driver no longer refers to go as well."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_scratch", None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if tables and collect:
        tables[0].sparkSession._jvm.System.gc()


def _bytes(f: T.StructField) -> F.Column:
    if isinstance(f.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) + 16
    if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.octet_length(F.to_json(F.struct(f.name))) + 16
    return F.lit(8)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its rows and bytes, which are measured, stay within the bounds; else df for a shuffle join."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(sum((_bytes(f) for f in df.schema), F.lit(0))), F.lit(0))).first()
    return F.broadcast(df) if n <= (rows or BROADCAST_ROWS) and size <= BROADCAST_BYTES else df


def join_sliced(left: DataFrame, right: DataFrame, key: str, by: str, slice_rows: int = SLICE_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """left joined to right on a key that may hold any share of left's rows.

    Keys with more than slice_rows rows of left are dealt over slices by the column by, and their rows of right are sent
    to each slice. There are at most rows / slice_rows such keys. counts has (key, rows); else left's rows are counted.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("rows")) if counts is None else counts
    hot = materialize(counts.where(F.col("rows") > slice_rows).select(key, F.ceil(F.col("rows") / slice_rows).alias("slices")), "hot")
    if hot.isEmpty():
        return left.join(right, key)
    hot, one = small(hot), F.coalesce("slices", F.lit(1).cast("long"))
    dealt = left.join(hot, key, "left").withColumn("slice", F.pmod(F.xxhash64(by), one)).drop("slices")
    copied = right.join(hot, key, "left").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).drop("slices")
    return dealt.join(copied, [key, "slice"]).drop("slice")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of the edge table with the smallest node it can reach.

    Alternating large-star and small-star steps (Kiveris et al. 2014) over narrow edge rows. Each step is written to
    the shared folder, and the last but one is deleted; the driver sees two numbers a step. A node with many edges is met
    as rows of two numbers, which Spark's skew joins split. An empty edge table gives an empty result. Self edges count
    only for listing their node.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    nodes = materialize(both.select("u").union(both.select("v")).where("u is not null").distinct(), "nodes")
    links = materialize(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        mirrored = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = mirrored.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = mirrored.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small_star = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        before, links = links, materialize(small_star.where("u <> v").distinct(), "links")
        discard(before, large, collect=False)
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            break
        seen = now
    return nodes.join(links.withColumnRenamed("u", "node"), nodes["u"] == F.col("node"), "left").select(nodes["u"].alias("node"), F.coalesce("v", nodes["u"]).alias("component"))
