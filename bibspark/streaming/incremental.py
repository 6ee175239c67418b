"""Incremental jobs: what is still to be done, and papers as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.library import DEFAULTS, dense_number

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def pending(inputs: DataFrame, outputs: DataFrame, overwrite: bool = False) -> DataFrame:
    """Inputs without an output of their stem; all of them if overwriting."""
    return inputs if overwrite else inputs.join(outputs.select("stem").distinct(), "stem", "left_anti")


def as_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1_000) -> DataFrame:
    """A Parquet file or folder as a file stream. The path is given as a pattern, which may name either."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their keys in RocksDB, with bounded memory."""
    old = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def first_arrivals(stream: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The rows of keys that no earlier batch had, one a key: of a batch's rows the first by order.

    The state holds a key, the batches' times in which it came first and last, and its row; it never expires. A key whose
    two times differ was there before. Rows are combined per task before they reach the state. Null keys are left out.
    """
    row = F.min_by(F.struct(*stream.columns), F.struct("__now", *order, F.xxhash64(*stream.columns)))
    timed = stream.where(F.col(key).isNotNull()).withColumn("__now", F.current_timestamp())
    seen = timed.groupBy(key).agg(F.min("__now").alias("__first"), F.max("__now").alias("__last"), row.alias("__row"))
    return seen.where("__first = __last").select("__row.*")


def _run(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> None:
    with keyed_state(stream.sparkSession):
        stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def process_pending(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, overwrite: bool = False, outputs: DataFrame | None = None) -> None:
    """Run step on items (with stem) as they arrive, skipping those that have an output; to the stream's present end.

    Stems that came before are known from keyed state, in the checkpoint; outputs that were there at the start, if any, are
    a table with stem. No batch reads what another has written. A batch writes its own folder, so one that is run again
    after a failure replaces itself; of rows that share a stem it then takes the same one again (the first by a hash of
    the row). With overwrite, a stem that comes again is run again.
    """
    todo = stream if outputs is None or overwrite else pending(stream, outputs)
    new = todo if overwrite else first_arrivals(todo, "stem", ())

    def batch(df: DataFrame, i: int) -> None:
        one = df
        if overwrite:
            first = Window.partitionBy("stem").orderBy(F.xxhash64(*df.columns))
            one = df.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
        step(one).write.mode("overwrite").parquet(f"{out}/batch={i}")

    _run(new, batch, checkpoint, "append" if overwrite else "update")


def ingest_papers(stream: DataFrame, library: DataFrame, out: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Insert-or-ignore of papers (title, pos, ...) as they arrive: the first title wins, ids continue.

    Titles that came before are known from keyed state. A batch reads one number, the largest id before it, and writes its
    new papers to {out}/papers and the largest id after it to {out}/top, each in a folder of its own, so a batch that is
    run again gives the same ids. library holds the papers that are there at the start (it may be empty); its columns are
    the ones kept.
    """
    spark, columns = stream.sparkSession, [c for c in library.columns if c != "paper_id"]
    known = library.select("title").where("title is not null").distinct()

    def batch(df: DataFrame, i: int) -> None:
        before = spark.read.parquet(f"{out}/top/batch={i - 1}") if i else library.agg(F.coalesce(F.max("paper_id"), F.lit(0)).cast("long").alias("top"))
        top = before.first().top
        new = dense_number(df, "pos", "n").select((F.col("n") + top).alias("paper_id"), *columns)
        new = new.fillna({k: v for k, v in DEFAULTS.items() if k in columns})
        new.write.mode("overwrite").parquet(f"{out}/papers/batch={i}")
        spark.read.parquet(f"{out}/papers/batch={i}").agg(F.coalesce(F.max("paper_id"), F.lit(top)).alias("top")).write.mode("overwrite").parquet(f"{out}/top/batch={i}")

    arrived = prepare(stream).select("pos", *columns)
    _run(first_arrivals(arrived.join(known, "title", "left_anti"), "title", ("pos",)), batch, checkpoint, "update")


def library_of(spark: SparkSession, out: str) -> DataFrame:
    """The papers that were ingested."""
    return spark.read.parquet(f"{out}/papers").drop("batch")


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, stage, runs, elapsed): run records as windowed totals; on a stream, state older than the watermark goes."""
    return events.withWatermark("started_at", late).groupBy(F.window("started_at", window).alias("w"), "stage").agg(F.count("*").alias("runs"), F.sum("elapsed_seconds").alias("elapsed")).select(F.col("w.start").alias("start"), "stage", "runs", "elapsed")
