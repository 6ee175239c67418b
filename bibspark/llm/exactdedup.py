"""Operator 6, exact deduplication as a stateful stream.

Documents arrive as a file stream. Keyed state in RocksDB, which never expires, keeps for each digest the stable
identifier (the largest doc_id), the count, and the content locator (the file and the id of the row that holds the
bytes). Rows whose digest has been seen are hits. The locator finds the bytes that the state stands for, and each hit's
bytes are compared with them in full before the state's answer holds for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import join_sliced, materialize, scratch_dir, small, table

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: no preallocated log files
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Micro-batches that a table is read in at least (if it has so many rows), and at most: rows of a file, files of a batch.
BATCHES, ROWS_PER_FILE, FILES_PER_BATCH = 3, 10_000_000, 10_000
#: Rows of a digest that one task meets in the joins to the state; a digest of more is dealt over several.
DEALT_ROWS = 100_000


def with_digest(docs: DataFrame) -> DataFrame:
    """Null texts count as empty; nothing else is changed. docs is read from Parquet: file and row are the row's own."""
    text = F.coalesce("text", F.lit(""))
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"), F.col("_metadata.file_path").alias("file"), F.xxhash64(place).alias("place"))


def digest_state(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """(digest, keep_id, group_size, keep_file) of all rows of a Parquet table, met as a stream to its end.

    Digests, ids and files, without texts, are written first, in files of so many rows that any table of BATCHES rows or
    more comes in BATCHES batches or more: rows meet the state of earlier ones whatever files the table has, and a batch
    is bounded. Rows are combined per task before they reach the state, so a text with a third of all rows costs a row a
    task. The stream checkpoint and each batch's changed keys are in the shared folder; a batch that is run again
    overwrites its own output, and the last version of a key is the one with the largest count.
    """
    at = scratch_dir(spark)
    docs = spark.read.schema(schema).parquet(path)
    per_file = min(ROWS_PER_FILE, max(1, -(-docs.count() // BATCHES)))
    with_digest(docs).select("doc_id", "digest", "file").write.option("maxRecordsPerFile", per_file).parquet(f"{at}/keys")
    keys = spark.read.parquet(f"{at}/keys")
    if files_per_batch is None:
        files_per_batch = min(FILES_PER_BATCH, max(1, len(keys.inputFiles()) // BATCHES))
    old = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(keys.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{at}/keys")
        state = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.max_by("file", F.coalesce("doc_id", F.lit(-(2**63)))).alias("keep_file"))
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{at}/checkpoint")
            .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{at}/changes/batch={i}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    changes = spark.read.schema(f"digest binary, keep_id {schema['doc_id'].dataType.simpleString()}, group_size long, keep_file string, batch int").parquet(f"{at}/changes")
    return changes.groupBy("digest").agg(F.max_by(F.struct("keep_id", "group_size", "keep_file"), "group_size").alias("s")).select("digest", "s.*")


def classes_of_hits(docs: DataFrame, state: DataFrame) -> DataFrame:
    """(digest, classes): the hits of each digest by their full bytes, the class of the stored bytes first.

    The locator says which row holds the stored bytes: it and the hits, combined per task, meet by digest and bytes. More
    than one class means a collision. It is an error if no row is where the state's locator says, or if the hits aren't
    as many as the state has counted.
    """
    hits = state.where("group_size > 1").select("digest", F.col("keep_id").alias("at_id"), F.col("keep_file").alias("at_file"), F.col("group_size").alias("counted"))
    few = small(hits)
    rows = with_digest(docs)
    rows = rows.join(few, "digest") if few is not hits else join_sliced(rows, hits, "digest", "place", DEALT_ROWS, hits.select("digest", F.col("counted").alias("rows")))
    stored = F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("file") == F.col("at_file"))
    by_bytes = rows.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.max(stored).alias("stored"), F.max("counted").alias("counted"))
    one = F.struct((~F.col("stored")).alias("other"), F.md5("text").alias("text_key"), "keep_id", "group_size")
    classes = by_bytes.groupBy("digest").agg(F.sort_array(F.collect_list(one)).alias("c"), F.max("stored").alias("found"), F.sum("group_size").alias("n"), F.max("counted").alias("counted"))
    lost = F.raise_error(F.concat(F.lit("the state is of another table: digest "), F.hex("digest")))
    return classes.select("digest", F.when(F.col("found") & (F.col("n") == F.col("counted")), F.col("c")).otherwise(lost.cast(classes.schema["c"].dataType)).alias("c"))


def deduplicate(docs: DataFrame, state: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs, which is read from the table of the state.

    Of equal texts the row with the largest doc_id stays; rows without a doc_id stay only if no row of the group has
    one, and rows that repeat the largest doc_id all count as staying. An empty table gives no rows. The state decides
    for each digest; only where the bytes of hits differ from the stored ones do the classes of bytes stand in for it.
    """
    checked = materialize(classes_of_hits(docs, state), "hits")
    split = checked.where("size(c) > 1").select("digest", F.explode("c").alias("c")).select("digest", "c.text_key", "c.keep_id", "c.group_size")
    split = materialize(split, "split")
    whole = state.join(small(split.select("digest").distinct()), "digest", "left_anti").select("digest", F.lit(None).cast("string").alias("text_key"), "keep_id", "group_size")
    rows = with_digest(docs).select("doc_id", "digest", "place", F.md5("text").alias("own_key"))
    counts = state.select("digest", F.col("group_size").alias("rows"))
    joined = join_sliced(rows, whole.unionByName(split), "digest", "place", DEALT_ROWS, counts).where("text_key is null or text_key = own_key")
    return joined.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return deduplicate(docs, materialize(digest_state(spark, f"{sf_dir}/documents.parquet", docs.schema, files_per_batch), "state"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
