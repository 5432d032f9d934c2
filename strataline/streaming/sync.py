"""Structured Streaming: incremental sync into a keyed state, and event-time windows.

Windows, late-event handling and sessions are extensions; the sync is the polling of
changing sources, as micro-batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def newest_of_batch(batch: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """The newest row of each key; a null time is older than any other."""
    row = F.struct(*[F.col(c) for c in batch.columns])
    return batch.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(row, F.struct(F.col(time).isNotNull(), F.col(time))).alias("_r")).select("_r.*")


def _manifest(spark: SparkSession, path: str, batch_id: int) -> dict[str, int]:
    """Bucket to the batch that last wrote it, as of a batch."""
    if batch_id < 0:
        return {}
    return {r[0]: r[1] for r in spark.read.schema("bucket string, batch int").json(f"{path}/manifest/batch={batch_id}").collect()}  # a row a bucket


def read_state(spark: SparkSession, path: str, schema, batch_id: int) -> DataFrame:
    """The state as of a batch, without the rows that are kept only to mark a deletion."""
    folders = [f"{path}/batch={n}/bucket={b}" for b, n in _manifest(spark, path, batch_id).items()]
    folders = [f for f in folders if _exists(spark, f)]
    if not folders:
        return spark.createDataFrame([], schema)
    flag = spark.read.schema("deleted string").json(f"{path}/manifest/batch={batch_id}").agg(F.max("deleted")).first()[0]
    state = spark.read.schema(schema).parquet(*folders)
    return state.where(~F.coalesce(F.col(flag), F.lit(False))) if flag else state


def _exists(spark: SparkSession, folder: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def sync(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], time: str, deleted: str | None = None, buckets: int = 64, once: bool = True, keep_deleted: str | None = None) -> StreamingQuery:
    """Upserts of a change stream into a Parquet state of hash buckets; rows flagged ``deleted`` remove their key.

    A deletion stays in the state as a row of its own, so an older change of the key that
    arrives late does not bring it back; with ``keep_deleted``, such as ``INTERVAL 30 DAYS``,
    until its bucket gets a change that is newer by so much. ``read_state`` leaves these rows out.

    A micro-batch rewrites only the buckets that its keys fall into and writes them, and a
    manifest, under its own id, so a batch that runs again after a failure replaces its own
    work and nothing else: the result is the same.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = batch.schema
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string")
        new = newest_of_batch(batch, keys, time)
        manifest = _manifest(spark, path, batch_id - 1)
        touched = sorted(r[0] for r in new.select(bucket.alias("b")).distinct().collect())  # at most one row a bucket
        old = [f"{path}/batch={manifest[b]}/bucket={b}" for b in touched if b in manifest]
        old = [f for f in old if _exists(spark, f)]
        both = new.unionByName(spark.read.schema(schema).parquet(*old)) if old else new
        state = newest_of_batch(both, keys, time)
        if deleted and keep_deleted and (newest := batch.agg(F.max(time)).first()[0]) is not None:
            old_deletion = F.coalesce(F.col(deleted), F.lit(False)) & (F.col(time) < F.lit(newest) - F.expr(keep_deleted))
            state = state.where(~F.coalesce(old_deletion, F.lit(False)))
        state.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id}")
        manifest |= dict.fromkeys(touched, batch_id)
        rows = spark.createDataFrame(sorted(manifest.items()) or [("", -1)], "bucket string, batch int").where("batch >= 0").withColumn("deleted", F.lit(deleted))
        rows.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def tumbling_counts(events: DataFrame, time: str, width: str, late: str, by: Sequence[str]) -> DataFrame:
    """Counts per window and key; rows later than ``late`` behind the newest are dropped by the watermark of a stream."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    out = marked.groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), *by, "n")


def sliding_sums(events: DataFrame, time: str, width: str, slide: str, late: str, value: str, by: Sequence[str]) -> DataFrame:
    marked = events.withWatermark(time, late) if events.isStreaming else events
    out = marked.groupBy(F.window(time, width, slide), *by).agg(F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *by, "total")


def sessions(events: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    marked = events.withWatermark(time, late) if events.isStreaming else events
    out = marked.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def distinct_stream(events: DataFrame, time: str, keys: Sequence[str], late: str) -> DataFrame:
    """A stream without repeats of a key that come within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
