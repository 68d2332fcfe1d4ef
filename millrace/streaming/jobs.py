"""The ingest and usage jobs as Structured Streaming, with their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.snapshots import SnapshotStore


def read_stream(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n) by event time; on a stream, windows close when the watermark passes."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    return marked.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def click_through(impressions: DataFrame, clicks: DataFrame, within: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """Clicks at most `within` after their impression; late rows of either side are dropped on a stream."""
    i = impressions.select("query_id", "item_id", "pos", F.col("ts").alias("shown_at"))
    c = clicks.select(F.col("query_id").alias("c_query"), F.col("item_id").alias("c_item"), F.col("ts").alias("clicked_at"))
    if impressions.isStreaming:
        i, c = i.withWatermark("shown_at", late), c.withWatermark("clicked_at", late)
    near = (F.col("query_id") == F.col("c_query")) & (F.col("item_id") == F.col("c_item")) & (F.col("clicked_at") >= F.col("shown_at")) & (F.col("clicked_at") <= F.col("shown_at") + F.expr(f"INTERVAL {within}"))
    return i.join(c, near).select("query_id", "item_id", "pos", "shown_at", "clicked_at")


def click_rates(impressions: DataFrame, clicks: DataFrame, size: str = "1 day", within: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """(start, pos, shown, clicks, ctr): how often each position was shown and clicked, by the time it was shown.

    Impressions and the clicks that join them go through one windowed sum, so an impression with two clicks is shown once. On a
    stream a window is given out when its last impressions can have no more clicks.
    """
    joined = click_through(impressions, clicks, within, late).select("shown_at", "pos", F.lit(0).alias("shown"), F.lit(1).alias("clicked"))
    shown = impressions.select(F.col("ts").alias("shown_at"), "pos", F.lit(1).alias("shown"), F.lit(0).alias("clicked"))
    if impressions.isStreaming:
        shown = shown.withWatermark("shown_at", late)
    sums = shown.unionByName(joined).groupBy(F.window("shown_at", size).alias("w"), "pos").agg(F.sum("shown").alias("shown"), F.sum("clicked").alias("clicks"))
    return sums.select(F.col("w.start").alias("start"), "pos", "shown", "clicks", F.bround(F.col("clicks") / F.col("shown"), 6).alias("ctr"))


def first_seen(rows: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Repeats across batches go; on a stream within the watermark."""
    if rows.isStreaming:
        return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return rows.dropDuplicates(keys)


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there and stops; a restart adds nothing."""
    df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def ingest(raw: DataFrame, mapper, store: SnapshotStore, checkpoint: str, gate=None, as_of=None, source: str = "stream") -> DataFrame:
    """Raw rows to items to gates to an upsert per micro-batch; the result is the store's ledger, one row a batch.

    A batch is mapped once, and counted while it is staged and joined. The store names the batches it holds, so a job that died between the
    store and the checkpoint does not apply one twice.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        store.upsert(mapper(batch), batch_id, source, ok=gate, as_of=as_of)

    raw.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return store.ledger()
