"""Continuous ingestion: fetched pages arrive as files and are merged into the catalog batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkloom.functions.urls import canonical_url, content_hash
from inkloom.session import read_if_there, store


def fetched_pages(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Fetches as they arrive, in canonical form and with a content hash; repeats within a day of event time drop out."""
    raw = spark.readStream.schema(schema).parquet(folder)
    shaped = raw.withColumns({"url": canonical_url("source_url"), "content_hash": content_hash(F.coalesce("markdown", F.lit("")))})
    return shaped.withWatermark("crawled_at", "1 day").dropDuplicatesWithinWatermark(["url", "content_hash"])


def fetches_per_hour(pages: DataFrame) -> DataFrame:
    """Fetches of each site by hour; late ones count until the watermark passes."""
    return pages.groupBy(F.window("crawled_at", "1 hour"), "site_host").agg(F.count(F.lit(1)).alias("fetches")).select(F.col("window.start").alias("hour"), "site_host", "fetches")


BUCKETS = 64  # of the catalog, by key; a batch rewrites those it has keys of


def merge_into(catalog: str, keys: list[str], order: str = "crawled_at"):
    """A batch writer that keeps the latest row of every key, whether it is stored already or in the batch.

    Late rows never replace newer ones, and a batch that is run again changes nothing.  Of two rows of one time the one
    with the greater content hash holds.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        placed = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        rows, stored = placed, read_if_there(spark, catalog)
        if stored is not None:
            touched = [r[0] for r in placed.select("bucket").distinct().collect()]  # BUCKETS at most
            rows = stored.where(F.col("bucket").isin(touched)).select(placed.columns).unionByName(placed) if touched else placed
        latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(order, "content_hash")).alias("row")).select("row.*")
        store(latest).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(catalog)

    return merge


def run_ingest(pages: DataFrame, catalog: str, checkpoint: str) -> StreamingQuery:
    return pages.writeStream.foreachBatch(merge_into(catalog, ["url"])).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
