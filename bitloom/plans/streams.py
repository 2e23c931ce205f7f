"""Streaming queries: the tables read as streams, and the batch SQL that states the same result."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.operators import gaps as G
from bitloom.sources.tables import scratch
from bitloom.streaming.blocks import stream_blocks


def _folder(spark) -> str:
    return scratch(spark, "stream")


def _table_stream(spark, sf: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]*")


def _drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all there is and read what it wrote."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)
    sink = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def text_blocks(spark, sf) -> DataFrame:
    """Documents as a stream of 256-byte chunks in blocks of eight, with a watermark."""
    docs = _table_stream(spark, sf, "documents")
    size = F.octet_length(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    rows = docs.select(F.col("doc_id").alias("k"), size.alias("total")).where("total > 0")
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / 256))))
    part = F.least(F.lit(256), F.col("total") - F.col("chunk") * 256)
    chunks = rows.select("k", F.col("chunk").cast("long").alias("chunk"), part.alias("size"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("at"))
    # a last row an hour later moves the watermark past the blocks
    sentinel = docs.select(F.lit(None).cast("long").alias("k"), F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("size"), F.lit("2024-01-01 01:00:00").cast("timestamp").alias("at"))
    out = _drain(stream_blocks(chunks.unionByName(sentinel), 8))
    return out.where("k IS NOT NULL").groupBy(F.col("k").alias("doc_id"), "block").agg(F.sum("chunks").cast("long").alias("chunks"), F.sum("bytes").cast("long").alias("bytes"))


def event_windows(spark, sf) -> DataFrame:
    """Events per type and hour from a stream with a watermark of one day."""
    events = _table_stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counted = events.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    folder = _folder(spark)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.select("event_type", F.col("w.start").alias("hour"), "n", F.lit(batch_id).alias("batch")).write.mode("append").parquet(f"{folder}/out")

    counted.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("event_type string, hour timestamp, n long, batch int").parquet(f"{folder}/out")
    # an update replaces what earlier batches said of the same window
    return rows.groupBy("event_type", F.unix_micros("hour").alias("hour_us")).agg(F.max_by("n", F.struct("batch", "n")).alias("n"))


def gaps_by_user(spark, sf) -> DataFrame:
    """Gap sizes of the series that a stream of events has written, deduplicated in its state, which
    forgets a day behind the latest event."""
    rows = _table_stream(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 day").dropDuplicates(["k", "ts"])
    made = _drain(rows).withColumn("v", F.unix_micros("ts"))
    return G.best_mode(G.gap_sizes(made.select("k", F.col("v").alias("t"), "v"))).withColumnRenamed("k", "user_id")


def registry() -> dict:
    from bitloom.plans.encodings import registry as batch

    return {
        "g16_stream_blocks": (
            text_blocks,
            "WITH h AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents), c AS (SELECT doc_id, n, unnest(range(CAST(ceil(n / 2048.0) AS BIGINT))) AS block FROM h)"
            " SELECT doc_id, block, CAST(ceil(least(2048, n - block * 2048) / 256.0) AS BIGINT) AS chunks, CAST(least(2048, n - block * 2048) AS BIGINT) AS bytes FROM c",
        ),
        "g16_event_windows": (event_windows, "SELECT event_type, epoch_us(date_trunc('hour', ts)) AS hour_us, count(*) AS n FROM events GROUP BY ALL"),
        "g16_stream_gap_mode": (gaps_by_user, batch()["d7_gap_mode"][1]),
    }
