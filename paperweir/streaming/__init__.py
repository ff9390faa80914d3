"""Capture as a stream: new text files or records are ingested as they arrive, each content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweir.operators.ingest import ingest_text
from paperweir.operators.library import source_records
from paperweir.sources.writers import exists


def stream_sources(spark: SparkSession, folder: str, schema: str, captured_at: str, delay: str = "1 day") -> DataFrame:
    """Source records of a folder of JSON rows (text, label, ts); repeats of one content within the delay count once.

    The watermark bounds the state of the de-duplication; ids depend on the content, so a later repeat meets the
    create-only sink instead.
    """
    rows = spark.readStream.schema(schema).json(folder).withWatermark("ts", delay)
    fresh = rows.withColumn("h", F.sha2(F.concat_ws("\x1f", F.coalesce("label", F.lit("")), "text"), 256)).dropDuplicatesWithinWatermark(["h"])
    return source_records(ingest_text(fresh), captured_at)


def write_stream(sources: DataFrame, table: str, checkpoint: str):
    """Append the stream to a table, each id once over all batches; a batch that is tried again writes nothing twice."""

    def batch(df: DataFrame, _: int) -> None:
        once = df.dropDuplicates(["id"])
        if exists(df.sparkSession, table):
            once = once.join(df.sparkSession.read.parquet(table).select("id"), "id", "left_anti")
        once.write.mode("append").parquet(table)

    return sources.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
