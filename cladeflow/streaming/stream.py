"""Placement of a stream of query sequences: the batch transformation, applied to each micro-batch.

Nothing is carried from one batch to the next; each writes its own part files, named by the batch's number,
so a batch that is repeated after a failure replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.functions.likelihood import Reference
from cladeflow.operators.placement import Options, place
from cladeflow.sources.jplace import pquery_text

SEQUENCES = "seq_id long, label string, sites string"


def read_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of sequences as they arrive."""
    return spark.readStream.schema(SEQUENCES).parquet(folder)


def place_stream(stream: DataFrame, reference: Reference, folder: str, checkpoint: str, options: Options | None = None):
    """Starts the query; ``folder`` receives one folder of placements a batch."""
    options = options or Options()

    def write(batch: DataFrame, number: int) -> None:
        placed = place(batch, reference, options)
        placed.withColumn("json", pquery_text(options.precision)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by window and type, for streams with a time: ``ts``, ``event_type``, ``value``."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )
