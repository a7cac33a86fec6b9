"""Continuous delivery of triple lines: files that arrive in a folder are split into good triples and rejects.

The line loader has no state, so it runs on a stream as on a table. Each micro-batch is appended to two Parquet datasets in a
folder of its own number: a batch that is repeated after a failure replaces its folder, so every line counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.operators.rejects import good_triples, load_lines


def line_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(line_id, line) of text files as they arrive; line_id is the name of the file."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return lines.select(F.col("_metadata.file_name").alias("line_id"), F.col("value").alias("line"))


def _write(batch: DataFrame, number: int, out: str) -> None:
    loaded = load_lines(batch).persist()
    try:
        good_triples(loaded).drop("line_id").distinct().write.mode("overwrite").parquet(f"{out}/triples/batch={number}")
        rejects = loaded.where("reason is not null").select(F.col("line_id").alias("file"), "reason")
        rejects.write.mode("overwrite").parquet(f"{out}/rejects/batch={number}")
    finally:
        loaded.unpersist()


def ingest(lines: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start writing ``<out>/triples`` (s, p, o, batch) and ``<out>/rejects`` (file, reason, batch); with ``once`` the query ends
    when all files that are there have been read. ``checkpoint`` must be a folder that survives the driver."""
    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: _write(batch, number, out))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
