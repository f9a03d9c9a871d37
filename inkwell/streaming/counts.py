"""Document frequencies of arriving pages, kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkwell.functions.text import simple_tokens


def read_documents(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the documents in the parquet files that arrive at path."""
    schema = "doc_id bigint, text string, loaded_at timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_deliveries(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """The stream without repeated deliveries of a doc_id within the watermark; the state of older ones is dropped."""
    return stream.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["doc_id"])


def write_counts(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append (batch, word, df) of each micro-batch to target until no file is left; doc_freq() adds them up.

    A batch that is repeated after a failure overwrites its own partition, so nothing counts twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        words = batch.select(F.explode(F.array_distinct(simple_tokens("text"))).alias("word"))
        counts = words.groupBy("word").agg(F.count("*").alias("df"))
        counts.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def doc_freq(spark: SparkSession, target: str) -> DataFrame:
    """word, df over all batches so far."""
    return spark.read.parquet(target).groupBy("word").agg(F.sum("df").alias("df"))
