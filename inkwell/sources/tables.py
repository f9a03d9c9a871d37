"""Reading the tables by name, and the article view of the page table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.session import SPREAD

#: Tables with long texts, and their keys.
KEYS = {"documents": "doc_id", "page": "page_id", "raw_record": "record_id"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table name of folder. Columns are pruned and filters pushed down by the scan.

    Tables are read as they lie. A session whose texts come in too few files for its cores may ask by the setting
    spark.inkwell.spread to have them spread by their keys, which later groupings by that key then need not do again.
    """
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    spread = int(spark.conf.get(SPREAD, "0"))
    return rows.repartition(spread, KEYS[name]) if spread > 0 and name in KEYS else rows


def articles(page: DataFrame) -> DataFrame:
    """(page_id, text) of each distinct page_id with text and without redirect.

    Repeated deliveries collapse on the map side already, so a page delivered a million times is no hot key.
    Should deliveries of one page_id differ, the text that is first in order counts. Rows with null page_id are left out.
    """
    kept = page.where(
        F.col("page_id").isNotNull() & F.col("text").isNotNull() & ~F.coalesce("redirect", F.lit("")).rlike(r"(?U)\S")
    )
    return kept.groupBy("page_id").agg(F.min("text").alias("text"))
