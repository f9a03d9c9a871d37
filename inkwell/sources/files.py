"""Files of pages, of JSON and of graphs: read with explicit schemas, written by Spark's own sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import clean_sha1

#: What is read of a page element of a dump; other elements are skipped by the parser.
PAGE = "title string, redirect string, revision struct<sha1: string, text: string>, sha1 string, text string"
RESULT = "score double, doc string, text string, start int, end int"
FORMATS = ("parquet", "json", "csv", "orc")
#: So that texts with quotes, line ends or outer white space come back as they were; null is written as \N.
EXACT = {"csv": {"escape": '"', "nullValue": "\\N", "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}}


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """file, title, text, sha1, redirect of every page element of the XML files at path; sha1 without white space.

    Files are split by the reader, so a dump need not fit into memory. Pages without sha1 are left out.
    """
    pages = spark.read.format("xml").option("rowTag", "page").option("nullValue", "").schema(PAGE).load(path)
    sha1, text = F.coalesce("revision.sha1", "sha1"), F.coalesce("revision.text", "text")
    found = pages.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), "title", text.alias("text"), clean_sha1(sha1).alias("sha1"), "redirect")
    return found.where("sha1 IS NOT NULL AND sha1 <> ''")


def read_table(spark: SparkSession, path: str, form: str = "parquet", schema: str | None = None) -> DataFrame:
    if form not in FORMATS:
        raise ValueError(f"unknown format {form}")
    reader = spark.read.format(form).options(**EXACT.get(form, {}))
    return (reader.schema(schema) if schema else reader).load(path)


def write_table(df: DataFrame, path: str, form: str = "parquet", compression: str | None = None, mode: str = "overwrite") -> None:
    if form not in FORMATS:
        raise ValueError(f"unknown format {form}")
    writer = df.write.mode(mode).format(form).options(**EXACT.get(form, {}))
    (writer.option("compression", compression) if compression else writer).save(path)


def content_hash(df: DataFrame) -> DataFrame:
    """One row: rows and hash of df, the same however its rows are ordered and spread."""
    each = F.xxhash64(*df.columns).cast("decimal(38,0)")
    return df.select(each.alias("h")).agg(F.count("*").alias("rows"), F.sum("h").alias("hash"))


def convert_table(spark: SparkSession, path: str, form: str, target: str, target_form: str, schema: str | None = None) -> bool:
    """Write the table at path in another format; does what is read back hold the same rows?"""
    rows = read_table(spark, path, form, schema)
    write_table(rows, target, target_form)
    again = read_table(spark, target, target_form, rows._jdf.schema().toDDL()).select(*rows.columns)
    return content_hash(rows).head() == content_hash(again).head()


def write_pages(pages: DataFrame, path: str) -> None:
    """The inverse of read_pages() for pages(title, text, sha1, redirect)."""
    revision = F.struct("sha1", "text").alias("revision")
    pages.select("title", "redirect", revision).write.mode("overwrite").format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)


def read_edges(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """src, dst of a graph stored as parquet, csv (src, dst), edgelist ('src dst ...'), adjacency JSON or GraphML. Directions are kept."""
    if form == "edgelist":
        parts = F.split("value", r"\s+")
        return spark.read.text(path).select(parts[0].alias("src"), parts[1].alias("dst")).where("dst IS NOT NULL")
    if form == "adjacency":
        return spark.read.schema("node string, children array<string>").json(path).select(F.col("node").alias("src"), F.explode("children").alias("dst"))
    if form == "graphml":
        return spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string").load(path).select(F.col("_source").alias("src"), F.col("_target").alias("dst"))
    return read_table(spark, path, form, "src string, dst string")


def write_edges(edges: DataFrame, path: str, form: str = "parquet") -> None:
    """The inverse of read_edges(). Nodes without edges are not stored."""
    edges = edges.select("src", "dst")
    if form == "edgelist":
        edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.mode("overwrite").text(path)
    elif form == "adjacency":
        edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("children")).write.mode("overwrite").json(path)
    elif form == "graphml":
        edges.select(F.col("src").alias("_source"), F.col("dst").alias("_target")).write.mode("overwrite").format("xml").option("rootTag", "graph").option("rowTag", "edge").save(path)
    else:
        write_table(edges, path, form)


def convert_edges(spark: SparkSession, path: str, form: str, target: str, target_form: str) -> None:
    write_edges(read_edges(spark, path, form), target, target_form)


def append_vectors(rows: DataFrame, path: str, vector: str, dims: int) -> None:
    """Append the rows with good vectors to the table at path; the others are dropped."""
    from inkwell.operators.vectors import good_vectors

    good_vectors(rows, vector, dims).write.mode("append").parquet(path)
