from inkwell.session import cut_lineage
from inkwell.sources.tables import articles, table

PAGE = "page_id bigint, text string, redirect string, title string, extra int"


def test_articles(spark):
    rows = [(1, "a", None, "t", 1), (1, "a", "", "t", 2), (2, "b", " \t", None, 1), (3, "c", "To", "t", 1), (4, None, None, "t", 1), (None, "d", None, "t", 1), (5, "", None, "t", 1), (6, "z", None, "t", 1), (6, "y", None, "t", 1)]
    assert sorted(tuple(r) for r in articles(spark.createDataFrame(rows, PAGE)).collect()) == [(1, "a"), (2, "b"), (5, ""), (6, "y")]
    assert articles(spark.createDataFrame([], PAGE)).count() == 0


def test_small_text_tables_are_spread_and_whole(spark, data):
    rows = table(spark, data, "documents")
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism // 2
    assert rows.count() == spark.read.parquet(f"{data}/documents.parquet").count()
    assert "repartition" not in table(spark, data, "nation")._jdf.queryExecution().toString().lower()


def test_cut_lineage_is_stable(spark):
    rows = cut_lineage(spark.range(10).selectExpr("id", "rand() as r"))
    assert rows.collect() == rows.collect()
    assert not spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty()
