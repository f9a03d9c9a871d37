import numpy as np
import pytest

from inkwell.functions.names import namespace
from inkwell.sources import files as S
from inkwell.sources.vectors import VectorStore, embed_chunks
from inkwell.streaming import counts as C

XML = """<mediawiki><page><title>A</title><revision><sha1> ab c </sha1><text>hello &amp; bye</text></revision></page>
<page><title>B</title><redirect>A</redirect><sha1>d</sha1><text>x</text></page><page><title>C</title></page></mediawiki>"""


def test_pages(spark, tmp_path):
    (tmp_path / "dump1.xml").write_text(XML)
    rows = S.read_pages(spark, str(tmp_path)).orderBy("title").collect()
    assert [(r.file, r.title, r.text, r.sha1, r.redirect) for r in rows] == [("dump1.xml", "A", "hello & bye", "abc", None), ("dump1.xml", "B", "x", "d", "A")]


@pytest.mark.parametrize("form", ["parquet", "csv", "edgelist", "adjacency", "graphml", "json"])
def test_graph_formats_keep_direction(spark, tmp_path, form):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c")], "src string, dst string")
    S.write_edges(edges, f"{tmp_path}/one", form)
    S.convert_edges(spark, f"{tmp_path}/one", form, f"{tmp_path}/two", "parquet")
    assert {tuple(r) for r in S.read_edges(spark, f"{tmp_path}/two").collect()} == {("a", "b"), ("b", "a"), ("a", "c")}


def test_tables(spark, tmp_path):
    df = spark.range(5)
    S.write_table(df, f"{tmp_path}/t", "json", "gzip")
    assert S.read_table(spark, f"{tmp_path}/t", "json", "id bigint").count() == 5
    with pytest.raises(ValueError):
        S.read_table(spark, "x", "msgpack")
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id int, v array<double>")
    S.append_vectors(rows, f"{tmp_path}/v", "v", 2)
    S.append_vectors(rows, f"{tmp_path}/v", "v", 2)
    assert spark.read.parquet(f"{tmp_path}/v").count() == 2


def test_streamed_counts(spark, tmp_path):
    def arrive(rows, name):
        spark.createDataFrame(rows, "doc_id bigint, text string, loaded_at string").selectExpr("doc_id", "text", "cast(loaded_at as timestamp) loaded_at").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    source = f"{tmp_path}/in/*"
    for n, rows in enumerate(([(1, "red cat", "2024-01-01"), (2, "cat", "2024-01-02")], [(1, "red cat", "2024-01-03"), (3, "dog", "2024-01-03")])):
        arrive(rows, f"b{n}")
        stream = C.first_deliveries(C.read_documents(spark, source))
        C.write_counts(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert {r.word: r.df for r in C.doc_freq(spark, f"{tmp_path}/out").collect()} == {"red": 1, "cat": 2, "dog": 1}


def test_conversion_keeps_rows(spark, tmp_path):
    rows = [(1, " a\"b ", None), (2, "line\nend, \\", 0.5), (3, "", 1e300), (None, None, None), (2, "line\nend, \\", 0.5)]
    df = spark.createDataFrame(rows, "id bigint, text string, x double")
    S.write_table(df, f"{tmp_path}/one")
    for form in ("json", "orc", "csv"):
        assert S.convert_table(spark, f"{tmp_path}/one", "parquet", f"{tmp_path}/{form}", form)
    assert S.content_hash(df).head() == S.content_hash(df.repartition(3)).head() != S.content_hash(df.limit(4)).head()


def test_vector_store(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/store", 2)
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id bigint, vector array<double>")
    assert store.names() == [] and store.create("a", rows).count() == 1
    store.append("a", rows)
    store.create(store.query_name("red cat"), store.open("a"))
    assert store.open("a").count() == 2 and len(store.names()) == 2
    with pytest.raises(ValueError):
        store.create("a", rows)
    with pytest.raises(ValueError):
        store.open("../a")
    store.drop("a")
    store.drop("a")
    assert store.names() == [store.query_name("red cat")]


def test_embedded_chunks_know_their_places(spark):
    docs = spark.createDataFrame([(1, "one two\n\nthree", "q"), (2, None, "q"), (3, "", "q")], "doc_id bigint, text string, vector string")
    rows = embed_chunks(docs, lambda parts: np.array([[len(p), p.count("e")] for p in parts]), 8).collect()
    assert sorted((r.doc_id, r.text_idx, r.text_len, tuple(r.vector)) for r in rows) == [(1, 0, 7, (7.0, 1.0)), (1, 9, 5, (5.0, 2.0))]


def test_namespaces(spark):
    rows = spark.createDataFrame([("Category:A",), ("category : b",), ("Help:x:y",), ("Red: a colour",), ("plain",), (None,)], "t string")
    assert [r[0] for r in rows.select(namespace("t")).collect()] == [14, 14, 12, 0, 0, None]
