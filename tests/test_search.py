import math

import duckdb
import pytest

from inkwell.engine import SearchEngine
from inkwell.operators import index as I
from inkwell.operators import search as S
from inkwell.operators.store import StoredIndex, write_index
from inkwell.plans import index_queries

DOCS = [(1, "red cat red"), (2, "blue cat"), (3, ""), (4, None), (5, "dog")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, text string").cache()


def test_statistics(docs):
    assert I.corpus_stats(docs).head() == (5, 6 / 5)
    assert {(r.word, r.df) for r in I.doc_freq(I.term_freq(docs)).collect()} == {("red", 1), ("cat", 2), ("blue", 1), ("dog", 1)}
    idf = {r.word: r.idf for r in I.inverse_doc_freq(docs).collect()}
    assert idf["cat"] == pytest.approx(math.log(5 / 2)) and min(idf.values()) >= 0


def test_one_matching_word_has_cosine_one(docs):
    assert [(r.doc_id, round(r.score, 9)) for r in S.tfidf_scores(docs, "cat nowhere").orderBy("doc_id").collect()] == [(1, 1.0), (2, 1.0)]


def test_bm25_order_and_ties(docs):
    assert [r.doc_id for r in S.top(S.bm25_scores(docs, "red cat"), 2).collect()] == [1, 2]
    assert S.bm25_scores(docs, "nowhere").count() == 0
    with pytest.raises(ValueError):
        S.top(S.bm25_scores(docs, "cat"), 0)


def test_candidates(docs):
    tf, idf = I.term_freq(docs), I.inverse_doc_freq(docs)
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(S.any_word(tf, ["red", "blue"])) == [1, 2] and ids(S.every_word(tf, ["red", "cat"])) == [1]
    assert ids(S.word_candidates(tf, idf, ["cat"], "word_idf_filter")) == [1, 2]
    assert ids(S.word_candidates(tf, idf, ["cat"], "weighted_doc_idf")) == []
    with pytest.raises(NotImplementedError):
        S.word_candidates(tf, idf, ["cat"], "category_word2vec")


def test_dense_ids_and_chunks(spark):
    words = spark.createDataFrame([(f"w{i:03}",) for i in range(50)] * 2 + [(None,)], "word string")
    assert [r.id for r in I.dense_ids(words, "word").orderBy("word").collect()] == list(range(1, 51))
    df = spark.createDataFrame([("a", 9), ("b", 4), ("c", 3), ("d", 3), ("e", 1)], "word string, df bigint")
    assert {r.word: r.chunk for r in I.vocab_chunks(df, 7).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 2}
    assert I.vocab_chunks(df.limit(0), 7).count() == 0


def test_blocks_of_postings(docs):
    rows = I.inverted_index(I.term_freq(docs), block=2).where("word = 'cat'").collect()
    assert sorted((r.block, r.docs) for r in rows) == [(0, [1]), (1, [2])]


def test_lookup(spark, docs):
    keys = spark.createDataFrame([(0, 2), (1, 99)], "place int, doc_id bigint")
    assert [r.text for r in S.lookup_texts(docs, keys).orderBy("place").collect()] == ["blue cat", "ERROR: article not found"]


def test_engine(spark, docs):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (5, [0.9, 0.1])], "doc_id bigint, vector array<double>")
    engine = SearchEngine(docs, vectors, lambda q: [1.0, 0.0])
    assert [r.doc_id for r in engine.search("red cat").collect()] == [1, 2]
    assert [r.doc_id for r in engine.search("any", "vector", 2).collect()] == [1, 5]
    assert [r.doc_id for r in engine.search("blue", "rerank").collect()] == [2]
    assert engine.search("nowhere", "rerank").count() == 0 and engine.search("cat", max_results=10_001).count() == engine.search("cat").count() > 0
    with pytest.raises(ValueError):
        engine.search("cat", "magic")


STORED = [(1, "red cat red", 0), (2, "cat dog", 0), (3, None, 0), (4, "", 0), (None, "cat", 0), (2, "cow", 0), (5, " ".join(f"w{i}" for i in range(1200)), 0)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = spark.createDataFrame(STORED, "doc_id bigint, text string, word int")
    return write_index(rows, str(tmp_path_factory.mktemp("index") / "one"), buckets=4), rows


def test_stored_index_holds_the_texts(spark, index):
    stored, rows = index
    again = StoredIndex(spark, stored.path)
    assert {tuple(r) for r in again.postings(["red", "cat", "cow", "nowhere"]).collect()} == {("red", 1, 2, 3), ("cat", 1, 1, 3), ("cat", 2, 1, 3), ("cow", 2, 1, 3)}
    assert {tuple(r) for r in again.documents().collect()} == {(1, 3), (2, 3), (3, 0), (4, 0), (5, 1200)} and again.stats.head().corpus_size == 5
    assert again.words().count() == 1204 and again.words(["cat"]).head().df == 2
    empty = write_index(rows.limit(0), stored.path + "-empty")
    assert empty.postings().count() == 0 and S.bm25_scores(empty, "cat").count() == 0 == S.tfidf_scores(empty, "").count()


def test_search_of_a_stored_index_equals_that_of_the_texts(spark, index):
    stored, rows = index
    many = " ".join(f"w{i}" for i in range(1000)) + " cat cat red"
    for query in ("red cat cat", "nowhere", many):
        for scores in (S.bm25_scores, S.tfidf_scores):
            one, two = ({r.doc_id: round(r.score, 9) for r in scores(x, query).collect()} for x in (stored, rows))
            assert one == two and bool(one) == (query != "nowhere")
    engine = SearchEngine.open(rows, stored.path)
    assert [r.doc_id for r in engine.search("red cat").collect()] == [r.doc_id for r in SearchEngine(rows).search("red cat").collect()]
    found = S.search_all(stored, spark.createDataFrame([(7, "red dog"), (8, None), (9, "nowhere")], "query_id bigint, text string"), 1).collect()
    assert [(r.query_id, r["rank"], r.doc_id) for r in found] == [(7, 1, 1)]


def test_only_buckets_and_words_of_the_query_are_read(index):
    plan = S.bm25_scores(index[0], "red cat")._jdf.queryExecution().toString()
    assert "In(word, [cat,red])" in plan and "PartitionFilters: [bucket" in plan and "text" not in plan


def test_ranks_of_own_words(spark, tmp_path, monkeypatch):
    """passage_recall against its SQL, with texts that hold each other, copies and repeated ids: no index, no pairs of documents shuffled."""
    rows = [(i, " ".join(f"w{i * 3 % 13 + j}" for j in range(2 + i % 7))) for i in range(1, 200)] + [(i, f"rare{i} only") for i in range(200, 401)]
    rows += [(20, "w0 again"), (40, rows[39][1]), (420, ""), (440, None), (None, "w1 w2"), *((i, "filler words") for i in range(441, 1500))]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet') WHERE doc_id IS NOT NULL")
    theirs = sorted(con.execute(index_queries.SQL["passage_recall"]).fetchall())
    monkeypatch.setattr(index_queries, "stored", lambda spark, folder: pytest.fail("builds an index"))
    found = index_queries.QUERIES["passage_recall"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == theirs and len({rank for _, rank in theirs}) > 3
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    asked = docs.where("doc_id % 20 = 0").selectExpr("doc_id AS query_id", "explode(slice(split(text, ' '), 1, 12)) AS word").where("word <> ''")
    assert sorted(tuple(r) for r in S.own_ranks(docs, asked, 1.5, 10, at_once=7).collect()) == theirs
