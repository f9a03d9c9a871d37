import duckdb
import pytest

from inkwell.functions import text as T
from inkwell.functions.numbers import number_words, spell_numbers
from inkwell.functions.pipeline import full_words, spelled
from inkwell.functions.stemming import singular, stem
from inkwell.operators.chunking import chunk_spans, chunk_texts, paragraph_chunks
from inkwell.operators.phrases import phrase_scores
from inkwell.plans.index_queries import RAKE_SQL


def apply(spark, rule, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(rule("text")).collect()]


def test_rules(spark):
    assert apply(spark, T.superscripts, "x² y³⁴z", None) == ["x^2  y^34 z", None]
    assert apply(spark, T.subscripts, "y₁₀") == ["y^10 "]
    assert apply(spark, T.plain_numbers, "a①⑵㊿⓿", "plain") == ["a(1)(2)(50)(0)", "plain"]
    assert apply(spark, T.without_punctuation, "don't 1,000 a-b`c") == ["dont 1000 a b c"]
    assert apply(spark, T.content_words, "the cat is a big x") == [["cat", "big"]]
    assert apply(spark, T.keywords, "The X² cats, cats don't") == [["x^2", "cats", "dont"]]
    assert apply(spark, T.keyphrases, "the big cat of the old town") == [["big cat", "old town"]]
    assert apply(spark, T.simple_tokens, "Élan_1, x!", "", None) == [["élan_1", "x"], [], None]
    assert apply(spark, T.clean_sha1, " a b\n") == ["ab"]
    assert apply(spark, lambda c: T.text_slice(c, 2, 3), "abcdef") == ["cde"]
    assert len(T.enclosed_numbers()) == 122 and len(T.STOP_WORDS) == 179


def test_char_bucket_and_size(spark):
    rows = spark.createDataFrame([("apple", 10), ("9x", 2048), ("über", 3 * 2**20)], "w string, n bigint")
    assert [tuple(r) for r in rows.select(T.char_bucket("w"), T.size_label("n")).collect()] == [("a", "10 Bytes"), ("9", "2.00 KB"), ("other", "3.00 MB")]


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("skies", "sky"), ("generalization", "gener"), ("dying", "die"), ("by", "by")])
def test_stem(word, want):
    assert stem(word) == want


def test_numbers():
    assert number_words(1905) == "one thousand, nine hundred and five"
    assert number_words(0) == "zero" and number_words(10**306).endswith("illion")
    assert spell_numbers("in 21 days ᧑᧒ x") == "in twenty-one days x"
    assert len(spell_numbers("1" * 310).split()) > 50
    assert singular("cities") == "city" and singular("glass") == "glass"


def test_full_pipeline(spark):
    assert apply(spark, full_words, "The 21 Cats were running, x² 5", "", None) == [["twenti", "cat", "run", "two"], [], None]
    assert apply(spark, spelled, "7 a") == ["seven a"]


def test_chunks(spark):
    words = lambda n: lambda part: len(part.split()) <= n and len(part) <= 8 * n
    text = "one two three four\n\nsame line\nsame line\n\n" + "x" * 50
    spans = list(chunk_spans(text, words(3)))
    assert [text[a:b] for a, b in spans[:4]] == ["one two", "three four", "same line\nsame line"[:9], "same line"]
    assert "".join(text[a:b] for a, b in spans).replace("\n", "").replace(" ", "") == text.replace("\n", "").replace(" ", "")
    assert all(b - a <= 24 for a, b in spans) and spans == sorted(spans) and len(set(spans)) == len(spans)
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    assert {r.doc_id for r in chunk_texts(df, 3).collect()} == {1}
    assert [(r.chunk_no, r.text_idx, r.text_len) for r in paragraph_chunks(df).orderBy("chunk_no").collect()][:3] == [(0, 0, 18), (1, 20, 9), (2, 30, 9)]


def test_phrases(spark):
    df = spark.createDataFrame([(1, "Big red cat and the red cat."), (2, None)], "doc_id bigint, text string")
    got = {r.phrase: r.score for r in phrase_scores(df).collect()}
    assert got == {"big red cat": 3 + 2.5 + 2.5, "red cat": 5.0}


def test_phrases_of_repeated_documents(spark):
    """Against the SQL, also where rows share a doc_id; texts are shuffled once and words never, so nothing is joined."""
    rows = [(1, "the Red cat's tail, red\tcat"), (1, "Red cat's tail"), (1, "Red cat's tail"), (2, "a - b|c | | it's d-e the-f"), (3, ""), (4, None), (5, "of the"), (None, "lost cat")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    ours, theirs = {r[:2]: round(r[2], 6) for r in phrase_scores(df).collect()}, {r[:2]: r[2] for r in con.execute(RAKE_SQL).fetchall()}
    assert ours == theirs and ours
    plan = phrase_scores(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
