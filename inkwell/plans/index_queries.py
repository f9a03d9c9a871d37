"""Queries of the index, the text rules and the sparse searches, with their SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions.pipeline import full_words, lemmatised, spelled, stemmed
from inkwell.operators import index as I
from inkwell.operators import search as S
from inkwell.operators.chunking import chunk_texts, paragraph_chunks
from inkwell.operators.phrases import phrase_scores
from inkwell.operators.store import StoredIndex, write_index
from inkwell.session import shared_folder
from inkwell.sources.tables import table

QUERY = "the bishop of the western river"
WORDS = ["bishop", "of", "river", "the", "western"]
CHUNK_LIMIT = 20_000


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def tf(spark: SparkSession, folder: str) -> DataFrame:
    return I.term_freq(docs(spark, folder))


#: Indexes built by this process: (application, folder) to the folder of the index.
_BUILT: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, folder: str) -> StoredIndex:
    """The index of the documents of folder, built in the shared folder when a session first asks for it."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _BUILT:
        path = f"{shared_folder(spark)}/index-{uuid4().hex}"
        write_index(docs(spark, folder), path)
        _BUILT[key] = path
    return StoredIndex(spark, _BUILT[key])


def _stored_idf(spark, folder):
    index = stored(spark, folder)
    return index.words().crossJoin(F.broadcast(index.stats)).select("word", "df", F.log(F.col("corpus_size") / F.col("df")).alias("idf"))


def _index_build(spark, folder):
    """Builds the index anew; what it then holds, word by word."""
    index = write_index(docs(spark, folder), f"{shared_folder(spark)}/index-{uuid4().hex}")
    return index.postings().groupBy("word").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.sum("doc_len").alias("doc_len"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def joined(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


def on_text(rule, name: str = "result"):
    """A query that applies a text rule to every document."""
    return lambda spark, folder: docs(spark, folder).select("doc_id", rule("text").alias(name))


def _top_idf(spark, folder):
    return rounded(I.inverse_doc_freq(docs(spark, folder)), "idf")


def _idf_join(spark, folder):
    rows, stats = I.weighted_counts(docs(spark, folder))
    return rounded(rows.crossJoin(F.broadcast(stats)).select("doc_id", "word", "tf", F.log(F.col("corpus_size") / F.col("df")).alias("idf")), "idf")


def _sparse(spark, folder, normalised=False):
    rows = I.sparse_vectors(docs(spark, folder), normalised=normalised)
    return rounded(rows, "idf", "tf_idf", "bm25")


def _shard_range(spark, folder):
    words = I.doc_freq(tf(spark, folder))
    shards = I.shard_map(words, 8)
    asked = spark.createDataFrame([(w,) for w in WORDS], "word string")
    found = asked.join(F.broadcast(shards), F.col("word").between(F.col("min_word"), F.col("max_word")))
    return found.select("word", "shard", "min_word", "max_word")


def _rerouted(spark, folder):
    held = S.any_word(stored(spark, folder).postings(["bishop", "western"]), ["bishop", "western"]).join(docs(spark, folder).select("doc_id", "file"), "doc_id")
    block = F.floor(F.col("doc_id") / I.BLOCK)
    return held.groupBy("file", block.alias("block")).agg(F.array_sort(F.collect_list("doc_id")).alias("ids")).select("file", "block", joined("ids").alias("ids"))


def _idf_filter(spark, folder, common):
    idf = I.inverse_doc_freq(docs(spark, folder))
    return rounded(idf.where(F.col("idf") < 1.0 if common else F.col("idf") >= 1.0).select("word", "idf"), "idf")


def _weighted(spark, folder):
    return rounded(S.weighted_candidates(stored(spark, folder).postings(WORDS), _stored_idf(spark, folder), WORDS), "weight")


def _aligned(spark, folder):
    rows = S.aligned_vectors(I.sparse_vectors(docs(spark, folder)), WORDS)
    return rows.select("doc_id", *(F.round(F.col("vector")[i], 6).alias(f"v{i}") for i in range(len(WORDS))))


def _tfidf(spark, folder, normalised=False, k=50):
    return rounded(S.top(S.tfidf_scores(stored(spark, folder), QUERY, normalised).withColumn("score", F.round("score", 6)), k), "score")


def _bm25(spark, folder, normalised=False, k=50):
    return S.top(S.bm25_scores(stored(spark, folder), QUERY, normalised=normalised).withColumn("score", F.round("score", 6)), k)


def _topk_per_source(spark, folder):
    scores = S.bm25_scores(stored(spark, folder), QUERY).withColumn("score", F.round("score", 6))
    return S.top_per_group(scores.join(docs(spark, folder).select("doc_id", "file"), "doc_id"), "file", 3).select("file", "rank", "doc_id", "score")


def _tf_norm(spark, folder):
    return stored(spark, folder).postings(WORDS).select("doc_id", "word", F.round(F.col("tf") / F.col("doc_len"), 6).alias("tf_norm"))


def _lookup(spark, folder):
    ids = docs(spark, folder).where("doc_id % 20 = 0").select("doc_id").union(spark.createDataFrame([(-1,)], "doc_id bigint"))
    return S.lookup_texts(docs(spark, folder), ids.select(F.col("doc_id").alias("place"), "doc_id")).select("doc_id", "text")


def _result_format(spark, folder):
    key = F.concat(F.lit("corpus/"), "file", F.lit("sha"), F.col("doc_id").cast("string"))
    rows = docs(spark, folder).where("file IS NOT NULL AND text IS NOT NULL").select("doc_id", key.alias("key"), "text")
    return rows.select("doc_id", F.regexp_extract("key", r"([^/]+\.xml)(.*)$", 1).alias("file"), F.regexp_extract("key", r"([^/]+\.xml)(.*)$", 2).alias("article"), T.text_slice("text", 5, 40).alias("slice"))


def _passages(spark, folder):
    """For each of every twentieth documents: the rank of the document when its own first twelve words are the query, by shared idf."""
    asked = docs(spark, folder).where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.explode(F.slice(T.simple_tokens("text"), 1, 12)).alias("word"))
    return S.own_ranks(docs(spark, folder), asked, 1.5, 10)


def _passage_search(spark, folder):
    """The ten best documents for each evaluation passage, by all of its words."""
    asked = table(spark, folder, "eval_item").where("text IS NOT NULL").select(F.col("item_id").alias("query_id"), "text")
    return S.search_all(stored(spark, folder), asked, 10).withColumnRenamed("query_id", "item_id")


def _words_of(rule):
    def query(spark, folder):
        words = docs(spark, folder).select("doc_id", F.explode(rule("text")).alias("word"))
        return words.groupBy("doc_id", "word").agg(F.count("*").alias("tf"))

    return query


QUERIES = {
    "simple_tokens": lambda s, f: docs(s, f).select("doc_id", F.posexplode(T.simple_tokens("text")).alias("place", "token")),
    "punct": on_text(T.without_punctuation),
    "special_numbers": on_text(T.plain_numbers),
    "superscripts": on_text(T.superscripts),
    "subscripts": on_text(T.subscripts),
    "stopwords": on_text(lambda c: F.array_join(T.content_words(F.lower(c)), " ")),
    "keywords": lambda s, f: docs(s, f).select("doc_id", F.explode(T.keywords("text")).alias("word")),
    "keyphrases": lambda s, f: docs(s, f).select("doc_id", F.explode(T.keyphrases("text")).alias("phrase")),
    "sha256": on_text(lambda c: F.sha2(c, 256)),
    "text_slice": on_text(lambda c: T.text_slice(c, 10, 25)),
    "size_profile": lambda s, f: docs(s, f).groupBy("file").agg(F.sum(F.octet_length("text")).alias("bytes")).select("file", T.size_label("bytes").alias("size")),
    "num_words": on_text(spelled),
    "stem": on_text(stemmed),
    "lemma": on_text(lemmatised),
    "full_bow": _words_of(full_words),
    "rake": lambda s, f: rounded(phrase_scores(docs(s, f)), "score"),
    "term_freq": tf,
    "bag_of_words": lambda s, f: I.bag_of_words(docs(s, f)).select("doc_id", F.array_join("words", " ").alias("words")),
    "doc_freq": lambda s, f: I.doc_freq(tf(s, f)),
    "doc_len": lambda s, f: I.doc_len(docs(s, f)),
    "doc_len_join": lambda s, f: tf(s, f).join(I.doc_len(docs(s, f)), "doc_id", "left"),
    "corpus_stats": lambda s, f: rounded(I.corpus_stats(docs(s, f)), "avg_doc_len"),
    "count_docs": lambda s, f: tf(s, f).agg(F.countDistinct("doc_id").alias("documents")),
    "idf": _top_idf,
    "idf_join": _idf_join,
    "idf_filter": lambda s, f: _idf_filter(s, f, True),
    "idf_filter_rare": lambda s, f: _idf_filter(s, f, False),
    "sparse_vectors": _sparse,
    "sparse_vectors_norm": lambda s, f: _sparse(s, f, True),
    "inverted_index": lambda s, f: I.inverted_index(tf(s, f)).select("word", "block", joined("docs").alias("docs")),
    "postings_sorted": lambda s, f: I.postings(tf(s, f)).select("word", "block", F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"].cast("string"), p["tf"].cast("string"))), ",").alias("postings")),
    "index_build": _index_build,
    "inverted_union": lambda s, f: S.any_word(stored(s, f).postings(["bishop", "western"]), ["bishop", "western"]),
    "filter_words": lambda s, f: stored(s, f).postings(WORDS).select("doc_id", "word", "tf"),
    "postings_and": lambda s, f: S.every_word(stored(s, f).postings(["bishop", "western"]), ["bishop", "western"]),
    "weighted_candidates": _weighted,
    "aligned_vector": _aligned,
    "tf_norm": _tf_norm,
    "tfidf_search": _tfidf,
    "tfidf_search_norm": lambda s, f: _tfidf(s, f, True),
    "tfidf_threshold": lambda s, f: rounded(S.tfidf_scores(stored(s, f), QUERY, threshold=0.5), "score"),
    "bm25_search": _bm25,
    "bm25_search_norm": lambda s, f: _bm25(s, f, True),
    "topk_per_source": _topk_per_source,
    "passage_recall": _passages,
    "passage_search": _passage_search,
    "article_lookup": _lookup,
    "result_format": _result_format,
    "group_by_file": _rerouted,
    "doc_ids": lambda s, f: I.dense_ids(docs(s, f).where("title IS NOT NULL"), "title"),
    "unique_words": lambda s, f: tf(s, f).select("word").distinct(),
    "top_terms": lambda s, f: I.doc_freq(tf(s, f)).orderBy(F.desc("df"), "word").limit(100),
    "vocab_len": lambda s, f: I.doc_freq(tf(s, f)).where(F.length("word") <= S.WORD_LIMIT),
    "vocab_profile": lambda s, f: I.char_histogram(I.doc_freq(tf(s, f))),
    "char_bucket": lambda s, f: I.doc_freq(tf(s, f)).select("word", T.char_bucket("word").alias("bucket")),
    "prefix_search": lambda s, f: stored(s, f).words().where(F.col("word").startswith("bri")),
    "vocab_chunks": lambda s, f: I.vocab_chunks(I.doc_freq(tf(s, f)), CHUNK_LIMIT),
    "fixed_chunks": lambda s, f: I.fixed_chunks(docs(s, f).select("doc_id"), "doc_id", 100),
    "shard_range_join": _shard_range,
    "paragraph_chunks": lambda s, f: paragraph_chunks(docs(s, f)),
    "chunk_text": lambda s, f: chunk_texts(docs(s, f), 64),
    "key_parse": lambda s, f: docs(s, f).where("file IS NOT NULL").select("doc_id", F.regexp_extract("file", r"multistream(\d+)_", 1).cast("int").alias("number"), F.regexp_replace("file", r"\.xml$", "").alias("stem")),
}

_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
BASE = f"""token AS (SELECT doc_id, unnest({_TOKENS}) AS word FROM documents),
tf AS (SELECT doc_id, word, count(*) AS tf FROM token GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
len AS (SELECT d.doc_id, count(t.word) AS dl FROM documents d LEFT JOIN token t ON d.doc_id = t.doc_id GROUP BY d.doc_id),
stats AS (SELECT count(*) AS corpus_size, avg(dl) AS avg_doc_len FROM len),
idf AS (SELECT word, df, ln(corpus_size / df) AS idf FROM df CROSS JOIN stats)"""


def _with(sql: str) -> str:
    return f"WITH {BASE} {sql}"


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _sql_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _plain(expr: str) -> str:
    return f"translate(translate({expr}, {_sql_literal(T.DROPPED)}, ''), {_sql_literal(T.SPACED)}, '{' ' * len(T.SPACED)}')"


_STOP = "[" + ", ".join(map(_sql_literal, T.STOP_WORDS)) + "]"


def _enclosed(expr: str) -> str:
    for glyph, written in T.enclosed_numbers().items():
        expr = f"replace({expr}, '{glyph}', '{written}')"
    return expr


def _raised(expr: str, glyphs: str) -> str:
    return f"translate(regexp_replace({expr}, '([{glyphs}]+)', '^\\1 ', 'g'), '{glyphs}', '{T.DIGITS}')"


_WS = "[ \\t\\n\\x0b\\f\\r]+"


def _content(expr: str) -> str:
    return f"list_filter(string_split_regex(trim({expr}, ' '), '{_WS}'), lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w))"


_COUNTS = "(SELECT word, CAST(count(*) AS BIGINT) AS count_q FROM (SELECT unnest(regexp_extract_all(lower('{q}'), '[\\w]+')) AS word) GROUP BY word)".format(q=QUERY)


def _tfidf_sql(normalised: bool, tail: str) -> str:
    t = "tf / dl" if normalised else "tf"
    return _with(f""", q AS (SELECT word, count_q * idf AS w, idf FROM {_COUNTS} JOIN idf USING (word)),
        s AS (SELECT doc_id, sum(w * ({t}) * idf) / nullif(sqrt(sum(power(({t}) * idf, 2))) * (SELECT sqrt(sum(w * w)) FROM q), 0) AS score
              FROM tf JOIN q USING (word) JOIN len USING (doc_id) GROUP BY doc_id) {tail}""").replace(f"{BASE} ,", f"{BASE},")


def bm25_sql(normalised: bool, tail: str) -> str:
    t = "(tf / dl)" if normalised else "tf"
    return _with(f""", s AS (SELECT doc_id, round(sum(idf * {t} * 2.2 / ({t} + 1.2 * (0.25 + 0.75 * dl / avg_doc_len))), 6) AS score
        FROM tf JOIN idf USING (word) JOIN len USING (doc_id) CROSS JOIN stats WHERE word IN ({_list(WORDS)}) GROUP BY doc_id) {tail}""").replace(f"{BASE} ,", f"{BASE},")


def _sparse_sql(t: str) -> str:
    return _with(f"""SELECT doc_id, word, tf, dl AS doc_len, round(idf, 6) AS idf, round({t} * idf, 6) AS tf_idf,
        round(idf * {t} * 2.2 / ({t} + 1.2 * (0.25 + 0.75 * dl / avg_doc_len)), 6) AS bm25 FROM tf JOIN idf USING (word) JOIN len USING (doc_id) CROSS JOIN stats""")


def _on_docs(expr: str) -> str:
    return f"SELECT doc_id, {expr} AS result FROM documents"


# RE2 knows ASCII word ends only: words are put between control characters first
_BRACED = f"regexp_replace({_raised(_raised(_plain(_enclosed('lower(text)')), T.SUBSCRIPTS), T.SUPERSCRIPTS)}, '([\\p{{L}}\\p{{N}}_]+)', chr(1) || '\\1' || chr(2), 'g')"
_BRACED_STOP = f"chr(1) || {_sql_literal('(?:' + '|'.join(T.STOP_WORDS) + ')')} || chr(2)"
# runs between stop words and signs; RE2 has no look-around, so words stand between control characters
_RUNS = f"regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\s\\x27-]+', ' | ', 'g'), '([\\p{{L}}\\p{{N}}\\x27]+)', chr(1) || '\\1' || chr(2), 'g')"
RAKE_SQL = f"""WITH runs AS (SELECT doc_id, replace(regexp_replace({_RUNS}, {_BRACED_STOP}, '|', 'g'), chr(1), '') AS marked FROM documents),
    parts AS (SELECT doc_id, string_split(replace(marked, chr(2), ''), '|') AS list FROM runs),
    pieces AS (SELECT doc_id, unnest(list) AS part, generate_subscripts(list, 1) AS place FROM parts),
    phrase AS (SELECT doc_id, place, trim(regexp_replace(part, '\\s+', ' ', 'g')) AS phrase FROM pieces),
    words AS (SELECT doc_id, place, phrase, unnest(string_split(phrase, ' ')) AS word, len(string_split(phrase, ' ')) AS length FROM phrase WHERE phrase <> ''),
    weights AS (SELECT doc_id, word, sum(length) / count(*) AS weight FROM words GROUP BY ALL),
    once AS (SELECT doc_id, place, phrase, sum(weight) AS score FROM words JOIN weights USING (doc_id, word) GROUP BY ALL)
    SELECT doc_id, phrase, round(max(score), 6) AS score FROM once GROUP BY ALL"""
_SPANS = "unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n"
SQL = {
    "simple_tokens": f"SELECT doc_id, CAST(n - 1 AS INTEGER) AS place, token FROM (SELECT doc_id, unnest({_TOKENS}) AS token, generate_subscripts({_TOKENS}, 1) AS n FROM documents)",
    "punct": _on_docs(_plain("text")),
    "special_numbers": _on_docs(_enclosed("text")),
    "superscripts": _on_docs(_raised("text", T.SUPERSCRIPTS)),
    "subscripts": _on_docs(_raised("text", T.SUBSCRIPTS)),
    "stopwords": _on_docs(f"array_to_string({_content('lower(text)')}, ' ')"),
    "keywords": f"SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(string_split_regex({_raised(_raised('words', T.SUBSCRIPTS), T.SUPERSCRIPTS)}, '{_WS}')) AS word FROM (SELECT doc_id, array_to_string({_content(_plain(_enclosed('lower(text)')))}, ' ') AS words FROM documents)) WHERE word <> ''",
    "keyphrases": f"SELECT DISTINCT doc_id, phrase FROM (SELECT doc_id, trim(regexp_replace(translate(unnest(string_split_regex({_BRACED}, {_BRACED_STOP})), chr(1) || chr(2), ''), '{_WS}', ' ', 'g'), ' ') AS phrase FROM documents) WHERE phrase <> ''",
    "rake": RAKE_SQL,
    "sha256": _on_docs("sha256(text)"),
    "text_slice": _on_docs("substring(text, 11, 25)"),
    "size_profile": "SELECT file, CASE WHEN b > 1073741824 THEN printf('%.2f', b / 1073741824) || ' GB' WHEN b > 1048576 THEN printf('%.2f', b / 1048576) || ' MB' WHEN b > 1024 THEN printf('%.2f', b / 1024) || ' KB' ELSE b || ' Bytes' END AS size FROM (SELECT file, CAST(sum(strlen(text)) AS BIGINT) AS b FROM documents GROUP BY file)",
    "term_freq": _with("SELECT * FROM tf"),
    "bag_of_words": f"SELECT doc_id, array_to_string(list_sort(list_distinct({_TOKENS})), ' ') AS words FROM documents",
    "doc_freq": _with("SELECT * FROM df"),
    "doc_len": _with("SELECT * FROM len"),
    "doc_len_join": _with("SELECT tf.*, dl FROM tf LEFT JOIN len USING (doc_id)"),
    "corpus_stats": _with("SELECT corpus_size, round(avg_doc_len, 6) AS avg_doc_len FROM stats"),
    "count_docs": _with("SELECT count(DISTINCT doc_id) AS documents FROM tf"),
    "idf": _with("SELECT word, df, round(idf, 6) AS idf FROM idf"),
    "idf_join": _with("SELECT tf.*, round(idf, 6) AS idf FROM tf LEFT JOIN idf USING (word)"),
    "idf_filter": _with("SELECT word, round(idf, 6) AS idf FROM idf WHERE idf < 1"),
    "idf_filter_rare": _with("SELECT word, round(idf, 6) AS idf FROM idf WHERE idf >= 1"),
    "sparse_vectors": _sparse_sql("tf"),
    "sparse_vectors_norm": _sparse_sql("(tf / dl)"),
    "inverted_index": _with(f"SELECT word, doc_id // {I.BLOCK} AS block, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS docs FROM tf GROUP BY ALL"),
    "postings_sorted": _with(f"SELECT word, doc_id // {I.BLOCK} AS block, string_agg(doc_id || ':' || tf, ',' ORDER BY doc_id) AS postings FROM tf GROUP BY ALL"),
    "inverted_union": _with("SELECT DISTINCT doc_id FROM tf WHERE word IN ('bishop', 'western')"),
    "filter_words": _with(f"SELECT * FROM tf WHERE word IN ({_list(WORDS)})"),
    "postings_and": _with("SELECT doc_id FROM tf WHERE word IN ('bishop', 'western') GROUP BY doc_id HAVING count(*) = 2"),
    "weighted_candidates": _with(f"SELECT doc_id, round(sum(idf), 6) AS weight FROM tf JOIN idf USING (word) WHERE word IN ({_list(WORDS)}) GROUP BY doc_id HAVING sum(idf) > 1"),
    "aligned_vector": _with("SELECT doc_id, " + ", ".join(f"round(coalesce(sum(tf * idf) FILTER (word = '{w}'), 0), 6) AS v{i}" for i, w in enumerate(WORDS)) + f" FROM tf JOIN idf USING (word) WHERE word IN ({_list(WORDS)}) GROUP BY doc_id"),
    "tf_norm": _with(f"SELECT doc_id, word, round(tf / dl, 6) AS tf_norm FROM tf JOIN len USING (doc_id) WHERE word IN ({_list(WORDS)})"),
    "tfidf_search": _tfidf_sql(False, "SELECT doc_id, round(score, 6) AS score FROM s WHERE score IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 50"),
    "tfidf_search_norm": _tfidf_sql(True, "SELECT doc_id, round(score, 6) AS score FROM s WHERE score IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 50"),
    "tfidf_threshold": _tfidf_sql(False, "SELECT doc_id, round(score, 6) AS score FROM s WHERE score >= 0.5"),
    "bm25_search": bm25_sql(False, "SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 50"),
    "bm25_search_norm": bm25_sql(True, "SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 50"),
    "topk_per_source": bm25_sql(False, "SELECT file, CAST(r AS INTEGER) AS rank, doc_id, score FROM (SELECT file, doc_id, score, row_number() OVER (PARTITION BY file ORDER BY score DESC, doc_id) AS r FROM s JOIN documents USING (doc_id)) WHERE r <= 3"),
    "passage_recall": _with(f""", asked AS (SELECT DISTINCT doc_id AS query_id, unnest({_TOKENS}[1:12]) AS word FROM documents WHERE doc_id % 20 = 0),
        s AS (SELECT query_id, doc_id, round(sum(idf), 6) AS score FROM asked JOIN idf USING (word) JOIN tf USING (word) WHERE idf > 1.5 GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10 AND doc_id = query_id""").replace(f"{BASE} ,", f"{BASE},"),
    "index_build": _with("SELECT word, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf, CAST(sum(dl) AS BIGINT) AS doc_len FROM tf JOIN len USING (doc_id) GROUP BY word"),
    "passage_search": _with(f""", asked AS (SELECT DISTINCT item_id, unnest({_TOKENS}) AS word FROM eval_item),
        s AS (SELECT item_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_doc_len))), 6) AS score
          FROM asked JOIN idf USING (word) JOIN tf USING (word) JOIN len USING (doc_id) CROSS JOIN stats GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10""").replace(f"{BASE} ,", f"{BASE},"),
    "article_lookup": "SELECT a.doc_id, coalesce(d.text, 'ERROR: article not found') AS text FROM (SELECT doc_id FROM documents WHERE doc_id % 20 = 0 UNION ALL SELECT -1) a LEFT JOIN documents d ON a.doc_id = d.doc_id",
    "result_format": "SELECT doc_id, file, 'sha' || doc_id AS article, substring(text, 6, 40) AS slice FROM documents WHERE file IS NOT NULL AND text IS NOT NULL",
    "group_by_file": _with(f"SELECT file, doc_id // {I.BLOCK} AS block, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM (SELECT DISTINCT doc_id FROM tf WHERE word IN ('bishop', 'western')) JOIN documents USING (doc_id) GROUP BY ALL"),
    "doc_ids": "SELECT title, row_number() OVER (ORDER BY title) AS id FROM (SELECT DISTINCT title FROM documents WHERE title IS NOT NULL)",
    "unique_words": _with("SELECT word FROM df"),
    "top_terms": _with("SELECT word, df FROM df ORDER BY df DESC, word LIMIT 100"),
    "vocab_len": _with("SELECT word, df FROM df WHERE length(word) <= 60"),
    "vocab_profile": _with("SELECT CASE WHEN regexp_matches(word[1], '^[0-9a-z]$') THEN word[1] ELSE 'other' END AS bucket, count(*) AS words, CAST(max(length(word)) AS INTEGER) AS longest FROM df GROUP BY 1"),
    "char_bucket": _with("SELECT word, CASE WHEN regexp_matches(word[1], '^[0-9a-z]$') THEN word[1] ELSE 'other' END AS bucket FROM df"),
    "prefix_search": _with("SELECT word, df FROM df WHERE starts_with(word, 'bri')"),
    "vocab_chunks": "WITH RECURSIVE " + BASE + f""", ranked AS (SELECT word, df, row_number() OVER (ORDER BY df DESC, word) AS p FROM df),
        pack AS (SELECT word, df, p, df AS s, CAST(0 AS BIGINT) AS chunk FROM ranked WHERE p = 1
          UNION ALL SELECT r.word, r.df, r.p, CASE WHEN k.s + r.df > {CHUNK_LIMIT} THEN r.df ELSE k.s + r.df END, CASE WHEN k.s + r.df > {CHUNK_LIMIT} THEN k.chunk + 1 ELSE k.chunk END
          FROM pack k JOIN ranked r ON r.p = k.p + 1) SELECT word, df, chunk FROM pack""",
    "fixed_chunks": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS chunk FROM documents",
    "shard_range_join": _with(f""", n AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS id, count(*) OVER () AS total FROM df),
        shards AS (SELECT id // ((total + 7) // 8) AS shard, min(word) AS min_word, max(word) AS max_word FROM n GROUP BY 1)
        SELECT word, shard, min_word, max_word FROM (SELECT unnest([{_list(WORDS)}]) AS word) JOIN shards ON word BETWEEN min_word AND max_word""").replace(f"{BASE} ,", f"{BASE},"),
    "paragraph_chunks": f"SELECT doc_id, CAST(n - 1 - empties AS BIGINT) AS chunk_no, CAST(begins AS INTEGER) AS text_idx, CAST(length(line) AS INTEGER) AS text_len FROM (SELECT doc_id, n, line, sum(length(line) + 1) OVER w - length(line) - 1 AS begins, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER w AS empties FROM (SELECT doc_id, {_SPANS} FROM documents) WINDOW w AS (PARTITION BY doc_id ORDER BY n)) WHERE line <> ''",
    "key_parse": "SELECT doc_id, CAST(regexp_extract(file, 'multistream(\\d+)_', 1) AS INTEGER) AS number, regexp_replace(file, '\\.xml$', '') AS stem FROM documents WHERE file IS NOT NULL",
}
