"""Queries of vectors, pages, categories and graphs, with their SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.arrow import deflated, inflated
from inkwell.functions.names import category_name, namespace
from inkwell.functions.text import clean_sha1
from inkwell.operators import graph as G
from inkwell.operators import sets as U
from inkwell.operators import vectors as V
from inkwell.operators.index import dense_ids, running_totals, term_freq
from inkwell.operators.search import bm25_scores, rank_position, top, top_per_group
from inkwell.plans.index_queries import QUERY, bm25_sql, stored
from inkwell.session import shared_folder
from inkwell.sources.files import convert_table, read_pages, write_pages
from inkwell.sources.tables import articles, table
from inkwell.sources.vectors import VectorStore

K, DIMS, CATEGORY_DIMS = 10, 64, 8


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return V.good_vectors(rows, "vector", DIMS)


def _asked(rows: DataFrame) -> DataFrame:
    return rows.where("id % 20 = 0")


def _knn(metric: str):
    def query(spark, folder):
        rows = vectors(spark, folder)
        return V.nearest(_asked(rows), rows, K, metric, skip_self=True).withColumn("distance", F.round("distance", 6))

    return query


def _knn_filtered(spark, folder):
    rows = vectors(spark, folder)
    return V.nearest(_asked(rows), rows.where("label < 5"), K, "cosine", skip_self=True).withColumn("distance", F.round("distance", 6))


def _multi(spark, folder):
    ranked = _knn("cosine")(spark, folder).withColumn("one", F.lit(1))
    return running_totals(ranked, [F.col("rank"), F.col("query_id")], "one").select("place", "query_id", "id")


def _position(spark, folder):
    rows = vectors(spark, folder)
    ranked = V.nearest(rows.where("id = 0"), rows, 50, "l2").select("id", "rank")
    return rank_position(ranked, rows.select("id"), "id")


def _rerank(spark, folder):
    first = top(bm25_scores(stored(spark, folder), QUERY).withColumn("score", F.round("score", 6)), 500)
    rows = vectors(spark, folder)
    kept = rows.join(first.select(F.col("doc_id").alias("id")), "id", "left_semi")
    return V.nearest(rows.where("id = 0"), kept, 50, "l2").select(F.col("id").alias("doc_id"), F.round("distance", 6).alias("distance"), "rank")


def _ann(spark, folder):
    rows = vectors(spark, folder)
    centres, probes = V.fit_cells(rows, k=K)
    found = V.nearest_by_cells(_asked(rows), rows, K, centres, probes, "l2", skip_self=True)
    return found.withColumn("distance", F.round("distance", 6))


def _ann_recall(spark, folder):
    rows = vectors(spark, folder)
    return V.recall(_ann(spark, folder), V.nearest(_asked(rows), rows, K, "l2", skip_self=True))


def tree(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "category_tree_table").select(category_name("category").alias("category"), "vector").where("category IS NOT NULL")


def tree_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "category_tree_table").select("category", namespace("category").alias("namespace"))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return G.clean_edges(table(spark, folder, "category_edge").select(category_name("src").alias("src"), category_name("dst").alias("dst")))


def members(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "category_doc").select(category_name("category").alias("category"), "doc_id")
    return rows.where("category IS NOT NULL AND doc_id IS NOT NULL").distinct()


def tops(spark: SparkSession, folder: str) -> DataFrame:
    return G.roots(edges(spark, folder))


def _nearest_link(spark, folder):
    good = V.good_vectors(tree(spark, folder), "vector", CATEGORY_DIMS).groupBy("category").agg(F.min("vector").alias("vector"))
    good = good.join(dense_ids(good, "category"), "category")
    linked = G.nodes_of(edges(spark, folder)).withColumnRenamed("node", "category")
    missing, known = good.join(linked, "category", "left_anti"), good.join(linked, "category", "left_semi")
    found = V.nearest(missing, known, 1, "cosine")
    names = good.select("id", "category")
    named = found.join(names, "id").withColumnRenamed("category", "src").join(names.select(F.col("id").alias("query_id"), F.col("category").alias("dst")), "query_id")
    return named.select("src", "dst", F.round(1 - F.col("distance"), 6).alias("similarity"))


def page(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "page")


def _redirect():
    return F.coalesce("redirect", F.lit("")).rlike(r"(?U)\S")


def _page_extract(spark, folder):
    rows = page(spark, folder).where("sha1 IS NOT NULL")
    return rows.select("page_id", "file", clean_sha1("sha1").alias("sha1"), _redirect().alias("is_redirect"), F.concat_ws("\n\n", "title", "text").alias("text")).distinct()


def _redirect_anti(spark, folder):
    rows = page(spark, folder).where("sha1 IS NOT NULL").select("page_id", "file", clean_sha1("sha1").alias("sha1"), "redirect")
    invalid = rows.where(_redirect()).select("file", "sha1")
    return rows.select("page_id", "file", "sha1").distinct().join(invalid, ["file", "sha1"], "left_anti").select("page_id", "sha1")


def _category_extract(spark, folder):
    lines = articles(page(spark, folder)).select("page_id", F.explode(F.split("text", r"\r\n|\r|\n")).alias("line"))
    links = lines.where(F.col("line").startswith("[[Category:") & F.col("line").endswith("]]"))
    return links.select("page_id", category_name(F.regexp_replace("line", r"^\[\[|\]\]$", "")).alias("category")).distinct()


def _category_wordfreq(spark, folder):
    counts = term_freq(articles(page(spark, folder)).withColumnRenamed("page_id", "doc_id"))
    return members(spark, folder).join(counts, "doc_id").groupBy("category", "word").agg(F.sum("tf").alias("tf"))


def _category_wordfreq_rollup(spark, folder):
    counts = term_freq(articles(page(spark, folder)).withColumnRenamed("page_id", "doc_id"))
    links = G.without_cycles(edges(spark, folder), tops(spark, folder))
    return G.roll_up_words(links, members(spark, folder).withColumnRenamed("category", "node"), counts)


def _coverage_gap(spark, folder):
    return articles(page(spark, folder)).select(F.col("page_id").alias("doc_id")).join(members(spark, folder).select("doc_id").distinct(), "doc_id", "left_anti")


def _names(spark, folder):
    return tree(spark, folder).select("category").distinct(), G.nodes_of(edges(spark, folder)).withColumnRenamed("node", "category")


def _same(spark, folder):
    links = edges(spark, folder)
    return G.same_graph(links, links.select("src", "dst").unionByName(links)).union(G.same_graph(links, links.where("src < dst")))


def _resume_open(spark, folder):
    """Pages of the files to be read again: a file is finished if its documents were loaded last after its last page arrived."""
    pages = page(spark, folder).where("file IS NOT NULL").select("page_id", "file", "loaded_at")
    arrived = pages.groupBy("file").agg(F.max("loaded_at").alias("arrived"))
    loaded = table(spark, folder, "documents").groupBy("file").agg(F.max("loaded_at").alias("loaded"))
    return U.resume(pages.select("page_id", "file").distinct(), arrived.join(loaded, "file").where("loaded >= arrived"), "file").select("page_id", "file")


def _ensemble(spark, folder):
    """For each label the ten rows nearest to any of its queries: an ensemble of queries answers as one."""
    rows = vectors(spark, folder)
    found = V.nearest(_asked(rows), rows, K, "cosine", skip_self=True)
    labelled = found.join(F.broadcast(_asked(rows).select(F.col("id").alias("query_id"), "label")), "query_id")
    best = labelled.groupBy("label", "id").agg(F.min("distance").alias("distance")).withColumn("score", -F.col("distance"))
    return top_per_group(best, "label", K, "score", "id").select("label", "id", F.round("distance", 6).alias("distance"), "rank")


def _stored_vectors(spark, folder):
    """The vectors written to a store in two parts, one of them narrowed to a query's table, and read again."""
    rows = vectors(spark, folder).select("id", "vector", "label")
    store = VectorStore(spark, f"{shared_folder(spark)}/vectors-{uuid4().hex}", DIMS)
    store.create("all", rows.where("label < 5"))
    store.append("all", rows.where("label >= 5"))
    name = store.query_name(QUERY)
    store.create(name, store.open("all").where("label = 3"))
    narrowed = store.open(name)
    return store.open("all").join(narrowed.select("id", F.lit(True).alias("kept")), "id", "left").select("id", "label", F.coalesce("kept", F.lit(False)).alias("kept"))


def _page_xml(spark, folder):
    """The pages written as a dump and scanned again: titles, redirects and sha1."""
    path = f"{shared_folder(spark)}/dump-{uuid4().hex}"
    write_pages(page(spark, folder).where("sha1 IS NOT NULL AND title IS NOT NULL"), path)
    return read_pages(spark, path).select("title", "sha1", F.length(F.translate("text", "\r\n \t\u00a0", "")).alias("chars"))


def _convert_equal(spark, folder):
    """Is a table the same after it went through another format? One row per format."""
    at = f"{shared_folder(spark)}/formats-{uuid4().hex}"
    rows = [(form, convert_table(spark, f"{folder}/category_doc.parquet", "parquet", f"{at}/{form}", form)) for form in ("json", "orc", "csv")]
    return spark.createDataFrame(rows, "form string, same boolean")


def _category_edges(spark, folder):
    """Edges from the categories that a page names in its text to the page itself, by its title, as among pages of categories."""
    pages = page(spark, folder).where("title IS NOT NULL AND text IS NOT NULL").select(category_name("title").alias("dst"), "text")
    lines = pages.select("dst", F.explode(F.split("text", r"\r\n|\r|\n")).alias("line"))
    links = lines.where(F.col("line").startswith("[[Category:") & F.col("line").endswith("]]"))
    return links.select(category_name(F.regexp_replace("line", r"^\[\[|\]\]$", "")).alias("src"), "dst").distinct()


QUERIES = {
    "ensemble_knn": _ensemble,
    "stored_vectors": _stored_vectors,
    "page_xml": _page_xml,
    "convert_equal": _convert_equal,
    "title_edges": _category_edges,
    "namespace_counts": lambda s, f: tree_names(s, f).groupBy("namespace").agg(F.count("*").alias("names")),
    "article_titles": lambda s, f: page(s, f).where((namespace("title") != 14) & ~_redirect()).select("title").distinct(),
    "value_stats": lambda s, f: table(s, f, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean")),
    "codec_zip": lambda s, f: table(s, f, "documents").select("doc_id", (inflated(deflated("text")) == F.col("text")).alias("same"), (F.length(deflated("text")) > 0).alias("packed")),
    "subset_open": lambda s, f: U.subset_violations(members(s, f), articles(page(s, f)).select(F.col("page_id").alias("doc_id")), "doc_id"),
    "coverage_open": lambda s, f: G.nodes_of(edges(s, f)).withColumnRenamed("node", "category").join(members(s, f).select("category").distinct(), "category", "left_anti"),
    "bad_vector_filter": lambda s, f: V.good_vectors(tree(s, f), "vector", CATEGORY_DIMS).groupBy("category").agg(F.count("*").alias("rows")),
    "knn_l2": _knn("l2"),
    "knn_cosine": _knn("cosine"),
    "knn_filtered": _knn_filtered,
    "multi_query_knn": _multi,
    "round_robin": _multi,
    "rank_position": _position,
    "rerank": _rerank,
    "ann_search": _ann,
    "ann_recall": _ann_recall,
    "nearest_link": _nearest_link,
    "page_extract": _page_extract,
    "redirect_anti": _redirect_anti,
    "redirect_counts": lambda s, f: page(s, f).groupBy("file").agg(F.countDistinct(F.when(_redirect(), F.col("page_id"))).alias("redirects"), F.countDistinct(F.when(~_redirect(), F.col("page_id"))).alias("articles")),
    "resume_anti": lambda s, f: U.resume(page(s, f).select("page_id", "file"), page(s, f).where("page_id % 2 = 0").select("file"), "file").distinct(),
    "resume_open": _resume_open,
    "codec_roundtrip": lambda s, f: table(s, f, "documents").select("doc_id", F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "").alias("packed"), (F.decode(F.unbase64(F.base64(F.encode("text", "UTF-8"))), "UTF-8") == F.col("text")).alias("same")),
    "category_norm": lambda s, f: tree(s, f).groupBy("category").agg(F.count("*").alias("rows")),
    "category_extract": _category_extract,
    "category_anti": lambda s, f: U.difference(_names(s, f)[1], _names(s, f)[0]),
    "category_copy": lambda s, f: members(s, f).join(_names(s, f)[1], "category", "left_semi"),
    "set_difference": lambda s, f: U.difference(_names(s, f)[0], _names(s, f)[1]),
    "set_intersect": lambda s, f: U.intersection(*_names(s, f)),
    "union_all": lambda s, f: members(s, f).where("doc_id % 2 = 0").unionByName(members(s, f).where("doc_id % 3 = 0")),
    "union_names": lambda s, f: _names(s, f)[0].unionByName(_names(s, f)[1]),
    "filter_map": lambda s, f: U.filter_groups(members(s, f), articles(page(s, f)).select(F.col("page_id").alias("doc_id")), "category", "doc_id"),
    "subset_check": lambda s, f: U.subset_violations(members(s, f), page(s, f).select(F.col("page_id").alias("doc_id")).distinct(), "doc_id"),
    "coverage_gap": _coverage_gap,
    "coverage_count": lambda s, f: members(s, f).groupBy("category").agg(F.countDistinct("doc_id").alias("docs")).orderBy(F.desc("docs"), "category").limit(100),
    "category_wordfreq": _category_wordfreq,
    "category_rollup": lambda s, f: G.roll_up(G.without_cycles(edges(s, f), tops(s, f)), members(s, f).withColumnRenamed("category", "node")),
    "category_wordfreq_rollup": _category_wordfreq_rollup,
    "graph_roots": tops,
    "graph_bfs": lambda s, f: G.levels(edges(s, f), tops(s, f), max_depth=5),
    "graph_depth": lambda s, f: G.node_depths(edges(s, f), tops(s, f)),
    "graph_leaves": lambda s, f: G.leaves(edges(s, f), tops(s, f), max_depth=5),
    "graph_dag": lambda s, f: G.without_cycles(edges(s, f), tops(s, f)),
    "graph_equal": _same,
    "set_cover_greedy": lambda s, f: G.greedy_cover(members(s, f).select(F.col("category").alias("name"), F.col("doc_id").alias("item"))),
}


def _norm(column: str) -> str:
    return f"trim(regexp_replace(trim(regexp_replace(translate({column}, '''\"', ''), '[\\s_]+', ' ', 'g')), '^category:', '', 'i'))"


_GOOD = f"good AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)"
_ARTICLE = "article AS (SELECT page_id, min(text) AS text FROM page WHERE page_id IS NOT NULL AND text IS NOT NULL AND NOT regexp_matches(coalesce(redirect, ''), '\\S') GROUP BY page_id)"
_TREE = f"tree AS (SELECT {_norm('category')} AS category, vector FROM category_tree_table WHERE category IS NOT NULL)"
_EDGES = f"""edges AS (SELECT DISTINCT {_norm('src')} AS src, {_norm('dst')} AS dst FROM category_edge WHERE src IS NOT NULL AND dst IS NOT NULL),
nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), tops AS (SELECT node FROM nodes WHERE node NOT IN (SELECT dst FROM edges))"""
_MEMBERS = f"members AS (SELECT DISTINCT {_norm('category')} AS category, doc_id FROM category_doc WHERE category IS NOT NULL AND doc_id IS NOT NULL)"
_WALK = """walk AS (SELECT node, CAST(0 AS BIGINT) AS depth FROM tops UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON w.node = e.src WHERE w.depth < 200),
levels AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)"""
_DAG = "dag AS (SELECT e.src, e.dst FROM edges e JOIN levels a ON e.src = a.node JOIN levels b ON e.dst = b.node WHERE b.depth > a.depth)"


def _knn_sql(distance: str, where: str = "TRUE") -> str:
    return f"""WITH {_GOOD}, pairs AS (SELECT a.id AS query_id, b.id, round({distance}, 9) AS distance FROM good a JOIN good b ON a.id <> b.id WHERE a.id % 20 = 0 AND {where}),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pairs)
        SELECT query_id, id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {K}"""


_COS, _L2 = "1 - list_cosine_similarity(a.v, b.v)", "list_distance(a.v, b.v)"
_ROBIN = f"WITH ranked AS ({_knn_sql(_COS)}) SELECT row_number() OVER (ORDER BY rank, query_id) AS place, query_id, id FROM ranked"
_SPACELESS = "translate({0}, chr(13) || chr(10) || chr(32) || chr(9) || chr(160), '')"
SQL = {
    "ensemble_knn": f"""WITH {_GOOD}, pairs AS (SELECT a.id AS query_id, a.label, b.id, round({_COS}, 9) AS distance FROM good a JOIN good b ON a.id <> b.id WHERE a.id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS n FROM pairs), best AS (SELECT label, id, min(distance) AS distance FROM r WHERE n <= {K} GROUP BY label, id),
        t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, id) AS rank FROM best) SELECT label, id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= {K}""",
    "stored_vectors": f"WITH {_GOOD} SELECT id, label, coalesce(label = 3, FALSE) AS kept FROM good WHERE label IS NOT NULL",
    "page_xml": f"SELECT title, regexp_replace(sha1, '\\s', '', 'g') AS sha1, CAST(length({_SPACELESS.format('text')}) AS INTEGER) AS chars FROM page WHERE sha1 IS NOT NULL AND title IS NOT NULL",
    "convert_equal": "SELECT unnest(['json', 'orc', 'csv']) AS form, TRUE AS same",
    "title_edges": f"WITH rows AS (SELECT DISTINCT {_norm('title')} AS dst, text FROM page WHERE title IS NOT NULL AND text IS NOT NULL), lines AS (SELECT dst, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line FROM rows), links AS (SELECT dst, regexp_replace(line, '^\\[\\[|\\]\\]$', '', 'g') AS c FROM lines WHERE starts_with(line, '[[Category:') AND ends_with(line, ']]')) SELECT DISTINCT {_norm('c')} AS src, dst FROM links",
    "namespace_counts": "SELECT CAST(CASE WHEN category IS NULL THEN NULL WHEN lower(trim(regexp_extract(category, '^([^:]*):', 1))) = 'category' THEN 14 ELSE 0 END AS INTEGER) AS namespace, count(*) AS names FROM category_tree_table GROUP BY 1",
    "article_titles": "SELECT DISTINCT title FROM page WHERE title IS NOT NULL AND NOT starts_with(lower(title), 'category:') AND NOT regexp_matches(coalesce(redirect, ''), '\\S')",
    "value_stats": "SELECT event_type, count(value) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
    "codec_zip": "SELECT doc_id, CASE WHEN text IS NOT NULL THEN TRUE END AS same, CASE WHEN text IS NOT NULL THEN TRUE END AS packed FROM documents",
    "subset_open": f"WITH {_MEMBERS}, {_ARTICLE} SELECT DISTINCT doc_id FROM members WHERE doc_id NOT IN (SELECT page_id FROM article)",
    "coverage_open": f"WITH {_EDGES}, {_MEMBERS} SELECT node AS category FROM nodes WHERE node NOT IN (SELECT category FROM members)",
    "bad_vector_filter": f"WITH {_TREE} SELECT category, count(*) AS rows FROM tree WHERE len(vector) = {CATEGORY_DIMS} AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 GROUP BY category",
    "knn_l2": _knn_sql(_L2),
    "knn_cosine": _knn_sql(_COS),
    "knn_filtered": _knn_sql(_COS, "b.label < 5"),
    "multi_query_knn": _ROBIN,
    "round_robin": _ROBIN,
    "rank_position": f"WITH {_GOOD}, r AS (SELECT b.id, row_number() OVER (ORDER BY round({_L2}, 9), b.id) AS rank FROM good a, good b WHERE a.id = 0) SELECT g.id, CAST(CASE WHEN rank <= 50 THEN rank - 1 ELSE -1 END AS BIGINT) AS position FROM good g LEFT JOIN r ON g.id = r.id",
    "rerank": bm25_sql(False, f", {_GOOD}, first AS (SELECT doc_id FROM s ORDER BY score DESC, doc_id LIMIT 500), d AS (SELECT b.id AS doc_id, {_L2} AS distance FROM good a, good b WHERE a.id = 0 AND b.id IN (SELECT doc_id FROM first)), r AS (SELECT *, row_number() OVER (ORDER BY round(distance, 9), doc_id) AS rank FROM d) SELECT doc_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 50"),
    "nearest_link": f"""WITH {_TREE}, {_EDGES}, good AS (SELECT category, CAST(min(vector) AS DOUBLE[]) AS v FROM tree WHERE len(vector) = {CATEGORY_DIMS} AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 GROUP BY category),
        pairs AS (SELECT b.category AS src, a.category AS dst, list_cosine_similarity(a.v, b.v) AS similarity FROM good a, good b WHERE a.category NOT IN (SELECT node FROM nodes) AND b.category IN (SELECT node FROM nodes)),
        r AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY round(1 - similarity, 9), src) AS n FROM pairs) SELECT src, dst, round(similarity, 6) AS similarity FROM r WHERE n = 1""",
    "page_extract": "SELECT DISTINCT page_id, file, regexp_replace(sha1, '\\s', '', 'g') AS sha1, regexp_matches(coalesce(redirect, ''), '\\S') AS is_redirect, concat_ws(chr(10) || chr(10), title, text) AS text FROM page WHERE sha1 IS NOT NULL",
    "redirect_anti": "WITH rows AS (SELECT page_id, file, regexp_replace(sha1, '\\s', '', 'g') AS sha1, regexp_matches(coalesce(redirect, ''), '\\S') AS r FROM page WHERE sha1 IS NOT NULL) SELECT page_id, sha1 FROM (SELECT DISTINCT page_id, file, sha1 FROM rows) a WHERE NOT EXISTS (SELECT 1 FROM rows b WHERE b.r AND a.file = b.file AND a.sha1 = b.sha1)",
    "redirect_counts": "SELECT file, count(DISTINCT page_id) FILTER (regexp_matches(coalesce(redirect, ''), '\\S')) AS redirects, count(DISTINCT page_id) FILTER (NOT regexp_matches(coalesce(redirect, ''), '\\S')) AS articles FROM page GROUP BY file",
    "resume_anti": "SELECT DISTINCT page_id, file FROM page a WHERE NOT EXISTS (SELECT 1 FROM page b WHERE b.page_id % 2 = 0 AND a.file = b.file)",
    "resume_open": "SELECT DISTINCT page_id, file FROM page a WHERE file IS NOT NULL AND file NOT IN (SELECT p.file FROM (SELECT file, max(loaded_at) AS arrived FROM page GROUP BY file) p JOIN (SELECT file, max(loaded_at) AS loaded FROM documents GROUP BY file) d ON p.file = d.file WHERE loaded >= arrived)",
    "codec_roundtrip": "SELECT doc_id, to_base64(encode(text)) AS packed, decode(from_base64(to_base64(encode(text)))) = text AS same FROM documents",
    "category_norm": f"WITH {_TREE} SELECT category, count(*) AS rows FROM tree GROUP BY category",
    "category_extract": f"WITH {_ARTICLE}, lines AS (SELECT page_id, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line FROM article), links AS (SELECT page_id, regexp_replace(line, '^\\[\\[|\\]\\]$', '', 'g') AS c FROM lines WHERE starts_with(line, '[[Category:') AND ends_with(line, ']]')) SELECT DISTINCT page_id, {_norm('c')} AS category FROM links",
    "category_anti": f"WITH {_TREE}, {_EDGES} SELECT DISTINCT category FROM tree WHERE category NOT IN (SELECT node FROM nodes)",
    "category_copy": f"WITH {_MEMBERS}, {_EDGES} SELECT * FROM members WHERE category IN (SELECT node FROM nodes)",
    "set_difference": f"WITH {_TREE}, {_EDGES} SELECT node AS category FROM nodes WHERE node NOT IN (SELECT category FROM tree)",
    "set_intersect": f"WITH {_TREE}, {_EDGES} SELECT DISTINCT category FROM tree WHERE category IN (SELECT node FROM nodes)",
    "union_all": f"WITH {_MEMBERS} SELECT * FROM members WHERE doc_id % 2 = 0 UNION ALL SELECT * FROM members WHERE doc_id % 3 = 0",
    "union_names": f"WITH {_TREE}, {_EDGES} SELECT DISTINCT category FROM tree UNION ALL SELECT node FROM nodes",
    "filter_map": f"WITH {_MEMBERS}, {_ARTICLE} SELECT category, count(page_id) AS items FROM members LEFT JOIN article ON doc_id = page_id GROUP BY category",
    "subset_check": f"WITH {_MEMBERS} SELECT DISTINCT doc_id FROM members WHERE NOT EXISTS (SELECT 1 FROM page WHERE page_id = doc_id)",
    "coverage_gap": f"WITH {_MEMBERS}, {_ARTICLE} SELECT page_id AS doc_id FROM article WHERE NOT EXISTS (SELECT 1 FROM members WHERE page_id = doc_id)",
    "coverage_count": f"WITH {_MEMBERS} SELECT category, count(*) AS docs FROM members GROUP BY category ORDER BY docs DESC, category LIMIT 100",
    "category_wordfreq": f"WITH {_MEMBERS}, {_ARTICLE}, token AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM article), tf AS (SELECT doc_id, word, count(*) AS tf FROM token GROUP BY ALL) SELECT category, word, CAST(sum(tf) AS BIGINT) AS tf FROM members JOIN tf USING (doc_id) GROUP BY ALL",
    "category_rollup": f"WITH RECURSIVE {_EDGES}, {_WALK}, {_DAG}, {_MEMBERS}, up AS (SELECT category AS node, doc_id FROM members UNION SELECT d.src, u.doc_id FROM up u JOIN dag d ON u.node = d.dst) SELECT node, count(*) AS docs FROM up GROUP BY node",
    "category_wordfreq_rollup": f"WITH RECURSIVE {_EDGES}, {_WALK}, {_DAG}, {_MEMBERS}, {_ARTICLE}, up AS (SELECT category AS node, doc_id FROM members UNION SELECT d.src, u.doc_id FROM up u JOIN dag d ON u.node = d.dst), token AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM article), tf AS (SELECT doc_id, word, count(*) AS tf FROM token GROUP BY ALL) SELECT node, word, CAST(sum(tf) AS BIGINT) AS tf FROM up JOIN tf USING (doc_id) GROUP BY ALL",
    "graph_roots": f"WITH {_EDGES} SELECT node FROM tops",
    "graph_bfs": f"WITH RECURSIVE {_EDGES}, {_WALK} SELECT node, depth FROM levels WHERE depth <= 5",
    "graph_depth": f"WITH RECURSIVE {_EDGES}, {_WALK} SELECT n.node, coalesce(depth, -1) AS depth FROM nodes n LEFT JOIN levels l ON n.node = l.node",
    "graph_leaves": f"WITH RECURSIVE {_EDGES}, {_WALK} SELECT node, depth FROM levels WHERE depth <= 5 AND node NOT IN (SELECT src FROM edges)",
    "graph_dag": f"WITH RECURSIVE {_EDGES}, {_WALK}, {_DAG} SELECT src, dst FROM dag",
    "graph_equal": f"WITH {_EDGES} SELECT TRUE AS same UNION ALL SELECT count(*) = 0 FROM edges WHERE NOT src < dst",
}
