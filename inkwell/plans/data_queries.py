"""Queries of the general data problems: hierarchies (1) and nested records (5), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.names import category_name
from inkwell.operators.hierarchy import hierarchy
from inkwell.operators.nested import flatten_records, table_of
from inkwell.sources.tables import table


def category_forest(spark: SparkSession, folder: str, paths: bool = False) -> DataFrame:
    nodes = table(spark, folder, "category_tree_table").select(category_name("category").alias("name"))
    edges = table(spark, folder, "category_edge").select(category_name("src").alias("src"), category_name("dst").alias("dst"))
    return hierarchy(nodes, edges, paths)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return category_forest(spark, folder).select(F.col("name").alias("category"), "root", "depth")


def p1_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    forest = category_forest(spark, folder, paths=True)
    return forest.select(F.col("name").alias("category"), "parent", "root", "depth", "descendants", F.array_join("path", " / ").alias("path"))


def p1_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each category and each category below it. Paths hold the ancestors, so the work grows with the rows that come out."""
    forest = category_forest(spark, folder, paths=True).where("depth > 0")
    above = forest.select(F.col("name").alias("descendant"), "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth").cast("int"))).alias("place", "category"))
    return above.select("category", "descendant", (F.col("depth") - F.col("place")).alias("distance"))


def p1_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Positions below the root: v's descendants are the categories u of its root with v.first < u.first <= v.last."""
    return category_forest(spark, folder).where("depth >= 0").select(F.col("name").alias("category"), "root", "first", "last")


def p1_spans(spark: SparkSession, folder: str) -> DataFrame:
    """How many positions each category's interval holds, and whether the first is that of the root."""
    rows = p1_intervals(spark, folder)
    return rows.select("category", "root", (F.col("last") - F.col("first")).alias("span"), (F.col("first") == 0).alias("top"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = flatten_records(table(spark, folder, "raw_record"), ["record_id", "sha1", "id", "parent_id"], ("section",))
    return rows.withColumnRenamed("id", "section_id").distinct()


def p5_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table_of(table(spark, folder, "raw_record"), "page")


def p5_revisions(spark: SparkSession, folder: str) -> DataFrame:
    return table_of(table(spark, folder, "raw_record"), "revision")


def p5_sections(spark: SparkSession, folder: str) -> DataFrame:
    return table_of(table(spark, folder, "raw_record"), "section")


def p5_notes(spark: SparkSession, folder: str) -> DataFrame:
    return table_of(table(spark, folder, "raw_record"), "note")


NAMES_SQL = """
names AS (SELECT trim(regexp_replace(trim(regexp_replace(translate(n, '''"', ''), '[\\s_]+', ' ', 'g')), '^category:', '', 'i')) AS name
  FROM (SELECT category AS n FROM category_tree_table UNION ALL SELECT src FROM category_edge UNION ALL SELECT dst FROM category_edge) WHERE n IS NOT NULL GROUP BY 1),
links AS (SELECT dst AS name, min(src) AS parent FROM (
  SELECT trim(regexp_replace(trim(regexp_replace(translate(src, '''"', ''), '[\\s_]+', ' ', 'g')), '^category:', '', 'i')) AS src,
         trim(regexp_replace(trim(regexp_replace(translate(dst, '''"', ''), '[\\s_]+', ' ', 'g')), '^category:', '', 'i')) AS dst
  FROM category_edge WHERE src IS NOT NULL AND dst IS NOT NULL) GROUP BY dst),
nodes AS (SELECT n.name, l.parent FROM names n LEFT JOIN links l ON n.name = l.name),
down AS (SELECT name, parent, name AS root, CAST(0 AS BIGINT) AS depth, name AS path FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.name, n.parent, d.root, d.depth + 1, d.path || ' / ' || n.name FROM nodes n JOIN down d ON n.parent = d.name)
"""

# objects of the decoded payloads with their paths; the longest path that another continues is the nearest object around it
SECTIONS_SQL = r"""
opened AS (SELECT DISTINCT record_id, CAST(payload AS VARCHAR) AS p, 0 AS n FROM raw_record WHERE json_valid(payload)
  UNION ALL SELECT record_id, json_extract_string(p, '$'), n + 1 FROM opened WHERE n < 8 AND json_type(p) = 'VARCHAR' AND json_valid(json_extract_string(p, '$'))),
tree AS (SELECT record_id, t.fullkey, CAST(t.value AS VARCHAR) AS v, regexp_extract(t.fullkey, '\.([^.\[\]]+)(\[[0-9]+\])*$', 1) AS k
  FROM opened, json_tree(CAST(p AS JSON)) t WHERE json_type(p) <> 'VARCHAR' AND t.type = 'OBJECT'),
section AS (SELECT record_id, fullkey, CAST(json_extract(v, '$.id') AS BIGINT) AS id FROM tree WHERE k IN ('sections', 'children')),
revision AS (SELECT record_id, fullkey, regexp_replace(json_extract_string(v, '$.sha1'), '\s', '', 'g') AS sha1 FROM tree WHERE k IN ('revision', 'revisions'))
"""
# the same with Dewey labels: the ordinals of all keys and array places on the way, counted from 1 as they stand in the payload
OBJECTS_SQL = r"""
opened AS (SELECT DISTINCT record_id, CAST(payload AS VARCHAR) AS p, 0 AS n FROM raw_record WHERE json_valid(payload)
  UNION ALL SELECT record_id, json_extract_string(p, '$'), n + 1 FROM opened WHERE n < 8 AND json_type(p) = 'VARCHAR' AND json_valid(json_extract_string(p, '$'))),
walk AS (SELECT DISTINCT record_id, '1' AS label, CAST(NULL AS VARCHAR) AS k, CAST(p AS JSON) AS v FROM opened WHERE json_type(p) IN ('OBJECT', 'ARRAY')
  UNION ALL SELECT record_id, w.label || '.' || (c.i), CASE WHEN json_type(w.v) = 'ARRAY' THEN w.k ELSE c.k END, c.v FROM walk w,
    LATERAL (SELECT unnest(range(1, 1 + CAST(CASE WHEN json_type(w.v) = 'ARRAY' THEN json_array_length(w.v) ELSE len(json_keys(w.v)) END AS BIGINT))) AS i) AS n(i),
    LATERAL (SELECT n.i AS i, CASE WHEN json_type(w.v) = 'OBJECT' THEN json_keys(w.v)[n.i] END AS k,
      CASE WHEN json_type(w.v) = 'ARRAY' THEN json_extract(w.v, '$[' || (n.i - 1) || ']') ELSE json_extract(w.v, '$."' || json_keys(w.v)[n.i] || '"') END AS v) AS c
    WHERE json_type(w.v) IN ('OBJECT', 'ARRAY') AND json_type(c.v) IN ('OBJECT', 'ARRAY')),
kinds AS (SELECT record_id, label, v, CASE WHEN k IN ('page', 'pages') THEN 'page' WHEN k IN ('revision', 'revisions') THEN 'revision'
  WHEN k IN ('sections', 'children') THEN 'section' WHEN k IN ('note', 'notes') THEN 'note' END AS kind FROM walk WHERE json_type(v) = 'OBJECT'),
object AS (SELECT * FROM kinds WHERE kind IS NOT NULL)
"""
_OUTER_SQL = "object o"
_NEAREST = "(SELECT arg_max(a.{0}, length(a.label)) FROM object a WHERE a.record_id = o.record_id AND starts_with(o.label, a.label || '.'))"
_NUMBER_SQL = "TRY_CAST(json_extract_string({0}.v, '$.id') AS BIGINT)"


def _near(kind: str, value: str) -> str:
    return f"(SELECT arg_max({value}, length(a.label)) FROM object a WHERE a.kind = '{kind}' AND a.record_id = o.record_id AND starts_with(o.label, a.label || '.'))"


_OUTER_ID = "coalesce((SELECT arg_max({0}, length(a.label)) FROM object a WHERE a.record_id = o.record_id AND starts_with(o.label, a.label || '.')), 0)".format(_NUMBER_SQL.format("a"))
_ABOVE_SQL = f"{_NEAREST.format('kind')} AS parent_kind, {_NEAREST.format('label')} AS parent_label"


def _text_sql(key: str) -> str:
    field = f"json_extract(o.v, '$.{key}')"
    inner = ", ".join(f"CASE WHEN json_type({field}, '$.{k}') = 'VARCHAR' THEN json_extract_string({field}, '$.{k}') END" for k in ("value", "title", '"#text"'))
    return f"CASE json_type({field}) WHEN 'VARCHAR' THEN json_extract_string({field}, '$') WHEN 'OBJECT' THEN coalesce({inner}) END"


_AROUND = "{0}.record_id = s.record_id AND (starts_with(s.fullkey, {0}.fullkey || '.') OR starts_with(s.fullkey, {0}.fullkey || '['))"

QUERIES = {"p1_found": p1_found, "p1_hierarchy": p1_hierarchy, "p1_descendants": p1_descendants, "p1_intervals": p1_intervals, "p1_spans": p1_spans, "p5_found": p5_found, "p5_pages": p5_pages, "p5_revisions": p5_revisions,
           "p5_sections": p5_sections, "p5_notes": p5_notes}
SQL = {
    "p1_found": f"WITH RECURSIVE {NAMES_SQL} SELECT n.name AS category, coalesce(d.root, '') AS root, coalesce(d.depth, -1) AS depth FROM nodes n LEFT JOIN down d ON n.name = d.name",
    "p1_hierarchy": f"""WITH RECURSIVE {NAMES_SQL},
        up AS (SELECT name AS below, parent AS above FROM down WHERE parent IS NOT NULL
          UNION ALL SELECT u.below, n.parent FROM up u JOIN nodes n ON u.above = n.name WHERE n.parent IS NOT NULL),
        sizes AS (SELECT above, count(*) AS descendants FROM up GROUP BY above)
        SELECT n.name AS category, n.parent, coalesce(d.root, '') AS root, coalesce(d.depth, -1) AS depth,
          CASE WHEN d.name IS NULL THEN NULL ELSE coalesce(s.descendants, 0) END AS descendants, d.path
        FROM nodes n LEFT JOIN down d ON n.name = d.name LEFT JOIN sizes s ON n.name = s.above""",
    "p1_descendants": f"""WITH RECURSIVE {NAMES_SQL},
        up AS (SELECT name AS below, parent AS above, CAST(1 AS BIGINT) AS distance FROM down WHERE parent IS NOT NULL
          UNION ALL SELECT u.below, n.parent, u.distance + 1 FROM up u JOIN nodes n ON u.above = n.name WHERE n.parent IS NOT NULL)
        SELECT above AS category, below AS descendant, distance FROM up""",
    "p1_spans": f"""WITH RECURSIVE {NAMES_SQL}, up AS (SELECT name AS below, parent AS above FROM down WHERE parent IS NOT NULL
          UNION ALL SELECT u.below, n.parent FROM up u JOIN nodes n ON u.above = n.name WHERE n.parent IS NOT NULL),
        sizes AS (SELECT above, count(*) AS n FROM up GROUP BY above)
        SELECT d.name AS category, d.root, coalesce(s.n, 0) AS span, d.depth = 0 AS top FROM down d LEFT JOIN sizes s ON d.name = s.above""",
    "p5_pages": f"""WITH RECURSIVE {OBJECTS_SQL} SELECT o.record_id, label, {_ABOVE_SQL}, {_text_sql("title")} AS title, {_text_sql("redirect")} AS redirect FROM {_OUTER_SQL} WHERE o.kind = 'page'""",
    "p5_revisions": f"""WITH RECURSIVE {OBJECTS_SQL} SELECT o.record_id, label, {_ABOVE_SQL}, regexp_replace({_text_sql("sha1")}, '\\s', '', 'g') AS sha1, {_text_sql("text")} AS text FROM {_OUTER_SQL} WHERE o.kind = 'revision'""",
    "p5_sections": f"""WITH RECURSIVE {OBJECTS_SQL} SELECT o.record_id, label, {_ABOVE_SQL}, {_NUMBER_SQL.format("o")} AS id, coalesce({_near("section", _NUMBER_SQL.format("a"))}, 0) AS parent_id,
        regexp_replace({_near("revision", "json_extract_string(a.v, '$.sha1')")}, '\\s', '', 'g') AS sha1, {_text_sql("heading")} AS heading, {_text_sql("text")} AS text,
        {_near("page", "a.label")} AS page_label, {_near("revision", "a.label")} AS revision_label FROM {_OUTER_SQL} WHERE o.kind = 'section'""",
    "p5_notes": f"""WITH RECURSIVE {OBJECTS_SQL} SELECT o.record_id, label, {_ABOVE_SQL}, {_NUMBER_SQL.format("o")} AS id, {_OUTER_ID} AS parent_id, {_text_sql("label")} AS heading FROM {_OUTER_SQL} WHERE o.kind = 'note'""",
    "p5_found": f"""WITH RECURSIVE {SECTIONS_SQL} SELECT DISTINCT s.record_id,
        (SELECT arg_max(r.sha1, length(r.fullkey)) FROM revision r WHERE {_AROUND.format("r")}) AS sha1, s.id AS section_id,
        coalesce((SELECT arg_max(o.id, length(o.fullkey)) FROM section o WHERE {_AROUND.format("o")}), 0) AS parent_id FROM section s""",
}
