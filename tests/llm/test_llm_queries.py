import hashlib
import math
from pathlib import Path

import duckdb
import pytest

from inkwell.llm import queries
from inkwell.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, data, name):
    con = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    df = QUERIES[name](spark, data)
    found = con.execute(SQL[name])
    columns = [d[0] for d in found.description]
    order = [columns.index(c) for c in df.columns]
    theirs = sorted(tuple(row[i] for i in order) for row in found.fetchall())
    ours = sorted(tuple(r) for r in df.collect())
    assert len(ours) == len(theirs)
    assert all(a == b or math.isclose(a, b, abs_tol=2e-6) for x, y in zip(ours, theirs) for a, b in zip(x, y))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


FOUND = {
    "p2_found": ["word", "mark"], "p3_found": ["page_id", "kind"], "p4_found": ["page_id"], "p6_found": ["page_id", "word"],
    "p7_found": ["page_id", "para_no"], "p8_found": ["doc_id", "item_id"], "p9_found": ["source"], "p10_found": ["doc_id", "sent_end"],
}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_found_columns(spark, data, name):
    assert QUERIES[name](spark, data).columns == FOUND[name]


ODD = ["", " \r\n\t", "plain words only", "Broken <div class=\"note\"\r\nwords &lt;i&gt;stay&lt;/i&gt;. <!-- lost", "<ref name=q>a</ref>''b'' [[c|d]] {{e {{f}} g}} $h_1$ `i **j**`\r\n\r\n```py\nk [[l]]\n```\n\n\\textbf{m}~\\cite{n} $$o$$"]


def test_letters_of_every_article(spark, tmp_path):
    """p3_letters has a row of every article, those with markup too, of which p3_blocks has none."""
    rows = [(i, text, None) for i, text in enumerate(ODD)] + [(97, None, None), (98, "x", "y"), (None, "z", None), (2, ODD[2], None)]
    spark.createDataFrame(rows, "page_id bigint, text string, redirect string").write.parquet(str(tmp_path / "page.parquet"))
    ours = {r.page_id: (r.chars, r.digest) for r in QUERIES["p3_letters"](spark, str(tmp_path)).collect()}
    texts = ["", "", "plainwordsonly", "Brokenwordsstay", "bdh1ijklmo"]
    assert ours == {i: (len(text), hashlib.md5(text.encode()).hexdigest()) for i, text in enumerate(texts)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW page AS SELECT * FROM read_parquet('{tmp_path}/page.parquet/*.parquet')")
    assert ours == {key: (chars, digest) for key, chars, digest in con.execute(SQL["p3_letters"]).fetchall()}
    assert {r.page_id for r in QUERIES["p3_blocks"](spark, str(tmp_path)).collect()} < set(ours)


def test_blocks_among_those_of_every_article(spark, tmp_path, monkeypatch):
    """p3_blocks takes the markup off every article, not only off those of which it has rows."""
    rows = [(i, text, None) for i, text in enumerate(ODD)] + [(98, "x", "y")]
    spark.createDataFrame(rows, "page_id bigint, text string, redirect string").write.parquet(str(tmp_path / "page.parquet"))
    strip, keys = queries.strip_markup, []
    monkeypatch.setattr(queries, "strip_markup", lambda texts, **options: keys.extend(r.key for r in texts.select("key").collect()) or strip(texts, **options))
    found = sorted(tuple(r) for r in QUERIES["p3_blocks"](spark, str(tmp_path)).collect())
    assert sorted(keys) == list(range(len(ODD))) and found == [(0, 0, 0), (2, 14, 0)]
