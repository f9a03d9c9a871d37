"""Queries of the text problems, with their SQL where DuckDB can say them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.distinctive import most_distinctive, term_scores
from inkwell.llm.leaks import find_leaks
from inkwell.llm.markup import strip_markup
from inkwell.llm.mixture import count_tokens, mix, report, source_name
from inkwell.llm.pieces import split_texts
from inkwell.llm.quality import text_quality
from inkwell.llm.sentences import split_sentences
from inkwell.llm.term_counts import count_terms, mark_terms
from inkwell.llm.words import listed_words
from inkwell.session import cut_lineage
from inkwell.sources.tables import articles, table


def _articles(spark: SparkSession, folder: str) -> DataFrame:
    return articles(table(spark, folder, "page"))


def p2_marked(spark: SparkSession, folder: str) -> DataFrame:
    known = _articles(spark, folder)
    return mark_terms(listed_words(table(spark, folder, "idf")), count_terms(known), known.agg(F.count("*").alias("n")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_marked(spark, folder).where(F.col("mark").isNotNull()).select("word", "mark")


def p3_clean(spark: SparkSession, folder: str) -> DataFrame:
    stripped = strip_markup(_articles(spark, folder).withColumnRenamed("page_id", "key"))
    return stripped.select(F.col("key").alias("page_id"), "kinds", "clean", "blocks")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    stripped = strip_markup(_articles(spark, folder).withColumnRenamed("page_id", "key"))
    return stripped.select(F.col("key").alias("page_id"), F.explode("kinds").alias("kind"))


def p4_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return text_quality(_articles(spark, folder).withColumnRenamed("page_id", "key")).withColumnRenamed("key", "page_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_statistics(spark, folder).where(~F.col("prose")).select("page_id")


def _scores(spark: SparkSession, folder: str, **options: bool) -> DataFrame:
    known = _articles(spark, folder).withColumnRenamed("page_id", "key")
    return term_scores(known, listed_words(table(spark, folder, "idf")), **options)


def p6_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder).select(F.col("key").alias("page_id"), "word", "tf", "df", "length", F.round("score", 6).alias("score"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    best = most_distinctive(_scores(spark, folder, smooth=False, normalise=False))
    return best.where("tf >= 4 AND df <= 3").select(F.col("key").alias("page_id"), "word")


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    pieces = split_texts(_articles(spark, folder).withColumnRenamed("page_id", "key"))
    return pieces.select(F.col("key").alias("page_id"), "piece_no", "piece_start", "piece_end", "strength", "piece")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = split_texts(_articles(spark, folder).withColumnRenamed("page_id", "key"), with_text=False)
    return pieces.where("piece_no = 1").select(F.col("key").alias("page_id"), F.explode("oversized").alias("para_no"))


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_leaks(spark, folder).select("doc_id", "item_id").distinct()


def _counted(spark: SparkSession, folder: str) -> DataFrame:
    return cut_lineage(count_tokens(table(spark, folder, "documents")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sources that the mixture of as many tokens as all documents together can't give their shares."""
    counted, targets = _counted(spark, folder), table(spark, folder, "mix_target")
    return report(mix(counted, targets), counted, targets).where("short").select("source")


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mix(_counted(spark, folder), table(spark, folder, "mix_target"), exact=True)


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    counted, targets = _counted(spark, folder), table(spark, folder, "mix_target")
    return report(mix(counted, targets, exact=True), counted, targets)


def p9_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """The real shares of a mixture in which long documents are likelier to be drawn than short ones."""
    counted, targets = _counted(spark, folder), table(spark, folder, "mix_target")
    return report(mix(counted, targets, weight=F.sqrt("tokens"), exact=True), counted, targets)


def p10_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return split_sentences(table(spark, folder, "documents"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_sentences(table(spark, folder, "documents"), with_text=False).select("doc_id", "sent_end")


# Queries whose results SQL can say although it can't say the operator: what must hold for them.


def p3_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Of articles without any sign of markup: their blocks are the text, but for white space, and hold no kinds.

    The markup is taken off all articles, so that these are converted among the others; which rows come out, SQL says.
    """
    known = _articles(spark, folder).withColumnRenamed("page_id", "key").withColumn("plain", ~F.col("text").rlike(PLAIN_SIGNS))
    marked = F.size(F.filter("blocks", lambda b: F.size(b["kinds"]) > 0))
    stripped = strip_markup(known, also=("plain",)).where("plain")
    return stripped.select(F.col("key").alias("page_id"), _solid(F.array_join(F.transform("blocks", lambda b: b["text"]), "")).alias("chars"), marked.alias("marked"))


def p3_letters(spark: SparkSession, folder: str) -> DataFrame:
    """Of every article, with markup or without: how many letters and digits its blocks hold, and the digest of them in order."""
    letters = F.regexp_replace(F.array_join(F.transform("blocks", lambda b: b["text"]), ""), r"[^\p{L}\p{N}]", "")
    return p3_clean(spark, folder).select("page_id", F.length(letters).alias("chars"), F.md5(letters).alias("digest"))


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    return p4_statistics(spark, folder).select("page_id", "words", F.round("mean_word", 6).alias("mean_word"))


def p7_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Per article: characters of the pieces without what they share, whether all are within the limit, and whether the pieces hold what their places say."""
    pieces, share = p7_pieces(spark, folder), F.col("piece_end") - F.col("piece_start") - F.when(F.col("piece_no") > 1, 200).otherwise(0)
    held = F.length("piece") == F.col("piece_end") - F.col("piece_start")
    return pieces.groupBy("page_id").agg(F.sum(share).alias("chars"), (F.max(F.length("piece")) <= 2000).alias("within"), F.min(held).alias("held"))


def p8_verbatim(spark: SparkSession, folder: str) -> DataFrame:
    """The leaks found whose passage stands in the document letter by letter."""
    texts = table(spark, folder, "documents").select("doc_id", F.col("text").alias("whole"))
    items = table(spark, folder, "eval_item").select("item_id", F.col("text").alias("passage"))
    found = p8_found(spark, folder).join(texts, "doc_id").join(F.broadcast(items), "item_id")
    return found.where(F.contains("whole", "passage")).select("doc_id", "item_id")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: is it short, and does the mixture keep max_repeats?"""
    counted, targets = _counted(spark, folder), table(spark, folder, "mix_target")
    mixture = cut_lineage(mix(counted, targets, exact=True))
    most = mixture.groupBy("source").agg(F.max("copies").alias("copies"))
    rows = report(mixture, counted, targets).select("source", "short").join(F.broadcast(most), "source", "left")
    limits = targets.select(source_name("source").alias("source"), "max_repeats")
    return rows.join(F.broadcast(limits), "source").select("source", "short", (F.coalesce("copies", F.lit(0)) <= F.col("max_repeats")).alias("within"))


def p10_letters(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: letters and digits of its units, none lost and none twice, and whether each unit stands where it says."""
    units = p10_sentences(spark, folder)
    held = F.length("sentence") == F.col("sent_end") - F.col("sent_start") + 1
    return units.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("sentence", r"[^\p{L}\p{N}]", ""))).alias("letters"), F.min(held).alias("held"))


PLAIN_SIGNS = r"[^\p{L}\p{N} .,\r\n]"


def _solid(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[ \r\n]", ""))


ARTICLES = "article AS (SELECT page_id, min(text) AS text FROM page WHERE page_id IS NOT NULL AND text IS NOT NULL AND trim(coalesce(redirect, '')) = '' GROUP BY page_id)"
TOKENS = "token AS (SELECT page_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM article), tf AS (SELECT page_id, word, count(*) AS tf FROM token GROUP BY ALL)"
LISTED = "listed AS (SELECT DISTINCT regexp_replace(lower(word), '^\\s+|\\s+$', '', 'g') AS word FROM idf WHERE regexp_replace(lower(word), '^\\s+|\\s+$', '', 'g') <> '')"
MARKED = f"""{ARTICLES}, {TOKENS}, {LISTED}, known AS (SELECT word, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS records FROM tf GROUP BY word),
    total AS (SELECT count(*) AS n FROM article),
    marked AS (SELECT l.word, coalesce(occurrences, 0) AS occurrences, coalesce(records, 0) AS records,
      CASE WHEN coalesce(records, 0) <= 3 THEN 'rare' WHEN coalesce(records, 0) >= 0.5 * n THEN 'common' END AS mark
      FROM listed l LEFT JOIN known k ON l.word = k.word CROSS JOIN total)"""
SCORED = f"""{ARTICLES}, {TOKENS}, {LISTED}, total AS (SELECT count(*) AS n FROM article), kept AS (SELECT tf.* FROM tf SEMI JOIN listed USING (word)),
    known AS (SELECT word, count(*) AS df FROM kept GROUP BY word), length AS (SELECT page_id, count(*) AS length FROM token GROUP BY page_id)"""

QUERIES = {"p2_found": p2_found, "p2_marked": p2_marked, "p3_found": p3_found, "p3_clean": p3_clean,
           "p4_found": p4_found, "p4_statistics": p4_statistics, "p6_found": p6_found, "p6_scores": p6_scores,
           "p7_found": p7_found, "p7_pieces": p7_pieces, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_found": p9_found, "p9_mixture": p9_mixture, "p9_report": p9_report, "p9_weighted": p9_weighted,
           "p10_found": p10_found, "p10_sentences": p10_sentences, "p3_blocks": p3_blocks, "p3_letters": p3_letters, "p4_counts": p4_counts, "p7_lengths": p7_lengths, "p8_verbatim": p8_verbatim,
           "p9_shares": p9_shares, "p10_letters": p10_letters}
# what residue looks like in these tables, in RE2; written apart from the scanner's rules, as a check on them
RESIDUE = {
    "html": r"</?(?i:a|b|br|div|li|p|ref|span|sup|table|td|th|tr|ul)[\s>/]|<!--|&(?:lt|gt|amp|nbsp|#[0-9]+);",
    "wiki": r"(?m)\[\[|\{\{|^[ \t]*\{\||\x27\x27|__[A-Z]+__|^[ \t]*={2,6} [^=\n\r]+ ={2,6}|\[https?://[^\s\]]+\s",
    "markdown": r"(?m)\*\*\S|\S\*\*|~~|`|\]\(\S+[./]|\[\^[0-9]|^[ \t]*#{1,6} \S|^[ \t]*(?:={7,}|-{7,})|\|:?-{2,}:?\|",
    "latex": r"\\[a-z]+\{|\\[(\[]|\$\$|\$[a-z]_[0-9]",
}
_RESIDUE = " UNION ALL ".join(f"SELECT page_id, '{kind}' AS kind FROM article WHERE regexp_matches(text, '{rule}')" for kind, rule in RESIDUE.items())
# what is taken off such residue, letter by letter, in RE2; written apart from the converter, as a check on it
_TAG = r"</?(?i:a|b|br|div|i|li|p|ref|span|sup|table|td|th|tr|ul)"
_DROPPED = r"<!--.*?(?:-->|\z)|" + "|".join(rf"(?i:<{name}(?:>|\b[^<>]*[^<>/]>).*?</{name}>)" for name in ("script", "style", "ref"))
_CODE = r"```.*?(?:```|\z)|~~~.*?(?:~~~|\z)|(?i:<pre(?:>|\b[^<>]*[^<>/]>).*?</pre>)"
_FORMULA = r"\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|" + "|".join(rf"\\begin\{{{name}\}}.*?\\end\{{{name}\}}" for name in ("equation", r"equation\*", "align", r"align\*", "math", "displaymath"))
_DOLLARS, _TICKS = r"\$(?:[A-Za-z({][^$\n\\^_\x01]*[\\^_]|\\)[^$\x01]*\$", r"`[^`\n]+`"
TAKEN = (
    ("&nbsp;|&#[0-9]+;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"),
    (rf"{_TAG}(?:\s[^<>]*)?/?>", ""), (rf'{_TAG}(?:\s+[\w-]+\s*=\s*"[^"\n]*"?)+', ""), (rf"{_TAG}([^\w.:-]|$)", r"\1"),
    (r"(?i)\[\[(?:category|file|image):[^\[\]]*\]\]", ""), (r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", r"\1"), (r"\[\[([^\[\]|]*)\]\]", r"\1"),
    (r"\{\{[^{}]*\}\}", ""), (r"(?m)^[ \t]*(?:\{\||\|\}|\|-).*$", ""), ("__[A-Z]{4,}__", ""),
    (r"\[(?:https?:)?//[^\s\]]+(?:\s+([^\]\n]*))?\]", r"\1"), (r"!\[([^\]\n]*)\]\([^)\s]*\)", r"\1"), (r"\[([^\[\]\n]+)\]\([^)\s]*[/.#][^)\s]*\)", r"\1"), (r"\[\^[\w-]+\]", ""),
    (r"\\(?:cite|ref|label|footnote)\w*\{[^{}]*\}", ""), (r"\\(?:begin|end)\{[^{}\n]*\}", ""), (r"\\[A-Za-z]+\*?\{([^{}]*)\}", r"\1"), (r"(^|[^\p{L}\p{N}_:\\])\\[A-Za-z]+", r"\1"),
)


def _replaced(text: str, rule: str, to: str) -> str:
    return f"regexp_replace({text}, '{rule}', {to}, 'g')"


def _letters(text: str) -> str:
    return _replaced(text, r"[^\p{L}\p{N}]", "''")


def _split(text: str, rest: str, *cases: tuple[str, str]) -> str:
    """text in which what is found by a rule of cases (rule, SQL of what stands for x) is put between marks, safe from what is done later."""
    rule = "|".join([*(rule for rule, _ in cases), rest])
    whens = " ".join(f"WHEN regexp_full_match(x, '{rule}') THEN chr(1) || {to} || chr(1)" for rule, to in cases)
    return f"array_to_string([CASE {whens} ELSE x END FOR x IN regexp_extract_all({text}, '{rule}')], '')"


_REGIONS = _split("text", r"\$\$|[^<`~$\\]+|(?s:.)", (f"(?s:{_DROPPED})", "''"), (f"(?s:{_FORMULA})", _letters("x")),
                  (f"(?s:{_CODE})", _letters(_replaced("x", r"^(?:(?:```|~~~)[^\n]*\n|<[^>]*>)|</[a-zA-Z]+>$", "''"))))
_TEMPLATES, _PLAIN = "text", "block"
for _ in range(3):  # as deep as they are nested
    _TEMPLATES = _replaced(_TEMPLATES, r"\{\{(?:[{}]?[^{}])*\}\}", "chr(1)")
for _rule, _to in TAKEN:
    _PLAIN = _replaced(_PLAIN, _rule, f"'{_to}'")
SQL = {
    "p3_letters": f"""WITH {ARTICLES}, lines AS (SELECT page_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM article),
        regions AS (SELECT page_id, {_REGIONS} AS text FROM lines), parts AS (SELECT page_id, string_split_regex({_TEMPLATES}, '\\n[ \\t\\x{{00a0}}]*(?:\\n[ \\t\\x{{00a0}}]*)+') AS list FROM regions),
        blocks AS (SELECT page_id, unnest(list) AS block, generate_subscripts(list, 1) AS place FROM parts),
        formulas AS (SELECT page_id, place, {_split("block", r"[^$]+|\$", (_DOLLARS, _letters("x")))} AS block FROM blocks),
        codes AS (SELECT page_id, place, {_split("block", "[^`]+|`", (_TICKS, _letters("x")))} AS block FROM formulas),
        plain AS (SELECT page_id, string_agg({_letters(_PLAIN)}, '' ORDER BY place) AS letters FROM codes GROUP BY page_id)
        SELECT page_id, CAST(length(letters) AS INTEGER) AS chars, md5(letters) AS digest FROM plain""",
    "p3_blocks": f"WITH {ARTICLES} SELECT page_id, CAST(length(regexp_replace(text, '[ \\r\\n]', '', 'g')) AS INTEGER) AS chars, 0 AS marked FROM article WHERE NOT regexp_matches(text, '[^\\p{{L}}\\p{{N}} .,\\r\\n]')",
    "p4_counts": f"""WITH {ARTICLES}, w AS (SELECT page_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+') AS list FROM article)
        SELECT page_id, len(list) AS words, CASE WHEN len(list) = 0 THEN 0.0 ELSE round(length(array_to_string(list, '')) / len(list), 6) END AS mean_word FROM w""",
    "p7_lengths": f"WITH {ARTICLES} SELECT page_id, length(text) AS chars, TRUE AS within, TRUE AS held FROM article",
    "p8_verbatim": "SELECT DISTINCT doc_id, item_id FROM documents d JOIN eval_item e ON contains(d.text, e.text)",
    "p9_shares": """WITH t AS (SELECT trim(lower(source)) AS source, sum(coalesce(strlen(text), 0)) AS b FROM documents GROUP BY 1)
        SELECT trim(lower(m.source)) AS source, coalesce(b, 0) * max_repeats < target_share * (SELECT sum(b) FROM t) AS short, TRUE AS within FROM mix_target m LEFT JOIN t ON trim(lower(m.source)) = t.source""",
    "p10_letters": "SELECT doc_id, CAST(length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS BIGINT) AS letters, TRUE AS held FROM documents WHERE regexp_matches(text, '[^ \\t\\r\\n\\x{00a0}\\x{3000}]')",
    "p3_found": f"WITH {ARTICLES} {_RESIDUE}",
    # bytes stand for tokens: the answer is the same for any usual tokenizer
    "p9_found": """WITH t AS (SELECT trim(lower(source)) AS source, sum(coalesce(strlen(text), 0)) AS b FROM documents GROUP BY 1)
        SELECT trim(lower(m.source)) AS source FROM mix_target m LEFT JOIN t ON trim(lower(m.source)) = t.source
        WHERE coalesce(b, 0) * max_repeats < target_share * (SELECT sum(b) FROM t)""",
    "p2_found": f"WITH {MARKED} SELECT word, mark FROM marked WHERE mark IS NOT NULL",
    "p2_marked": f"WITH {MARKED} SELECT * FROM marked",
    "p6_found": f"""WITH {SCORED}, best AS (SELECT page_id, word, tf, df, row_number() OVER (PARTITION BY page_id ORDER BY round(tf * ln(n / df), 9) DESC, word) AS r
        FROM kept JOIN known USING (word) CROSS JOIN total) SELECT page_id, word FROM best WHERE r = 1 AND tf >= 4 AND df <= 3""",
    "p6_scores": f"WITH {SCORED} SELECT page_id, word, tf, df, length, round(tf / length * (ln((1 + n) / (1 + df)) + 1), 6) AS score FROM kept JOIN known USING (word) JOIN length USING (page_id) CROSS JOIN total",
    "p7_found": f"""WITH {ARTICLES}, lines AS (SELECT page_id, replace(text, chr(13) || chr(10), chr(1) || chr(10)) AS text FROM article),
        split AS (SELECT page_id, string_split_regex(text, '(?:\\x01\\n|\\r|\\n)(?:[ \\t\\x{{00a0}}]*(?:\\x01\\n|\\r|\\n))+') AS list FROM lines),
        parts AS (SELECT page_id, unnest(list) AS part, generate_subscripts(list, 1) AS place FROM split),
        bodies AS (SELECT page_id, place, regexp_replace(part, '^[ \\t\\x{{00a0}}\\r\\n\\x01]+|[ \\t\\x{{00a0}}\\r\\n\\x01]+$', '', 'g') AS body FROM parts),
        numbered AS (SELECT page_id, body, row_number() OVER (PARTITION BY page_id ORDER BY place) AS para_no FROM bodies WHERE body <> '')
        SELECT page_id, para_no FROM numbered WHERE length(body) > 2000""",
}
