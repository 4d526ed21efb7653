"""Queries of the training-text problems and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import cuts, leaks, lookalike, markup, mixing, noise, spans
from leafmill.operators.dedup import page_message_key
from leafmill.runtime import materialize, table


def _noisy(spark: SparkSession, d: str) -> DataFrame:
    pages, lines = table(spark, d, "page_markdown"), table(spark, d, "geom_line")
    parts = [
        noise.lines_of_pages(pages, "page_markdown", "page_id", "markdown"),
        noise.lines_of_table(lines, "geom_line", "line_key", "text", ["run_id", "book_id", "pno"], ["line_order"]),
    ]
    return noise.noisy_lines(parts, table(spark, d, "book_record").select("book_id", "title"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _noisy(spark, d).select("table_name", "rec_id", "line_no", "defect").distinct()


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Page texts (rec_id: page_id) and the embedded lines of each run, book and page (rec_id: their smallest line_key)."""
    pages, lines, page = table(spark, d, "page_markdown"), table(spark, d, "geom_line"), ["run_id", "book_id", "pno"]
    found = materialize(_noisy(spark, d), "noisy")
    texts = noise.repaired_pages(pages, "page_markdown", "page_id", "markdown", found, page)
    embedded = noise.repaired_lines(lines, "geom_line", "line_key", "text", page, ["line_order"], found)
    out = ((texts, "page_markdown", "page_id"), (embedded, "geom_line", "line_key"))
    a, b = (df.select(F.lit(t).alias("table_name"), F.col(i).alias("rec_id"), *page, "clean", "n_defects") for df, t, i in out)
    return a.union(b)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [("notation_case", "case_id", "input"), ("page_markdown", "page_id", "markdown")]
    a, b = (lookalike.same_look_pairs(table(spark, d, t), i, c).select(F.lit(t).alias("table_name"), "id_a", "id_b") for t, i, c in parts)
    return a.union(b)


def p3_classes(spark: SparkSession, d: str, form=lookalike.visible_form) -> DataFrame:
    parts = [("notation_case", "case_id", "input"), ("page_markdown", "page_id", "markdown")]
    a, b = (lookalike.variant_classes(table(spark, d, t), i, c, form).select(F.lit(t).alias("table_name"), F.col(i).alias("rec_id"), "class_id", "spellings") for t, i, c in parts)
    return a.union(b)


def p3_search_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes under the compatibility form with full case folding: case, raised and lowered signs and letter forms do not count."""
    return p3_classes(spark, d, lookalike.search_form)


_MARKED_UP = [("page_markdown", "page_id", "markdown"), ("layout_block", "block_id", "table_body")]


def _elements(spark: SparkSession, d: str) -> DataFrame:
    a, b = (markup.element_rows(table(spark, d, t), i, "book_id", c, t) for t, i, c in _MARKED_UP)
    return materialize(a.union(b), "elements")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.kinds(_elements(spark, d)).select("table_name", "rec_id", "kind")


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    a, b = (markup.clean_texts(table(spark, d, t), i, "book_id", c).select(F.lit(t).alias("table_name"), F.col(i).alias("rec_id"), "kinds", "n_template", "clean") for t, i, c in _MARKED_UP)
    return a.union(b)


def p4_templates(spark: SparkSession, d: str) -> DataFrame:
    return markup.template_subtrees(_elements(spark, d))


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    pages, log = table(spark, d, "page_markdown"), table(spark, d, "usage_log")
    messages = log.select("completion_tokens", *(c.alias(n) for n, c in page_message_key().items()))
    return cuts.cut_texts(pages, "page_id", "markdown", "pno", cuts.page_tokens(pages, messages, "page_id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _cuts(spark, d).where("cut").select("page_id")


def p6_share(spark: SparkSession, d: str) -> DataFrame:
    return cuts.cut_share(table(spark, d, "page_markdown"), "page_id", "source", _cuts(spark, d))


def p6_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How many cut pages each kind of evidence names first."""
    return _cuts(spark, d).where("cut").groupBy("evidence").agg(F.count("*").alias("pages"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "eval_item"), "item_id", "text", table(spark, d, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where(F.col("run") >= leaks.RUN).select("item_id", "doc_id")


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """Each leaked item: documents with a window like one of it, and with a whole run of it."""
    found = _leaks(spark, d)
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.count_if(F.col("run") >= leaks.RUN).alias("with_run"), F.max("run").alias("longest_run"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "mix_target"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, d), table(spark, d, "mix_target"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_pairs(table(spark, d, "documents"), "doc_id", "text")


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each shared stretch, as membership: linear where the pairs are not."""
    return spans.sharing_classes(table(spark, d, "documents"), "doc_id", "text")


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_parts(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {"p1_found": p1_found, "p1_clean": p1_clean, "p3_found": p3_found, "p3_classes": p3_classes, "p3_search_classes": p3_search_classes, "p4_found": p4_found, "p4_clean": p4_clean, "p4_templates": p4_templates, "p6_found": p6_found, "p6_share": p6_share, "p6_evidence": p6_evidence, "p7_found": p7_found, "p7_near": p7_near, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_classes": p9_classes, "p9_shared": p9_shared}

ORACLE = {
    "p9_found": """
WITH w AS (SELECT DISTINCT doc_id, substr(text, i, 200) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
m AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1), k AS (SELECT w.* FROM w JOIN m USING (s))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b ON a.s = b.s AND a.doc_id < b.doc_id""",
    "p9_shared": """
WITH w AS (SELECT DISTINCT doc_id, b, substr(text, b + 1, 200) AS s FROM (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS b FROM documents WHERE length(text) >= 200)),
m AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1), k AS (SELECT DISTINCT doc_id, b FROM w JOIN m USING (s)),
c AS (SELECT doc_id, CAST(sum(coalesce(least(200, lead_b - b), 200)) AS BIGINT) AS shared_chars FROM (SELECT doc_id, b, lead(b) OVER (PARTITION BY doc_id ORDER BY b) AS lead_b FROM k) GROUP BY 1),
n AS (SELECT doc_id, CAST(max(length(text)) AS BIGINT) AS n_chars FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT doc_id, coalesce(shared_chars, 0) AS shared_chars, n_chars, CASE WHEN n_chars > 0 THEN coalesce(shared_chars, 0) / n_chars ELSE 0.0 END AS share FROM n LEFT JOIN c USING (doc_id)""",
}
