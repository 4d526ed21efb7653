"""Queries of the page toolchain's own operators over the test tables, with the SQL they are checked against.

Operators that SQL cannot express have none; tests hold them against brute force.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import pages as P
from leafmill.functions import rules as R
from leafmill.functions import text as X
from leafmill.operators import align as A
from leafmill.operators import books as B
from leafmill.operators import geometry as G
from leafmill.operators import layout as LY
from leafmill.operators import tables as TB
from leafmill.operators import usage as U
from leafmill.runtime import materialize, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_EVENTS = """WITH e AS (SELECT *, lower(regexp_replace(status, '^\\s+|\\s+$', '', 'g')) AS st,
  coalesce(CAST(pno_0based AS VARCHAR), CAST(page_number - 1 AS VARCHAR), 'row ' || delivery_id) AS page_key FROM usage_log)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _latest(group: str) -> str:
    return f"{_EVENTS}, l AS (SELECT *, row_number() OVER (PARTITION BY {group}, page_key ORDER BY received_at DESC, delivery_id DESC) AS n FROM e)"


def _rank(p: int, values: str) -> str:
    """Nearest rank over a sorted list."""
    return f"coalesce(CAST(list_sort({values})[CAST(ceil({p} * len({values}) / 100.0) AS BIGINT)] AS BIGINT), 0)"


# ---- usage log


@query(_latest("run_id") + " SELECT run_id, page_key, delivery_id, st AS status, total_tokens FROM l WHERE n = 1")
def a1_latest_page(s: SparkSession, d: str) -> DataFrame:
    return U.latest_per_page(U.events(table(s, d, "usage_log")), ["run_id"], ["received_at", "delivery_id"], ["delivery_id", "status", "total_tokens"])


_DUR = "list(coalesce(duration_ms, 0)) FILTER (WHERE st = 'success')"


@query(
    _latest("book_id")
    + f""", r AS (SELECT book_id, count(*) AS records FROM e GROUP BY 1),
p AS (SELECT book_id, count(*) AS pages, count(*) FILTER (WHERE st = 'success') AS successful_pages, count(*) FILTER (WHERE st = 'failed') AS failed_pages,
  count(*) FILTER (WHERE st = 'skipped') AS skipped_pages, CAST(coalesce(sum(prompt_tokens) FILTER (WHERE st = 'success'), 0) AS BIGINT) AS prompt_tokens,
  CAST(coalesce(sum(completion_tokens) FILTER (WHERE st = 'success'), 0) AS BIGINT) AS completion_tokens,
  CAST(coalesce(sum(total_tokens) FILTER (WHERE st = 'success'), 0) AS BIGINT) AS total_tokens, {_DUR} AS ms FROM l WHERE n = 1 GROUP BY 1)
SELECT p.* EXCLUDE (ms), records, {_rank(50, "ms")} AS elapsed_p50_ms, {_rank(95, "ms")} AS elapsed_p95_ms FROM p JOIN r USING (book_id)"""
)
def a2_usage_summary(s: SparkSession, d: str) -> DataFrame:
    return U.usage_summary(table(s, d, "usage_log"), ["book_id"])


@query(
    _latest("run_id")
    + f""", r AS (SELECT run_id, count(*) AS records, CAST(sum(coalesce(rate_429, 0)) + count(*) FILTER (WHERE st = 'failed' AND http_status = 429) AS BIGINT) AS n429 FROM e GROUP BY 1),
p AS (SELECT run_id, count(*) FILTER (WHERE st = 'success') AS pages_ok, CAST(coalesce(sum(total_tokens) FILTER (WHERE st = 'success'), 0) AS BIGINT) AS tokens,
  count(*) FILTER (WHERE st = 'skipped' AND NOT coalesce(transient, false)) AS skipped, count(*) FILTER (WHERE st = 'failed') AS failed,
  list(duration_ms) FILTER (WHERE st = 'success' AND duration_ms <> 0) AS ms FROM l WHERE n = 1 GROUP BY 1)
SELECT p.* EXCLUDE (ms), records, n429, {_rank(50, "ms")} AS p50_ms, {_rank(95, "ms")} AS p95_ms FROM p JOIN r USING (run_id)"""
)
def a4_progress(s: SparkSession, d: str) -> DataFrame:
    return U.progress(table(s, d, "usage_log"), ["run_id"])


@query(_latest("run_id") + " SELECT run_id, page_key, delivery_id, coalesce(http_status, 0) AS http_status FROM l WHERE n = 1 AND st = 'failed'")
def k4_failed_pages(s: SparkSession, d: str) -> DataFrame:
    last = U.latest_per_page(U.events(table(s, d, "usage_log")), ["run_id"], ["received_at", "delivery_id"], ["delivery_id", "status", "http_status"])
    return last.where("status = 'failed'").select("run_id", "page_key", "delivery_id", F.coalesce("http_status", F.lit(0)).alias("http_status"))


@query(_EVENTS + ", r AS (SELECT run_id, delivery_id, duration_ms, row_number() OVER (PARTITION BY run_id ORDER BY duration_ms DESC, delivery_id) AS rank FROM e WHERE duration_ms IS NOT NULL) SELECT run_id, delivery_id, duration_ms, rank FROM r WHERE rank <= 5")
def k5_slowest_per_run(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "usage_log").where("duration_ms is not null").select("run_id", "delivery_id", "duration_ms")
    return U.top_per_group(rows, ["run_id"], [F.desc("duration_ms"), F.asc("delivery_id")], 5)


@query("WITH r AS (SELECT book_id, run_id, received_at, row_number() OVER (PARTITION BY book_id ORDER BY received_at DESC, delivery_id DESC) AS n FROM usage_log WHERE book_id IS NOT NULL) SELECT book_id, run_id FROM r WHERE n = 1")
def k7_last_run_of_book(s: SparkSession, d: str) -> DataFrame:
    log = table(s, d, "usage_log").where("book_id is not null")
    return log.groupBy("book_id").agg(F.max_by("run_id", F.struct("received_at", "delivery_id")).alias("run_id"))


@query(_EVENTS + " SELECT st AS status, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE http_status IS NULL OR http_status = 429 OR http_status BETWEEN 500 AND 599) AS BIGINT) AS retryable FROM e WHERE st = 'failed' GROUP BY 1")
def g22_retryable(s: SparkSession, d: str) -> DataFrame:
    e = U.events(table(s, d, "usage_log")).where("status = 'failed'")
    return e.groupBy("status").agg(F.count("*").alias("rows"), F.count_if(U.retryable(e)).alias("retryable"))


@query("SELECT endpoint, model, CAST(count(*) AS BIGINT) AS rows FROM (SELECT coalesce(endpoint_normalized, endpoint) AS endpoint, coalesce(model_resolved, model) AS model FROM usage_log) GROUP BY 1, 2")
def t31_key_fallback(s: SparkSession, d: str) -> DataFrame:
    log = table(s, d, "usage_log")
    return log.groupBy(F.coalesce("endpoint_normalized", "endpoint").alias("endpoint"), F.coalesce("model_resolved", "model").alias("model")).agg(F.count("*").alias("rows"))


@query("SELECT delivery_id, CASE WHEN coalesce(prompt_tokens, 0) <> 0 THEN prompt_tokens ELSE coalesce(total_tokens, 0) END AS tokens FROM usage_log")
def t30_first_count(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "usage_log").select("delivery_id", X.first_count(F.col("prompt_tokens"), F.col("total_tokens")).alias("tokens"))


@query(
    _EVENTS.replace("WITH e", "WITH RECURSIVE e")
    + """, o AS (SELECT run_id, coalesce(http_status, 0) = 429 AS slow, st = 'success' AS ok, row_number() OVER (PARTITION BY run_id ORDER BY received_at, delivery_id) AS k FROM e),
f AS (SELECT run_id, CAST(0 AS BIGINT) AS k, 4 AS now, 0 AS good FROM o GROUP BY 1 UNION ALL SELECT o.run_id, o.k,
  CAST(CASE WHEN o.slow THEN greatest(1, f.now // 2) WHEN coalesce(o.ok, false) AND f.good + 1 >= 20 THEN least(4, f.now + 1) ELSE f.now END AS INTEGER), CAST(CASE WHEN o.slow OR NOT coalesce(o.ok, false) OR f.good + 1 >= 20 THEN 0 ELSE f.good + 1 END AS INTEGER) FROM f JOIN o ON o.run_id = f.run_id AND o.k = f.k + 1)
SELECT run_id, string_agg(CAST(now AS VARCHAR), ',' ORDER BY k) AS limits FROM f WHERE k > 0 GROUP BY 1"""
)
def n13_adaptive_limits(s: SparkSession, d: str) -> DataFrame:
    e = U.events(table(s, d, "usage_log")).select("run_id", "received_at", "delivery_id", "http_status", "status")
    limits = U.adaptive_limits(e, "run_id", ["received_at", "delivery_id"], 4)
    return limits.select("run_id", F.array_join(F.col("limits").cast("array<string>"), ",").alias("limits"))


# ---- books and pages


@query("""SELECT b.book_id, p.pno FROM book_record b, LATERAL (SELECT CAST(unnest(range(b.page_count)) AS INTEGER) AS pno) p
WHERE b.page_count > 0 AND NOT EXISTS (SELECT 1 FROM page_markdown m WHERE m.book_id = b.book_id AND m.pno = p.pno)""")
def j11_missing_pages(s: SparkSession, d: str) -> DataFrame:
    return U.missing_pages(table(s, d, "book_record"), table(s, d, "page_markdown"))


@query("SELECT book_id, CAST(count(DISTINCT pno) AS BIGINT) AS n, CAST(min(pno) AS INTEGER) AS first_page, CAST(max(pno) AS INTEGER) AS last_page FROM page_markdown WHERE pno IS NOT NULL GROUP BY 1")
def x1_pages_done(s: SparkSession, d: str) -> DataFrame:
    return B.pages_done(table(s, d, "page_markdown")).select("book_id", "n", F.element_at("pages_done", 1).alias("first_page"), F.element_at("pages_done", -1).alias("last_page"))


_MATCH = """WITH p AS (SELECT book_id AS probe, lower(source_name) AS n, source_size, page_count FROM book_record), r AS (SELECT book_id, lower(source_name) AS n, source_size, page_count FROM book_record),
c AS (SELECT p.probe, r.book_id, CASE WHEN p.n = r.n THEN 3 ELSE 2 END AS q FROM p JOIN r ON p.n = r.n OR (p.source_size = r.source_size AND p.page_count = r.page_count)),
t AS (SELECT probe, max(q) AS quality FROM c GROUP BY 1), k AS (SELECT c.probe, t.quality, count(*) AS candidates, min(book_id) AS book_id FROM c JOIN t ON c.probe = t.probe AND c.q = t.quality GROUP BY 1, 2)
SELECT p.probe, CASE WHEN candidates IS NULL THEN 'not_found' WHEN candidates > 1 THEN 'ambiguous' ELSE 'bound' END AS status, CAST(coalesce(quality, 0) AS INTEGER) AS quality,
  CASE WHEN candidates = 1 THEN k.book_id END AS book_id, CAST(coalesce(candidates, 0) AS BIGINT) AS candidates FROM p LEFT JOIN k USING (probe)"""


@query("""SELECT a.book_id, f.field, CASE f.field WHEN 'source_size' THEN CASE WHEN a.source_size IS NULL OR b.source_size IS NULL THEN 'unknown' WHEN a.source_size = b.source_size THEN 'same' ELSE 'diff' END
  ELSE CASE WHEN a.page_count IS NULL OR b.page_count IS NULL THEN 'unknown' WHEN a.page_count = b.page_count THEN 'same' ELSE 'diff' END END AS state
FROM book_record a JOIN (SELECT r.book_id, r.source_size, CAST(m.n AS INTEGER) AS page_count FROM book_record r JOIN (SELECT book_id, max(pno) + 1 AS n FROM page_markdown GROUP BY 1) m USING (book_id)) b USING (book_id), (VALUES ('source_size'), ('page_count')) f(field)""")
def j13_compare_records(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "book_record")
    n = table(s, d, "page_markdown").groupBy("book_id").agg((F.max("pno") + 1).alias("page_count"))
    return B.compared(r, r.select("book_id", "source_size").join(n, "book_id"), "book_id", ["source_size", "page_count"])


@query("""SELECT coalesce(a.book_id, b.book_id) AS book_id, a.title, epoch_us(coalesce(b.updated_at, a.updated_at)) AS updated_us, epoch_us(coalesce(a.created_at, b.created_at)) AS created_us
FROM book_record a FULL JOIN (SELECT book_id, max(produced_at) AS updated_at, max(produced_at) AS created_at FROM page_markdown WHERE book_id IS NOT NULL GROUP BY 1) b USING (book_id)""")
def x5_update_records(s: SparkSession, d: str) -> DataFrame:
    new = table(s, d, "page_markdown").where("book_id is not null").groupBy("book_id").agg(F.max("produced_at").alias("updated_at"), F.max("produced_at").alias("created_at"))
    out = B.updated_records(table(s, d, "book_record").select("book_id", "title", "updated_at", "created_at"), new)
    return out.select("book_id", "title", F.unix_micros("updated_at").alias("updated_us"), F.unix_micros("created_at").alias("created_us"))


@query()
def a15_merged_books(s: SparkSession, d: str) -> DataFrame:
    return B.merged_books(B.latest_pages(table(s, d, "page_markdown"), "page_id", "markdown"), table(s, d, "book_record"), "markdown")


@query()
def t7_clean_pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "page_markdown").select("page_id", P.clean_page_text("markdown").alias("clean"))


@query()
def t12_plain_markdown(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "page_markdown").select("page_id", P.plain_markdown_text("markdown").alias("plain"))


# ---- text


@query(f"SELECT doc_id, length(regexp_replace(text, '{_BLANK}', '', 'g')) AS visible, len(regexp_extract_all(text, '[\\x{{3400}}-\\x{{9fff}}]')) AS han FROM documents")
def t15_visible_length(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", X.visible_length(F.col("text")).alias("visible"), F.regexp_count("text", F.lit(X.HAN)).cast("long").alias("han"))


@query(f"SELECT page_id, regexp_replace(nfc_normalize(markdown), '{_BLANK}', '', 'g') AS canonical FROM page_markdown")
def t14_canonical(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "page_markdown").select("page_id", X.canonical(F.col("markdown")).alias("canonical"))


@query("""SELECT page_id, len(regexp_extract_all(markdown, '\\x{fffd}')) AS replacement_count, len(regexp_extract_all(markdown, '\\?')) AS question_mark_count,
  len(regexp_extract_all(array_to_string(regexp_extract_all(markdown, '【[^】]*】|\\[[^\\]]*\\]'), ''), '[\\x{3400}-\\x{9fff}]')) AS han_in_transcription,
  len(regexp_extract_all(markdown, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')) AS control_count FROM page_markdown""")
def t17_corruption(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "page_markdown")
    return p.select("page_id", *(c.alias(n) for n, c in X.corruption(F.col("markdown")).items()))


_WORD_SIGN = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}"
# signs between words are doubled, so that each word can take one on either side
_TOKENS = f"list_transform(regexp_extract_all(regexp_replace(text, '([^{_WORD_SIGN}?])', '\\1\\1', 'g'), '(?:^|[^{_WORD_SIGN}])([A-Z]{{2,}}[a-z]|[A-Za-z]*\\p{{Nd}}+[A-Za-z]+|[A-Za-z]+\\?[A-Za-z]*)(?:[^{_WORD_SIGN}]|$)', 1), lambda x: length(x))"


@query(
    f"""SELECT line_key, CASE WHEN n = 0 THEN 0.0 ELSE least(1.0, (bad + tokens)::DOUBLE / n) END AS garble FROM (SELECT line_key, length(regexp_replace(text, '{_BLANK}', '', 'g')) AS n, len(regexp_extract_all(text, '[?\\x{{fffd}}]')) + len(regexp_extract_all(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]'))
  + len(regexp_extract_all(text, '\\p{{Co}}')) AS bad, coalesce(list_sum({_TOKENS}), 0) AS tokens FROM geom_line)"""
)
def t16_garble(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "geom_line").select("line_key", X.garble_ratio(F.col("text")).alias("garble"))


_ANCHOR = f"regexp_replace(regexp_replace(nfc_normalize(line), '{_BLANK}+', ' ', 'g'), '^ +| +$', '', 'g')"


@query(f"""WITH l AS (SELECT DISTINCT book_id, page_id, {_ANCHOR} AS anchor FROM (SELECT book_id, page_id, unnest(string_split(markdown, chr(10))) AS line FROM page_markdown))
SELECT book_id, anchor, CAST(count(*) AS BIGINT) AS pages FROM l WHERE length(anchor) BETWEEN 1 AND 80 GROUP BY 1, 2 HAVING count(*) >= 2""")
def a5_repeated_lines(s: SparkSession, d: str) -> DataFrame:
    # composed per page, as a line break joins no characters
    lines = table(s, d, "page_markdown").select("book_id", "page_id", F.explode(F.split(X.nfc(F.col("markdown")), "\n")).alias("line"))
    return G.repeated_lines(lines, "line", ["page_id"], ["book_id"], composed=True)


_KEYS = ["pharynx", "Glottis", "语料", "硬腭", "spectrum", "zzz"]


# ---- notation rules


@query("""SELECT case_id, len(regexp_extract_all(input, '\\\\(?:underset|overset)\\b|\\\\\\[|\\\\\\]')) + len(regexp_extract_all(input, '\\$')) - len(regexp_extract_all(input, '\\\\\\$')) AS latex_residue,
  len(regexp_extract_all(input, '\\[[^\\]\\r\\n]*[_^][^\\]\\r\\n]*\\]')) AS banned_bracket_mark, len(regexp_extract_all(input, '\\[(?:tɕ''?|tc''?|[tkdp])[wW]\\]')) AS dropped_attached_mark,
  len(regexp_extract_all(input, '\\[(?:[kpt][hH]|[ɕnl][jJ])\\]')) AS ascii_modifier_letter,
  len(regexp_extract_all(regexp_replace(input, '\\[[^\\[\\]\\r\\n]*\\]', '', 'g'), '[_^]')) - len(regexp_extract_all(regexp_replace(input, '\\[[^\\[\\]\\r\\n]*\\]', '', 'g'), '\\\\[_^]')) AS ascii_position_operator FROM notation_case""")
def g1_rule_counts(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "notation_case")
    return n.select("case_id", *(c.alias(k) for k, c in R.rule_counts(F.col("input")).items()))


@query()
def g9_issues(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "notation_case").select("case_id", F.explode(R.issues("input")).alias("i"))
    return rows.select("case_id", "i.*")


@query()
def a6_issue_rollup(s: SparkSession, d: str) -> DataFrame:
    """Issues by code, the ten most frequent; ties by code."""
    return g9_issues(s, d).groupBy("code").agg(F.count("*").alias("issues"), F.count_distinct("case_id").alias("texts")).orderBy(F.desc("issues"), "code").limit(10)


# ---- geometry


@query("SELECT line_key, row_number() OVER (PARTITION BY run_id, book_id, pno ORDER BY (y0 + y1) / 2.0, x0, line_key) - 1 AS reading_order FROM geom_line")
def w1_reading_order(s: SparkSession, d: str) -> DataFrame:
    return G.reading_order(table(s, d, "geom_line"), "line_key").select("line_key", "reading_order")


@query("SELECT line_key, row_number() OVER (PARTITION BY run_id, book_id, pno ORDER BY round_even((y0 + y1) / 2.0 / 12.0, 0), round_even(x0, 0), (y0 + y1) / 2.0, (x0 + x1) / 2.0, line_key) - 1 AS visual_order FROM geom_line")
def w2_visual_order(s: SparkSession, d: str) -> DataFrame:
    return G.visual_order(table(s, d, "geom_line"), "line_key").select("line_key", "visual_order")


@query("""WITH c AS (SELECT line_key, (x0 + x1) / 2.0 AS x, min((x0 + x1) / 2.0) OVER p AS lo, max((x0 + x1) / 2.0) OVER p AS hi FROM geom_line WINDOW p AS (PARTITION BY run_id, book_id, pno))
SELECT line_key, CAST(CASE WHEN hi - lo >= 120 AND x > (lo + hi) / 2.0 THEN 1 ELSE 0 END AS BIGINT) AS split_column FROM c""")
def w5_columns(s: SparkSession, d: str) -> DataFrame:
    return G.split_columns(table(s, d, "geom_line")).select("line_key", "split_column")


@query("SELECT block_id, CAST(CASE WHEN least(x0, y0, x1, y1) >= 0 AND greatest(x0, y0, x1, y1) <= 1000 AND x1 > x0 AND y1 > y0 AND length(trim(text)) > 0 THEN 1 ELSE 0 END AS INTEGER) AS valid FROM layout_block")
def g12_valid_boxes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "layout_block").select("block_id", G.valid_box("text").cast("int").alias("valid"))


@query("SELECT line_key, mode, CAST(CASE WHEN regexp_full_match(text, '[\\x20-\\x7e]{6,60}') AND x1 - x0 < 40 AND y1 - y0 > 2 * (x1 - x0) THEN 1 ELSE 0 END AS INTEGER) AS rotated FROM geom_line")
def g16_rotated_labels(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "geom_line").select("line_key", "mode", G.rotated_label().cast("int").alias("rotated"))


@query("""SELECT line_key, b.y0 AS fy0, b.y1 AS fy1 FROM (SELECT line_key, i, n, CASE WHEN n <= 1 THEN {'y0': 480.0::DOUBLE, 'y1': 520.0::DOUBLE} ELSE {'y0': 50.0::DOUBLE + i * (900.0::DOUBLE / n), 'y1': least(1000.0::DOUBLE, 50.0::DOUBLE + i * (900.0::DOUBLE / n) + greatest(20.0::DOUBLE, 900.0::DOUBLE / n * 0.8::DOUBLE))} END AS b
FROM (SELECT line_key, row_number() OVER (PARTITION BY run_id, book_id, pno ORDER BY line_order, line_key) - 1 AS i, count(*) OVER (PARTITION BY run_id, book_id, pno) AS n FROM geom_line))""")
def n3_fallback_boxes(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(*G.PAGE)
    g = table(s, d, "geom_line").select("line_key", (F.row_number().over(w.orderBy("line_order", "line_key")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    return g.select("line_key", G.fallback_box(F.col("i"), F.col("n")).alias("b")).select("line_key", F.col("b.y0").alias("fy0"), F.col("b.y1").alias("fy1"))


@query(f"""SELECT run_id, book_id, pno, CAST(coalesce(sum(n) FILTER (WHERE mode = 'aligned'), 0) AS BIGINT) AS aligned_chars, CAST(coalesce(sum(n), 0) AS BIGINT) AS covered_chars,
  count(*) FILTER (WHERE mode = 'aligned') AS aligned, count(*) FILTER (WHERE mode = 'fallback_capacity') AS fallback_capacity, count(*) FILTER (WHERE mode = 'header_footer_excluded') AS header_footer_excluded
FROM (SELECT *, length(regexp_replace(text, '{_BLANK}', '', 'g')) AS n FROM geom_line) GROUP BY 1, 2, 3""")
def a7_coverage(s: SparkSession, d: str) -> DataFrame:
    return G.coverage(table(s, d, "geom_line")).drop("aligned_coverage")


@query("SELECT run_id, book_id, pno, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, list_sort(list(round(y1 - y0, 3)))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS height FROM geom_line GROUP BY 1, 2, 3")
def a17_page_extent(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "geom_line").groupBy(*G.PAGE).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.collect_list(F.round(F.col("y1") - F.col("y0"), 3)).alias("h"))
    return g.select(*G.PAGE, "x0", "y0", "x1", "y1", G.upper_median(F.col("h")).alias("height"))


_BLOCKS = "SELECT block_id, run_id, book_id, page_idx + CASE part_file WHEN 'part2' THEN 200 ELSE 0 END AS pno, least(y0, y1) AS b0, greatest(y0, y1) AS b1 FROM layout_block WHERE y1 > y0"


def _blocks(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "layout_block").where("y1 > y0")
    return b.select("block_id", "run_id", "book_id", (F.col("page_idx") + F.when(F.col("part_file") == "part2", 200).otherwise(0)).alias("pno"), F.col("y0").alias("b0"), F.col("y1").alias("b1"))


@query(f"SELECT b.block_id, g.line_key FROM ({_BLOCKS}) b JOIN geom_line g ON b.run_id = g.run_id AND b.book_id = g.book_id AND b.pno = g.pno AND (g.y0 + g.y1) / 2.0 BETWEEN b.b0 - 15.0 AND b.b1 + 15.0")
def j8_rows_of_blocks(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "geom_line").select("line_key", *G.PAGE, G.center("y0", "y1").alias("y"))
    return G.binned_join(g, _blocks(s, d), G.PAGE, F.col("y"), F.col("b0") - 15.0, F.col("b1") + 15.0).select("block_id", "line_key")


@query()
def j3_align_pages(s: SparkSession, d: str) -> DataFrame:
    pages = table(s, d, "page_markdown").where("markdown is not null")
    a = A.align_pages(pages, "page_id", "markdown", table(s, d, "geom_line"), "line_key")
    return A.alignment_metrics(a, "page_id")


# ---- tables and layout


@query()
def h2_table_grids(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "layout_block").where("block_type = 'table'").select("block_id", TB.table_grid("table_body").alias("g"))
    return b.select("block_id", F.size("g").alias("rows"), F.coalesce(F.size(F.try_element_at("g", F.lit(1))), F.lit(0)).alias("columns"), TB.grid_text(F.col("g")).alias("text"))


@query("SELECT block_id, CAST(CASE WHEN regexp_matches(table_body, '(?i)rowspan|colspan|<th') THEN 1 ELSE 0 END AS INTEGER) AS spans FROM layout_block")
def g18_span_markup(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "layout_block").select("block_id", TB.has_spans(F.col("table_body")).cast("int").alias("spans"))


@query()
def t25_block_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "layout_block").select("block_id", TB.block_text("block_type", "text", "table_caption", "image_caption", F.col("table_body")).alias("text"))


@query()
def a16_page_markdown(s: SparkSession, d: str) -> DataFrame:
    """The text of each page from its layout blocks, by height, then left edge."""
    b = table(s, d, "layout_block").select("run_id", "book_id", "part_file", "page_idx", "block_id", "x0", G.center("y0", "y1").alias("y"), TB.block_text("block_type", "text", "table_caption", "image_caption", F.col("table_body")).alias("t")).where("t != ''")
    b = b.withColumn("pno", F.col("page_idx") + F.when(F.col("part_file") == "part2", 200).otherwise(0))
    rows = b.groupBy(*G.PAGE).agg(F.array_sort(F.collect_list(F.struct("y", "x0", "block_id", "t"))).alias("b"))
    return rows.select(*G.PAGE, F.array_join(F.transform("b", lambda x: x["t"]), "\n\n").alias("text"))


@query()
def n6_page_plans(s: SparkSession, d: str) -> DataFrame:
    p = LY.plan_pages(table(s, d, "geom_line"), "line_key")
    return p.select(*G.PAGE, "overflows", F.size("lines").alias("physical_lines"), F.bround(F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["size"]) / F.size("lines"), 6).alias("mean_size"))


@query()
def w10_table_columns(s: SparkSession, d: str) -> DataFrame:
    c = LY.table_columns(table(s, d, "geom_line"), G.PAGE, "line_key")
    return c.select(*G.PAGE, F.size("columns").alias("n_columns"), F.array_join(F.transform("columns", lambda x: F.format_string("%.4f %.4f", x[0], x[1])), ";").alias("columns"))
