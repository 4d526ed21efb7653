"""More queries of the toolchain's operators, by their letter and number, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import payload as PL
from leafmill.functions import rules as R
from leafmill.functions import text as X
from leafmill.operators import align as A
from leafmill.operators import books as B
from leafmill.operators import geometry as G
from leafmill.operators import ink as I
from leafmill.operators import layout as LY
from leafmill.operators import refine as RF
from leafmill.operators import tables as TB
from leafmill.operators import usage as U
from leafmill.operators import verify as V
from leafmill.plans.toolchain import _ANCHOR, _BLANK, _BLOCKS, _EVENTS, _blocks, _latest
from leafmill.runtime import materialize, table
from leafmill.sources import files as S
from leafmill.streaming import usage as ST

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _joined(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# ---- sources

_LINES = "SELECT stream_id, file_seq, line_no, json_valid(record) AND json_type(CASE WHEN json_valid(record) THEN record ELSE 'null' END) = 'OBJECT' AS ok, CASE WHEN json_valid(record) THEN CAST(record AS JSON) END AS j FROM usage_raw"


@query(f"""SELECT stream_id, file_seq, line_no, j ->> '$.status' AS status, TRY_CAST(j ->> '$.attempt' AS INTEGER) AS attempt, TRY_CAST(j ->> '$.total_tokens' AS BIGINT) AS total_tokens,
  TRY_CAST(j ->> '$.page_number' AS INTEGER) AS page_number, j ->> '$.endpoint_normalized' AS endpoint_normalized FROM ({_LINES}) WHERE ok""")
def s3_usage_lines(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "usage_raw").select("stream_id", "file_seq", "line_no", F.col("record").alias("value"))
    return S.parse_usage(raw).select("stream_id", "file_seq", "line_no", "status", "attempt", "total_tokens", "page_number", "endpoint_normalized")


@query("""SELECT block_id, x0, y0, x1, y1 FROM (SELECT block_id, greatest(0.0, least(1000.0, x0 / 1000.0 * 1000.0)) AS x0, greatest(0.0, least(1000.0, y0 / 1000.0 * 1000.0)) AS y0, greatest(0.0, least(1000.0, x1 / 1000.0 * 1000.0)) AS x1,
  greatest(0.0, least(1000.0, y1 / 1000.0 * 1000.0)) AS y1 FROM layout_block WHERE block_type = 'text') WHERE x1 > x0 AND y1 > y0""")
def s7_row_boxes(s: SparkSession, d: str) -> DataFrame:
    """Text blocks as the rows of a text recogniser, whose boxes go from 0 to 1."""
    b = table(s, d, "layout_block").where("block_type = 'text'").select("block_id", F.lit("ocr_text").alias("type"), F.array(*(F.col(c) / 1000.0 for c in ("x0", "y0", "x1", "y1"))).alias("bbox"))
    return S.ocr_rows(b).select("block_id", "x0", "y0", "x1", "y1")


@query("SELECT book_id, CAST(p AS INTEGER) AS pno, printf('page_%04d.md', p) AS output FROM (SELECT book_id, unnest(range(least(10, page_count))) AS p FROM book_record WHERE page_count > 0)")
def s9_first_page_names(s: SparkSession, d: str) -> DataFrame:
    """The names of the first ten pages of each book."""
    books = table(s, d, "book_record").where("page_count > 0").select("book_id", F.explode(F.sequence(F.lit(0), F.least(F.lit(10), F.col("page_count").cast("int")) - 1)).alias("pno"))
    return books.select("book_id", "pno", S.page_name(F.col("pno")).alias("output"))


@query("SELECT page_id, to_base64(encode(markdown)) AS base64, CAST(octet_length(encode(markdown)) AS BIGINT) AS bytes FROM page_markdown WHERE markdown IS NOT NULL")
def s16_base64(s: SparkSession, d: str) -> DataFrame:
    content = F.encode("markdown", "UTF-8")
    # Spark breaks the lines of base64
    return table(s, d, "page_markdown").where("markdown is not null").select("page_id", F.regexp_replace(F.base64(content), "[\r\n]", "").alias("base64"), F.octet_length("markdown").cast("long").alias("bytes"))


@query("""SELECT delivery_id, CASE WHEN dpi >= 200 AND b <= 1500000 THEN 200 WHEN dpi >= 150 AND b * 0.5625 <= 1500000 THEN 150 WHEN dpi >= 120 AND b * 0.36 <= 1500000 THEN 120 END AS tier
FROM (SELECT delivery_id, dpi, image_bytes_orig AS b FROM usage_log WHERE image_bytes_orig IS NOT NULL)""")
def s12_payload_tiers(s: SparkSession, d: str) -> DataFrame:
    """The resolution at which a page image fits, if its size falls with the square of the resolution."""
    b = F.col("image_bytes_orig").cast("double")
    sizes = F.create_map(F.lit(200), b, F.lit(150), b * 0.5625, F.lit(120), b * 0.36)
    return table(s, d, "usage_log").where("image_bytes_orig is not null").select("delivery_id", U.payload_tier(sizes, F.col("dpi")).alias("tier"))


@query("SELECT run_id, book_id, page_idx + CASE part_file WHEN 'part2' THEN 200 ELSE 0 END AS pno, CAST(count(*) AS BIGINT) AS blocks FROM layout_block GROUP BY 1, 2, 3")
def x3_pages_of_parts(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "layout_block")
    one, two = (b.where(F.col("part_file") == p).withColumn("pno", F.col("page_idx") + n) for p, n in (("part1", 0), ("part2", 200)))
    return one.unionByName(two).groupBy(*G.PAGE).agg(F.count("*").alias("blocks"))


# ---- text

_UNIX = "regexp_replace(markdown, '\\r\\n?', chr(10), 'g')"
_SPACES = _BLANK.replace(r"\t-\r", r"\t\x0b-\r")
_NORMAL = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({_UNIX}, '(?m){_SPACES}+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g'),
  '(?m)^[ \\t]+([·.]{_BLANK}*\\p{{Nd}}+{_BLANK}*[·.])$', '\\1', 'g')"""


@query(f"SELECT page_id, {_NORMAL} AS text FROM page_markdown")
def t4_normal_lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "page_markdown").select("page_id", X.normal_lines(F.col("markdown")).alias("text"))


def _punctuated(c: str) -> str:
    for mark, wide in zip(",.;:()", "，。；：（）"):
        c = f"regexp_replace(regexp_replace({c}, '([\\x{{3400}}-\\x{{9fff}}])\\{mark}', '\\1{wide}', 'g'), '\\{mark}([\\x{{3400}}-\\x{{9fff}}])', '{wide}\\1', 'g')"
    return c


@query(f"SELECT page_id, {_punctuated('markdown')} AS text FROM page_markdown")
def t2_cjk_punctuation(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "page_markdown").select("page_id", X.cjk_punctuation(F.col("markdown")).alias("text"))


_PLAIN = f"regexp_replace(regexp_replace(regexp_replace({_UNIX}, '(?m)^[ \\t\\n\\x0b\\f\\r]{{0,3}}#{{1,6}}[ \\t\\n\\x0b\\f\\r]+', '', 'g'), '(?m)^[ \\t\\n\\x0b\\f\\r]*[-*+][ \\t\\n\\x0b\\f\\r]+', '', 'g'), '^{_BLANK}+|{_BLANK}+$', '', 'g')"


@query(f"SELECT page_id, {_PLAIN} AS text FROM page_markdown")
def t13_plain_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "page_markdown").select("page_id", X.plain_text(F.col("markdown")).alias("text"))


_IPA = "[\\x{250}-\\x{2ff}\\x{300}-\\x{36f}\\x{1d00}-\\x{1dbf}]"


@query(f"SELECT case_id, array_to_string(list_sort(regexp_extract_all(input, '{_IPA}')), '') AS signature FROM notation_case")
def t26_ipa_signature(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "notation_case").select("case_id", F.array_join(X.ipa_signature(F.col("input")), "").alias("signature"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[\\x{250}-\\x{2ff}\\x{300}-\\x{36f}\\x{1d00}-\\x{1dbf}]')) AS ipa, len(regexp_extract_all(text, '[\\x{3400}-\\x{9fff}]')) AS han,
  len(regexp_extract_all(text, '[\\x{2190}-\\x{22ff}\\x{25a0}-\\x{25ff}]')) AS symbols FROM documents""")
def t23_script_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", *(F.regexp_count("text", F.lit(p)).cast("long").alias(n) for n, p in (("ipa", X.IPA), ("han", X.HAN), ("symbols", X.SYMBOL))))


@query("SELECT delivery_id, CASE lower(trim(coalesce(nullif(endpoint, ''), 'chat'))) WHEN 'chat/completions' THEN 'chat' WHEN '/v1/chat/completions' THEN 'chat' WHEN '/v1/responses' THEN 'responses' WHEN 'anthropic' THEN 'messages' WHEN '/v1/messages' THEN 'messages' ELSE lower(trim(coalesce(nullif(endpoint, ''), 'chat'))) END AS endpoint FROM usage_log")
def t29_endpoints(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "usage_log").select("delivery_id", PL.endpoint(F.col("endpoint")).alias("endpoint"))


_COST = "CAST(coalesce(sum(prompt_tokens) FILTER (WHERE st = 'success'), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(completion_tokens) FILTER (WHERE st = 'success'), 0) AS BIGINT) AS completion_tokens"


@query(_latest("book_id") + f", p AS (SELECT book_id, {_COST} FROM l WHERE n = 1 GROUP BY 1) SELECT *, (prompt_tokens * 2.5::DOUBLE + completion_tokens * 10.0::DOUBLE) / 1000000 AS cost, CAST(NULL AS DOUBLE) AS cost_without_rate FROM p")
def t32_costs(s: SparkSession, d: str) -> DataFrame:
    """What the tokens of each book come to at given rates a million; null while a rate is not given."""
    u = U.usage_summary(table(s, d, "usage_log"), ["book_id"], prices=(2.5, 10.0)).select("book_id", "prompt_tokens", "completion_tokens", "cost")
    return u.withColumn("cost_without_rate", U.cost(F.col("prompt_tokens"), F.col("completion_tokens"), 2.5, None))


@query("SELECT book_id, array_to_string(list_sort(list_distinct(list_concat(pages_done, range(pages_done[1], pages_done[1] + 3)))), ',') AS pages FROM book_record WHERE len(pages_done) > 0")
def t33_page_specs(s: SparkSession, d: str) -> DataFrame:
    first = F.element_at("pages_done", 1)
    spec = F.concat_ws(",", F.array_join("pages_done", ", "), F.concat(first.cast("string"), F.lit("-"), (first + 2).cast("string")))
    return table(s, d, "book_record").where("size(pages_done) > 0").select("book_id", _joined(X.page_spec(spec)).alias("pages"))


@query("SELECT p.page_id, CAST(greatest(1, least(p.page_number + 200, b.page_count)) AS INTEGER) AS page, (p.page_number + 200 > b.page_count OR p.page_number + 200 < 1) AS clamped FROM page_markdown p JOIN book_record b USING (book_id) WHERE p.page_number IS NOT NULL AND b.page_count IS NOT NULL")
def t34_clamped_pages(s: SparkSession, d: str) -> DataFrame:
    """The page 200 pages on, within its book."""
    b = table(s, d, "book_record").where("page_count is not null").select("book_id", "page_count")
    p = table(s, d, "page_markdown").where("page_number is not null").join(b, "book_id")
    page = F.col("page_number") + 200
    to = X.clamp_page(page, F.col("page_count"))
    return p.select("page_id", to.cast("int").alias("page"), (to != page).alias("clamped"))


@query("SELECT delivery_id, CASE WHEN dpi_actual + 40 BETWEEN 72 AND 300 THEN dpi_actual + 40 END AS dpi FROM usage_log")
def t35_resolutions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "usage_log").select("delivery_id", PL.resolution((F.col("dpi_actual") + 40).cast("string")).alias("dpi"))


@query("SELECT delivery_id, CASE WHEN coalesce(base_url_resolved, '') = '' THEN '' ELSE 'sk-**** (' || length(base_url_resolved) || ')' END AS shown FROM usage_log")
def t36_masked(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "usage_log").select("delivery_id", X.masked_key(F.col("base_url_resolved")).alias("shown"))


@query(f"SELECT page_id, CAST(length(markdown) AS BIGINT) AS chars_in, CAST(length({_NORMAL}) AS BIGINT) AS chars_out FROM page_markdown")
def t38_text_sizes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "page_markdown").select("page_id", *(c.alias(n) for n, c in X.sizes(F.col("markdown"), X.normal_lines(F.col("markdown"))).items()))


_NAME = "regexp_replace(source_name, '(?s)^.*/', '')"
_STEM = f"regexp_replace(regexp_replace(regexp_replace(CASE WHEN regexp_matches({_NAME}, '(?s)^.+\\.') THEN regexp_replace({_NAME}, '(?s)\\.[^.]*$', '') ELSE {_NAME} END, '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '^{_BLANK}+|{_BLANK}+$', '', 'g'), '\\.+$', '')"


@query(f"""SELECT book_id, k, CASE WHEN coalesce(stem, '') = '' THEN 'book' WHEN regexp_full_match(upper(stem), 'CON|PRN|AUX|NUL|(?:COM|LPT)[1-9]') THEN stem || '_book' ELSE stem END AS stem
FROM (SELECT book_id, k, {_STEM} AS stem FROM (SELECT book_id, k, CASE k WHEN 0 THEN source_name WHEN 1 THEN 'dir/' || source_name || '..' WHEN 2 THEN 'nul.' || source_name WHEN 3 THEN ' <' || source_name ELSE 'Com' || (page_count % 12) || '.pdf' END AS source_name
  FROM book_record, (SELECT unnest(range(5)) AS k)))""")
def t28_safe_stems(s: SparkSession, d: str) -> DataFrame:
    """Stems of the sources' names, and of such with folders, dots, reserved names and signs."""
    n = F.col("source_name")
    forms = F.array(n, F.concat(F.lit("dir/"), n, F.lit("..")), F.concat(F.lit("nul."), n), F.concat(F.lit(" <"), n), F.concat(F.lit("Com"), (F.col("page_count") % 12).cast("int").cast("string"), F.lit(".pdf")))
    rows = table(s, d, "book_record").select("book_id", F.posexplode(forms).alias("k", "name"))
    return rows.select("book_id", F.col("k").cast("long").alias("k"), X.safe_stem(F.col("name")).alias("stem"))


_PAGE_LIKE = "(?i)[·.]\\s*[0-9０-９]{1,4}\\s*[·.]|[-–—]\\s*[0-9０-９]{1,4}\\s*[-–—]|[0-9０-９]{1,4}|PAGE\\s*[0-9０-９]{1,4}|第\\s*[0-9０-９]{1,4}\\s*页|页\\s*[0-9０-９]{1,4}"


@query(f"SELECT line_key, CASE WHEN regexp_full_match(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '{_PAGE_LIKE}') THEN 1 ELSE 0 END AS page_like FROM geom_line")
def t19_page_like(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "geom_line").select("line_key", X.is_page_like(F.col("text")).cast("int").alias("page_like"))


@query()
def t27_protected_tokens(s: SparkSession, d: str) -> DataFrame:
    """The code, formulas and footers of each page, in their order, that no rewriting may touch."""
    p = table(s, d, "page_markdown").select("page_id", X.protected_tokens(F.col("markdown")).alias("t"))
    return p.select("page_id", F.array_join("t.code_math", "\n").alias("code_math"), F.array_join("t.footers", "\n").alias("footers"))


@query()
def g21_kept_by_cleaning(s: SparkSession, d: str) -> DataFrame:
    """Whether evening out the lines of a page keeps its protected tokens and phonetic signs, and losing a sign is seen."""
    m = F.col("markdown")
    p = table(s, d, "page_markdown").where("markdown is not null")
    return p.select("page_id", X.keeps_invariants(m, X.normal_lines(m)).alias("lines"), X.keeps_invariants(m, F.regexp_replace(m, "ʰ|\\$", "")).alias("without_signs"))


# ---- gates

_COUNTS = """coalesce(len(regexp_extract_all(markdown, '\\x{fffd}')), 0) AS replacement_count, coalesce(len(regexp_extract_all(markdown, '\\?')), 0) AS question_mark_count,
  coalesce(len(regexp_extract_all(array_to_string(regexp_extract_all(markdown, '【[^】]*】|\\[[^\\]]*\\]'), ''), '[\\x{3400}-\\x{9fff}]')), 0) AS han_in_transcription,
  coalesce(len(regexp_extract_all(markdown, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')), 0) AS control_count, coalesce(len(regexp_extract_all(left(markdown, 100), '\\x{fffd}')), 0) AS sample_replacement"""


@query(f"""WITH c AS (SELECT run_id, page_id, {_COUNTS} FROM page_markdown), b AS (SELECT *, replacement_count + question_mark_count + han_in_transcription + control_count > 0 AS bad FROM c),
r AS (SELECT run_id, page_id, row_number() OVER (PARTITION BY run_id ORDER BY page_id) AS n FROM b WHERE bad),
f AS (SELECT run_id, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) AS first_bad FROM r WHERE n <= 10 GROUP BY 1)
SELECT g.*, coalesce(f.first_bad, '') AS first_bad FROM (SELECT run_id, count(*) AS pages, CAST(sum(replacement_count) AS BIGINT) AS replacement_count, CAST(sum(question_mark_count) AS BIGINT) AS question_mark_count, CAST(sum(han_in_transcription) AS BIGINT) AS han_in_transcription,
  CAST(sum(control_count) AS BIGINT) AS control_count, count(*) FILTER (WHERE bad) AS bad_pages FROM b GROUP BY 1) g LEFT JOIN f USING (run_id)""")
def a11_damage_totals(s: SparkSession, d: str) -> DataFrame:
    n = V.damage(table(s, d, "page_markdown"), ["run_id"], "page_id", "markdown")
    return n.select("run_id", "pages", *V.COUNTS, "bad_pages", _joined("first_bad").alias("first_bad"))


@query(f"""WITH c AS (SELECT book_id, {_COUNTS} FROM page_markdown),
g AS (SELECT book_id, sum(replacement_count) AS a, sum(question_mark_count) AS b, sum(han_in_transcription) AS c, sum(control_count) AS e, sum(sample_replacement) AS s FROM c GROUP BY 1)
SELECT book_id, a + b + c + e > 0 AS must_discard, CASE WHEN a + b + c + e = 0 THEN 'no explicit corruption marker in inspected text' ELSE concat_ws('; ', CASE WHEN s > 0 THEN 'U+FFFD replacement characters in first 100 characters' END,
  CASE WHEN a > 0 THEN 'U+FFFD replacement characters in document' END, CASE WHEN c > 0 THEN 'CJK glyphs inside transcription brackets' END, CASE WHEN b > 0 THEN 'literal question marks in extracted text' END, CASE WHEN e > 0 THEN 'unexpected control characters' END) END AS evidence FROM g""")
def g19_must_discard(s: SparkSession, d: str) -> DataFrame:
    n = V.damage(table(s, d, "page_markdown"), ["book_id"], "page_id", "markdown")
    return n.select("book_id", "must_discard", F.array_join("evidence", "; ").alias("evidence"))


_ROUTES = """SELECT run_id, book_id, pno, count(*) FILTER (WHERE mode IS NULL OR mode = 'aligned') AS aligned, count(*) FILTER (WHERE mode = 'header_footer_excluded') AS header_footer, count(*) FILTER (WHERE mode = 'fallback_capacity') AS fallback,
  count(*) FILTER (WHERE mode IS NULL OR mode IN ('aligned', 'header_footer_excluded')) > 0 AS usable FROM (SELECT * EXCLUDE (mode), CASE WHEN header_footer AND mode = 'aligned' THEN 'header_footer_excluded' WHEN line_key % 10 <> 0 THEN mode END AS mode FROM geom_line) GROUP BY 1, 2, 3"""


def _routed(s: SparkSession, d: str) -> DataFrame:
    """Lines with the modes of a written plan: lines in the margin are excluded, some have none."""
    mode = F.when(F.col("header_footer") & (F.col("mode") == "aligned"), "header_footer_excluded").when(F.col("line_key") % 10 != 0, F.col("mode"))
    return table(s, d, "geom_line").withColumn("mode", mode)


@query(_ROUTES)
def g13_usable_pages(s: SparkSession, d: str) -> DataFrame:
    return V.usable_pages(_routed(s, d), G.PAGE)


@query(f"""WITH l AS (SELECT line_key, book_id, run_id, pno, (y0 + y1) / 2.0 AS y, text, {_ANCHOR.replace("(line)", "(text)")} AS anchor FROM geom_line),
k AS (SELECT book_id, anchor FROM (SELECT DISTINCT book_id, run_id, pno, anchor FROM l WHERE length(anchor) BETWEEN 1 AND 80) GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT line_key, coalesce((y <= 120 OR y >= 880) AND (k.anchor IS NOT NULL OR regexp_full_match(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '{_PAGE_LIKE}')), false) AS in_margin FROM l LEFT JOIN k USING (book_id, anchor)""")
def g15_margin_lines(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "geom_line")
    return G.header_footer(g, G.repeated_lines(g, "text", G.PAGE, ["book_id"])).select("line_key", "in_margin")


@query("SELECT block_id, coalesce(trim(text) LIKE '$$%$$' AND length(trim(text)) >= 4, false) AS equation FROM layout_block")
def g17_equations(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "layout_block").select("block_id", G.is_equation("text").alias("equation"))


@query(f"""SELECT stream_id, file_seq, line_no, array_to_string(list_filter(json_keys(j), lambda k: regexp_matches(k, '(?i)api[_-]?key|apikey|secret|token|passwd|password|credential|authorization|bearer|cookie')), ',') AS dropped FROM ({_LINES}) WHERE ok""")
def g11_dropped_secrets(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "usage_raw").where(F.expr("schema_of_variant(try_parse_json(record)) like 'OBJECT%'"))
    return raw.select("stream_id", "file_seq", "line_no", F.array_join(PL.dropped_secrets("record"), ",").alias("dropped"))


@query("""SELECT case_id, len(regexp_extract_all(input, '[A-Za-zɕŋəɛɔɑβʔʂʐɖɳɭɰɣʃʒɹɿʅɦɥɤɲ''’][\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+[ʷʰʲː̃̚ˈˌ\\x{300}-\\x{36f}\\x{1ab0}-\\x{1aff}\\x{1dc0}-\\x{1dff}\\x{20d0}-\\x{20ff}\\x{fe20}-\\x{fe2f}]')) AS split_combining_mark,
  len(regexp_extract_all(input, '(?m)(?:^|[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}-\\x{303f}\\x{ff00}-\\x{ffef}.,;:!?，。；：“”‘’（）|(){}\\[\\]])[\\x{300}-\\x{36f}\\x{1ab0}-\\x{1aff}\\x{1dc0}-\\x{1dff}\\x{20d0}-\\x{20ff}\\x{fe20}-\\x{fe2f}]')) AS stray_combining_mark FROM notation_case""")
def g5_combining_marks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "notation_case").select("case_id", *(c.alias(k) for k, c in R.mark_counts(F.col("input")).items()))


@query("SELECT delivery_id, CASE WHEN http_status IN (401, 403) THEN 'UNAUTHORIZED' WHEN http_status = 400 AND contains(lower(coalesce(error, '')), 'model not found') THEN 'MODEL_NOT_FOUND' WHEN http_status = 429 THEN 'RATE_LIMITED' WHEN http_status BETWEEN 500 AND 599 THEN 'GATEWAY_5XX' WHEN http_status IS NULL AND ltrim(lower(coalesce(error, ''))) LIKE '<%' AND regexp_matches(lower(error), '<html|<!doctype') THEN 'BAD_GATEWAY_HTML' WHEN http_status IS NULL THEN 'TIMEOUT' ELSE 'UNKNOWN' END AS code FROM usage_log WHERE error IS NOT NULL")
def u10_error_classes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "usage_log").where("error is not null").select("delivery_id", PL.error_class(F.col("http_status"), F.col("error")).alias("code"))


@query("SELECT delivery_id, coalesce(extra ->> '$.max_output_tokens', extra ->> '$.max_tokens', extra ->> '$.timeout', '8192') AS value FROM usage_log")
def u9_first_named_value(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "usage_log").select("delivery_id", PL.first_value("extra", ["max_output_tokens", "max_tokens", "timeout"], "8192").alias("value"))


# ---- joins

_PAGES = "SELECT run_id, book_id, pno, max(page_id) AS page_id FROM page_markdown WHERE markdown IS NOT NULL AND pno IS NOT NULL GROUP BY 1, 2, 3"


def _pages(s: SparkSession, d: str) -> DataFrame:
    """The last stored text of each run, book and page."""
    return table(s, d, "page_markdown").where("markdown is not null and pno is not null").groupBy(*G.PAGE).agg(F.max("page_id").alias("page_id"))


@query(f"""WITH p AS ({_PAGES}), w AS (SELECT DISTINCT run_id, book_id, pno FROM layout_block WHERE part_file = 'part1' UNION SELECT DISTINCT run_id, book_id, pno FROM geom_line), w2 AS (SELECT run_id, book_id, pno FROM w WHERE pno IS NOT NULL)
SELECT w2.*, coalesce(a.page_id, b.page_id) AS page_id FROM w2 LEFT JOIN p a USING (run_id, book_id, pno) LEFT JOIN p b ON b.run_id = w2.run_id AND b.book_id = w2.book_id AND b.pno = w2.pno + 1""".replace("SELECT DISTINCT run_id, book_id, pno FROM layout_block WHERE part_file = 'part1'", "SELECT DISTINCT run_id, book_id, page_idx AS pno FROM layout_block WHERE part_file = 'part1'"))
def j1_page_texts(s: SparkSession, d: str) -> DataFrame:
    """The text of each page that has blocks or lines: its own, else that stored one number on."""
    blocks = table(s, d, "layout_block").where("part_file = 'part1'").select("run_id", "book_id", F.col("page_idx").alias("pno"))
    wanted = blocks.union(table(s, d, "geom_line").select(*G.PAGE)).where("pno is not null").distinct()
    return V.by_page_number(wanted, _pages(s, d), ["run_id", "book_id"], "pno", "page_id")


_TEXT_COVER = f"""SELECT p.page_id, p.run_id, p.book_id, p.pno, total, coalesce(aligned, 0) AS aligned, coalesce(covered, 0) AS covered, coalesce(lines, 0) AS lines,
  CASE WHEN total > 0 THEN round_even(coalesce(aligned, 0)::DOUBLE / total, 6) ELSE 1.0 END AS aligned_coverage, CASE WHEN total > 0 THEN round_even(coalesce(covered, 0)::DOUBLE / total, 6) ELSE 1.0 END AS covered_coverage,
  CASE WHEN total > 0 THEN coalesce(aligned, 0)::DOUBLE / total ELSE 1.0 END >= 0.95 AS page_aligned
FROM (SELECT page_id, run_id, book_id, pno, length(regexp_replace({_PLAIN}, '{_BLANK}', '', 'g')) AS total FROM page_markdown WHERE markdown IS NOT NULL) p
LEFT JOIN (SELECT run_id, book_id, pno, CAST(sum(n) FILTER (WHERE mode IS NULL OR mode = 'aligned') AS BIGINT) AS aligned, CAST(sum(n) AS BIGINT) AS covered, count(*) AS lines
  FROM (SELECT run_id, book_id, pno, CASE WHEN header_footer AND mode = 'aligned' THEN 'header_footer_excluded' WHEN line_key % 10 <> 0 THEN mode END AS mode, length(regexp_replace(text, '{_BLANK}', '', 'g')) AS n FROM geom_line) GROUP BY 1, 2, 3) g USING (run_id, book_id, pno)"""


def _covered(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "page_markdown").where("markdown is not null")
    return V.text_coverage(p, "page_id", G.PAGE, X.plain_text(F.col("markdown")), _routed(s, d))


@query(_TEXT_COVER)
def a7_text_coverage(s: SparkSession, d: str) -> DataFrame:
    """Each page's text against its lines; lines without a mode count as aligned."""
    return _covered(s, d)


@query(f"""WITH c AS ({_TEXT_COVER}), b AS (SELECT run_id, book_id, page_idx + CASE part_file WHEN 'part2' THEN 200 ELSE 0 END AS pno, count(*) AS blocks FROM layout_block GROUP BY 1, 2, 3)
SELECT page_id, lines, aligned_coverage, coalesce(blocks, 0) AS blocks FROM c LEFT JOIN b USING (run_id, book_id, pno)""")
def j2_pages_with_reports(s: SparkSession, d: str) -> DataFrame:
    blocks = _blocks_all(s, d).groupBy(*G.PAGE).agg(F.count("*").alias("blocks"))
    return _covered(s, d).join(blocks, G.PAGE, "left").select("page_id", "lines", "aligned_coverage", F.coalesce("blocks", F.lit(0)).alias("blocks"))


def _blocks_all(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "layout_block")
    return b.withColumn("pno", F.col("page_idx") + F.when(F.col("part_file") == "part2", 200).otherwise(0))


@query("""WITH b AS (SELECT block_id, block_type, run_id, book_id, page_idx + CASE part_file WHEN 'part2' THEN 200 ELSE 0 END AS pno, x0, y0, x1, y1, CASE block_type WHEN 'equation' THEN 5 ELSE 2 END AS m FROM layout_block WHERE block_type IN ('table', 'equation')),
h AS (SELECT g.line_key, b.block_id, b.block_type FROM geom_line g JOIN b USING (run_id, book_id, pno) WHERE (g.x0 + g.x1) / 2.0 BETWEEN b.x0 - m AND b.x1 + m AND (g.y0 + g.y1) / 2.0 BETWEEN b.y0 - m AND b.y1 + m)
SELECT line_key, block_id, block_type FROM h WHERE block_type = 'table' UNION ALL SELECT line_key, min(block_id), block_type FROM h WHERE block_type = 'equation' GROUP BY 1, 3""")
def j7_lines_in_regions(s: SparkSession, d: str) -> DataFrame:
    """Lines whose centre lies in a table (all tables) or an equation (the first one)."""
    g = table(s, d, "geom_line").select("line_key", *G.PAGE, G.center("x0", "x1").alias("x"), G.center("y0", "y1").alias("y"))
    b = _blocks_all(s, d).where("block_type in ('table', 'equation')").select("block_id", "block_type", *G.PAGE, *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))
    return G.contained(g, b, G.PAGE, "line_key", "block_id", "block_type", {"table": 2.0, "equation": 5.0}, first_only=("equation",))


_LINES_OF = "SELECT page_id, run_id, book_id, pno, line, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY page_id) AS n FROM (SELECT page_id, run_id, book_id, pno, unnest(string_split(markdown, chr(10))) AS line, unnest(range(len(string_split(markdown, chr(10))))) AS k FROM page_markdown WHERE markdown IS NOT NULL) WHERE trim(line) <> ''"


@query(f"""WITH t AS ({_LINES_OF}), g AS (SELECT line_key, run_id, book_id, pno, row_number() OVER w - 1 AS b, count(*) OVER (PARTITION BY run_id, book_id, pno) AS total FROM geom_line WINDOW w AS (PARTITION BY run_id, book_id, pno ORDER BY line_order, line_key))
SELECT t.page_id, t.i, g.line_key FROM t JOIN g USING (run_id, book_id, pno) WHERE g.b >= least(t.i * g.total // t.n, g.total - 1) AND g.b < least(greatest(least(t.i * g.total // t.n, g.total) + 1, (t.i + 1) * g.total // t.n), g.total) OR (g.b = g.total - 1 AND t.i * g.total // t.n >= g.total)""")
def j9_lines_by_share(s: SparkSession, d: str) -> DataFrame:
    """The lines of a page's text on its geometry lines in proportion of their order."""
    p = table(s, d, "page_markdown").where("markdown is not null").select("page_id", *G.PAGE, F.posexplode(F.filter(F.split("markdown", "\n"), lambda x: F.trim(x) != "")).alias("i", "line"))
    t = p.withColumn("n", F.count("*").over(Window.partitionBy("page_id"))).drop("line")
    w = Window.partitionBy(*G.PAGE)
    b = table(s, d, "geom_line").select("line_key", *G.PAGE, (F.row_number().over(w.orderBy("line_order", "line_key")) - 1).alias("b"), F.count("*").over(w).alias("total"))
    return G.proportional_boxes(t, b, G.PAGE).select("page_id", F.col("i").cast("long").alias("i"), "line_key")


_PROBES = """p AS (SELECT book_id AS probe, CASE WHEN page_count % 3 = 0 THEN 'copy of ' || source_name ELSE upper(source_name) END AS source_name, CASE WHEN page_count % 5 = 0 THEN source_size + 1 ELSE source_size END AS source_size, page_count FROM book_record)"""


@query(f"""WITH {_PROBES}, c AS (SELECT p.probe, r.book_id, CASE WHEN lower(p.source_name) = lower(r.source_name) THEN 3 ELSE 2 END AS q FROM p JOIN book_record r ON lower(p.source_name) = lower(r.source_name) OR (p.source_size = r.source_size AND p.page_count = r.page_count)),
t AS (SELECT probe, max(q) AS quality FROM c GROUP BY 1), k AS (SELECT c.probe, t.quality, count(*) AS candidates, min(book_id) AS book_id FROM c JOIN t ON c.probe = t.probe AND c.q = t.quality GROUP BY 1, 2)
SELECT p.probe, CASE WHEN candidates IS NULL THEN 'not_found' WHEN candidates > 1 THEN 'ambiguous' ELSE 'bound' END AS status, CAST(coalesce(quality, 0) AS INTEGER) AS quality,
  CASE WHEN candidates = 1 THEN k.book_id END AS book_id, CAST(coalesce(candidates, 0) AS BIGINT) AS candidates FROM p LEFT JOIN k USING (probe)""")
def j12_match_sources(s: SparkSession, d: str) -> DataFrame:
    """Files that were moved: some renamed, some changed in size, against the records."""
    r = table(s, d, "book_record")
    name = F.when(F.col("page_count") % 3 == 0, F.concat(F.lit("copy of "), "source_name")).otherwise(F.upper("source_name"))
    size = F.when(F.col("page_count") % 5 == 0, F.col("source_size") + 1).otherwise(F.col("source_size"))
    return B.match_sources(r.select(F.col("book_id").alias("probe"), name.alias("source_name"), size.alias("source_size"), "page_count"), r, "probe")


@query(f"""WITH {_PROBES}, x AS (SELECT r.book_id, r.source_name AS rp, p.source_name AS fp, CASE WHEN r.source_size IS NULL OR p.source_size IS NULL THEN 'unknown' WHEN r.source_size = p.source_size THEN 'same' ELSE 'diff' END AS sz, CASE WHEN r.page_count IS NULL OR p.page_count IS NULL THEN 'unknown' ELSE 'same' END AS pg,
  coalesce(list_max(r.pages_done) + 1 > r.page_count, false) AS foreign_pages FROM book_record r JOIN p ON p.probe = r.book_id)
SELECT book_id, CASE WHEN rp IS NOT NULL AND (coalesce(rp = fp, false) OR (sz = 'same' AND pg = 'same')) THEN 'bound' ELSE 'mismatch' END AS status,
  CASE WHEN rp IS NOT NULL AND (coalesce(rp = fp, false) OR (sz = 'same' AND pg = 'same')) THEN concat_ws(',', CASE WHEN coalesce(rp = fp, false) AND (sz = 'diff' OR pg = 'diff') THEN 'changed' END, CASE WHEN NOT coalesce(rp = fp, false) AND sz = 'same' AND pg = 'same' THEN 'moved' END, CASE WHEN foreign_pages THEN 'foreign_pages' END) ELSE '' END AS warnings FROM x""".replace("upper(source_name)", "source_name"))
def j13_bindings(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "book_record")
    name = F.when(F.col("page_count") % 3 == 0, F.concat(F.lit("copy of "), "source_name")).otherwise(F.col("source_name"))
    size = F.when(F.col("page_count") % 5 == 0, F.col("source_size") + 1).otherwise(F.col("source_size"))
    facts = r.select("book_id", name.alias("path"), size.alias("size"), F.col("page_count").alias("pages"))
    records = r.select("book_id", F.col("source_name").alias("path"), F.col("source_size").alias("size"), F.col("page_count").alias("pages"), F.array_max("pages_done").alias("last_page"))
    return V.binding(records, facts).select("book_id", "status", F.array_join("warnings", ",").alias("warnings"))


@query("""WITH b AS (SELECT block_id, (page_idx % 4) * 90 AS t, x0 - 10.0 AS a0, y0 - 20.0 AS b0, x1 - 10.0 AS a1, y1 - 20.0 AS b1 FROM layout_block), r AS (SELECT block_id,
  CASE t WHEN 0 THEN a0 WHEN 90 THEN 1400 - b0 WHEN 180 THEN 900 - a0 ELSE b0 END AS p0, CASE t WHEN 0 THEN b0 WHEN 90 THEN a0 WHEN 180 THEN 1400 - b0 ELSE 900 - a0 END AS q0,
  CASE t WHEN 0 THEN a1 WHEN 90 THEN 1400 - b1 WHEN 180 THEN 900 - a1 ELSE b1 END AS p1, CASE t WHEN 0 THEN b1 WHEN 90 THEN a1 WHEN 180 THEN 1400 - b1 ELSE 900 - a1 END AS q1 FROM b)
SELECT block_id, least(p0, p1)::DOUBLE AS x0, least(q0, q1)::DOUBLE AS y0, greatest(p0, p1)::DOUBLE AS x1, greatest(q0, q1)::DOUBLE AS y1 FROM r""")
def j16_turned_boxes(s: SparkSession, d: str) -> DataFrame:
    """Blocks as if their page were turned by its number and cut at (10, 20)."""
    b = table(s, d, "layout_block")
    box = I.rotated_box(*(F.col(c) for c in ("x0", "y0", "x1", "y1")), F.col("page_idx") % 4 * 90, F.lit(900.0), F.lit(1400.0), F.lit(10.0), F.lit(20.0))
    return b.select("block_id", box.alias("b")).select("block_id", "b.*")


@query()
def j5_position_gate(s: SparkSession, d: str) -> DataFrame:
    """The lines of a page's text as they were laid on the page, against the lines printed there."""
    pages = table(s, d, "page_markdown").where("markdown is not null")
    laid = A.align_pages(pages, "page_id", "markdown", table(s, d, "geom_line"), "line_key").select(*G.PAGE, F.explode("lines").alias("l")).where("l.mode = 'aligned'")
    expected = laid.select(*G.PAGE, F.col("l.order").cast("long").alias("id"), "l.text", "l.y0", "l.y1")
    actual = table(s, d, "geom_line").select(*G.PAGE, F.col("line_key").alias("id"), "text", "y0", "y1")
    return A.position_gate(expected, actual, G.PAGE, "id").withColumn("worst", F.array_join(F.transform("worst", lambda x: F.format_string("%.3f %s", x["dev"], x["expected"])), "\n"))


_KEYS = ["pharynx", "Glottis", "语料", "硬腭", "spectrum", "zzz"]


@query(f"""SELECT k.word, count(*) AS documents, CAST(min(doc_id) AS BIGINT) AS first_doc, CAST(sum(length(text)) AS BIGINT) AS chars, md5(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS hit_list FROM documents, (SELECT unnest({_KEYS}) AS word) k WHERE contains(lower(text), lower(k.word)) GROUP BY 1""")
def a13_keyword_hits(s: SparkSession, d: str) -> DataFrame:
    """The documents that hold each of a few words, case aside: how many, their characters, and a digest of the list."""
    text = F.lower("text")
    hits = F.filter(F.array(*map(F.lit, _KEYS)), lambda k: F.contains(text, F.lower(k)))
    rows = table(s, d, "documents").select("doc_id", F.length("text").alias("n"), F.explode(hits).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"), F.sum("n").cast("long").alias("chars"), F.md5(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",")).alias("hit_list"))


# ---- aggregates



def _canon(c: str) -> str:
    return f"regexp_replace(nfc_normalize({c}), '{_BLANK}', '', 'g')"


def _chars(c: str) -> str:
    return f"list_sort(string_split({_canon(c)}, ''))"


_BY_PAGE = "SELECT run_id, book_id, pno, string_agg(text, chr(10) ORDER BY line_order, line_key) AS lines FROM geom_line GROUP BY 1, 2, 3"


def _printed(s: SparkSession, d: str) -> DataFrame:
    g = F.array_sort(F.collect_list(F.struct("line_order", "line_key", "text")))
    return table(s, d, "geom_line").groupBy(*G.PAGE).agg(F.array_join(F.transform(g, lambda x: x["text"]), "\n").alias("lines"))


@query(f"SELECT page_id, {_chars('markdown')} = {_chars('lines')} AS same FROM page_markdown JOIN ({_BY_PAGE}) USING (run_id, book_id, pno) WHERE markdown IS NOT NULL")
def a12_same_characters(s: SparkSession, d: str) -> DataFrame:
    """Pages with lines: whether the joined lines hold the same characters as the page."""
    p = table(s, d, "page_markdown").where("markdown is not null").join(_printed(s, d), G.PAGE)
    return p.select("page_id", A.same_characters(F.col("markdown"), F.col("lines")).alias("same"))


_SEEN = f"""SELECT run_id, book_id, pno, string_agg(text, '' ORDER BY round_even((y0 + y1) / 2.0 / 12.0, 0), round_even(x0, 0), (y0 + y1) / 2.0, (x0 + x1) / 2.0, line_key) AS visual, string_agg(text, '' ORDER BY line_order, line_key) AS lines FROM geom_line GROUP BY 1, 2, 3"""


@query(f"""WITH c AS ({_TEXT_COVER}), v AS ({_SEEN}), f AS (SELECT c.run_id, c.page_id, aligned_coverage, covered_coverage, page_aligned, coalesce({_chars('m.markdown')} = {_chars('v.lines')}, false) AS zero_loss,
  CASE WHEN v.lines IS NULL THEN NULL ELSE {_canon('v.visual')} = {_canon('v.lines')} END AS order_ok FROM c JOIN page_markdown m USING (page_id) LEFT JOIN v ON v.run_id = c.run_id AND v.book_id = c.book_id AND v.pno = c.pno)
SELECT run_id, count(*) AS pages_total, count(*) FILTER (WHERE zero_loss) AS zero_loss_pages, count(order_ok) AS reading_order_checked_pages, count(*) FILTER (WHERE order_ok) AS reading_order_ok_pages, count(*) AS geometric_ok_pages, 1.0::DOUBLE AS mean_geometric_pass_ratio,
  count(*) FILTER (WHERE page_aligned) AS aligned_pages, count(*) FILTER (WHERE page_aligned)::DOUBLE / count(*) AS aligned_pages_ratio, CAST(sum(CAST(round(aligned_coverage * 1000000) AS BIGINT)) AS BIGINT) AS aligned_millionths, CAST(sum(CAST(round(covered_coverage * 1000000) AS BIGINT)) AS BIGINT) AS covered_millionths, CAST(0 AS BIGINT) AS computed_pages, 0.0::DOUBLE AS mean_cell_recall, 0.0::DOUBLE AS mean_cell_precision,
  coalesce(string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) FILTER (WHERE NOT zero_loss), '') AS zero_loss_fail_pages, coalesce(string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) FILTER (WHERE NOT order_ok), '') AS reading_order_fail_pages, '' AS geometric_fail_pages, '' AS table_unreliable_pages FROM f GROUP BY 1""")
def a9_verify_summary(s: SparkSession, d: str) -> DataFrame:
    """Pages against their printed lines: lost characters, order, coverage; geometry and cells are not compared here."""
    g = G.visual_order(table(s, d, "geom_line"), "line_key")
    order = lambda *c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*c, "line_key", "text"))), lambda x: x["text"]), "")
    v = g.groupBy(*G.PAGE).agg(order("visual_order").alias("visual"), order("line_order").alias("lines"))
    both = _covered(s, d).drop("lines").join(table(s, d, "page_markdown").select("page_id", "markdown"), "page_id").join(v, G.PAGE, "left")
    facts = both.select(
        "run_id", "page_id", "aligned_coverage", "covered_coverage", "page_aligned", A.same_characters(F.col("markdown"), F.col("lines")).alias("zero_loss"),
        F.when(F.col("lines").isNotNull(), X.canonical(F.col("visual")) == X.canonical(F.col("lines"))).alias("order_ok"), F.lit(0).alias("geometric_checked"), F.lit(1.0).alias("geometric_ratio"), F.lit(True).alias("geometric_ok"),
        F.lit(False).alias("table_unreliable"), F.lit(None).cast("double").alias("cell_recall"), F.lit(None).cast("double").alias("cell_precision"),
    )
    out = V.verify_summary(facts, ["run_id"], "page_id")
    # means as sums of millionths, so that the order of adding does not show
    for c in ("aligned", "covered"):
        out = out.withColumn(f"{c}_millionths", F.round(F.col(f"mean_{c}_coverage") * F.col("pages_total") * 1_000_000).cast("long")).drop(f"mean_{c}_coverage")
    return out.withColumns({c: _joined(c) for c in out.columns if c.endswith("_fail_pages") or c == "table_unreliable_pages"})


@query(f"""WITH c AS ({_TEXT_COVER}), u AS ({_ROUTES}) SELECT run_id, count(*) AS pages, count(*) FILTER (WHERE coalesce(usable, false)) AS predicted_embedded, count(*) FILTER (WHERE NOT coalesce(usable, false)) AS predicted_fallback, count(*) FILTER (WHERE page_aligned) AS aligned_pages FROM c LEFT JOIN u USING (run_id, book_id, pno) GROUP BY 1""")
def a10_census(s: SparkSession, d: str) -> DataFrame:
    return V.census(_covered(s, d).join(V.usable_pages(_routed(s, d), G.PAGE).select(*G.PAGE, "usable"), G.PAGE, "left"), ["run_id"])


@query(f"""WITH u AS ({_ROUTES}), b AS (SELECT run_id, book_id, page_idx + CASE part_file WHEN 'part2' THEN 200 ELSE 0 END AS pno FROM layout_block WHERE least(x0, y0, x1, y1) >= 0 AND greatest(x0, y0, x1, y1) <= 1000 AND x1 > x0 AND y1 > y0 AND length(trim(text)) > 0 GROUP BY 1, 2, 3)
SELECT reason, count(*) AS pages FROM (SELECT CASE WHEN b.pno IS NOT NULL THEN 'external' WHEN u.usable THEN 'embedded' ELSE 'fallback' END AS reason FROM ({_PAGES}) p LEFT JOIN b USING (run_id, book_id, pno) LEFT JOIN u USING (run_id, book_id, pno)) GROUP BY 1""")
def n12_route_reasons(s: SparkSession, d: str) -> DataFrame:
    """Where the geometry of each page with a text comes from: valid blocks, else usable lines, else nowhere."""
    blocks = _blocks_all(s, d).where(G.valid_box("text")).groupBy(*G.PAGE).agg(F.collect_list("block_id").alias("external"))
    lines = V.usable_pages(_routed(s, d), G.PAGE).where("usable").select(*G.PAGE, F.array(F.lit(1).cast("long")).alias("embedded"))
    c = _pages(s, d).join(blocks, G.PAGE, "left").join(lines, G.PAGE, "left").withColumn("ink", F.array().cast("array<bigint>"))
    return LY.routed(c, ["page_id"]).groupBy("reason").agg(F.count("*").alias("pages"))


@query(_EVENTS + """, f AS (SELECT run_id, model_resolved, received_at AS t, delivery_id AS i FROM e WHERE model_resolved IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id, model_resolved ORDER BY received_at, delivery_id) = 1)
SELECT run_id, string_agg(model_resolved, ',' ORDER BY t, i) AS models FROM f GROUP BY 1""")
def a19_models_in_order(s: SparkSession, d: str) -> DataFrame:
    """The models of each run in the order they were first used."""
    return V.ordered_distinct(table(s, d, "usage_log"), ["run_id"], "model_resolved", ["received_at", "delivery_id"]).select("run_id", F.array_join("values", ",").alias("models"))


@query(_latest("book_id") + """, p AS (SELECT book_id, count(*) FILTER (WHERE st = 'success') AS pages_ok FROM l WHERE n = 1 GROUP BY 1)
SELECT book_id, pages_ok, CAST(coalesce(b.page_count, 0) AS BIGINT) AS planned, CASE WHEN b.page_count > 0 THEN round_even(pages_ok / b.page_count * 100, 1) ELSE 0.0 END AS pct, round_even(pages_ok / 60.0::DOUBLE, 2) AS pages_per_min,
  CAST(trunc(CASE WHEN pages_ok > 0 AND coalesce(b.page_count, 0) > pages_ok THEN (b.page_count - pages_ok) / (pages_ok / 60.0::DOUBLE) * 60000 ELSE 0 END) AS BIGINT) AS eta_ms FROM p LEFT JOIN book_record b USING (book_id)""")
def a4_progress_of_books(s: SparkSession, d: str) -> DataFrame:
    """How far each book is an hour after its start."""
    planned = table(s, d, "book_record").select("book_id", F.col("page_count").alias("planned"))
    p = U.progress(table(s, d, "usage_log"), ["book_id"], planned, 3_600_000)
    return p.select("book_id", "pages_ok", "planned", "pct", "pages_per_min", F.col("eta_ms"))


_RULES = """SELECT case_id, len(regexp_extract_all(input, '\\\\(?:underset|overset)\\b|\\\\\\[|\\\\\\]')) + len(regexp_extract_all(input, '\\$')) - len(regexp_extract_all(input, '\\\\\\$')) AS latex_residue,
  len(regexp_extract_all(input, '\\[[^\\]\\r\\n]*[_^][^\\]\\r\\n]*\\]')) AS banned_bracket_mark, len(regexp_extract_all(input, '\\[(?:tɕ''?|tc''?|[tkdp])[wW]\\]')) AS dropped_attached_mark,
  len(regexp_extract_all(input, '\\[(?:[kpt][hH]|[ɕnl][jJ])\\]')) AS ascii_modifier_letter FROM notation_case WHERE input IS NOT NULL"""


def _rule_rows(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "notation_case").where("input is not null")
    c = R.rule_counts(F.col("input"))
    codes = [k for k in c if k != "ascii_position_operator"]
    return n.select("case_id", F.explode(F.array(*(F.struct(F.lit(k).alias("code"), c[k].alias("n")) for k in codes))).alias("x")).select("case_id", "x.*").where("n > 0")


@query(f"""WITH r AS ({_RULES}), u AS (UNPIVOT r ON latex_residue, banned_bracket_mark, dropped_attached_mark, ascii_modifier_letter INTO NAME code VALUE n)
SELECT code, CAST(sum(n) AS BIGINT) AS issues, count(*) AS texts, CAST(sum(sum(n)) OVER () AS BIGINT) AS total FROM u WHERE n > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def a6_rule_rollup(s: SparkSession, d: str) -> DataFrame:
    """Issues of the rules that can be counted: the ten most frequent codes, and all issues."""
    n = _rule_rows(s, d)
    per = n.groupBy("code").agg(F.sum("n").cast("long").alias("issues"), F.count("*").alias("texts"))
    total = per.agg(F.sum("issues").alias("t")).first()["t"]
    return per.withColumn("total", F.lit(total).cast("long")).orderBy(F.desc("issues"), "code").limit(10)


@query(f"""WITH r AS ({_RULES}) SELECT case_id, latex_residue + banned_bracket_mark + dropped_attached_mark + ascii_modifier_letter AS issues FROM r WHERE issues > 0 ORDER BY issues DESC, case_id LIMIT 10""")
def k2_worst_texts(s: SparkSession, d: str) -> DataFrame:
    return _rule_rows(s, d).groupBy("case_id").agg(F.sum("n").cast("long").alias("issues")).orderBy(F.desc("issues"), "case_id").limit(10)


# ---- sorting and sets


@query("SELECT run_id, epoch_us(max(received_at)) AS last_us, count(*) AS rows FROM usage_log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def k3_newest_runs(s: SparkSession, d: str) -> DataFrame:
    runs = table(s, d, "usage_log").groupBy("run_id").agg(F.unix_micros(F.max("received_at")).alias("last_us"), F.count("*").alias("rows"))
    return U.paged(runs, [F.desc("last_us"), F.asc("run_id")], 20, most=200)


@query(_EVENTS + " SELECT delivery_id, st AS status FROM e ORDER BY received_at, delivery_id LIMIT 50 OFFSET 100")
def k3_third_page_of_log(s: SparkSession, d: str) -> DataFrame:
    rows = U.events(table(s, d, "usage_log")).select("delivery_id", "status", "received_at")
    return U.paged(rows, [F.asc("received_at"), F.asc("delivery_id")], 50, 100, most=2000).select("delivery_id", "status")


@query("""WITH m AS (SELECT b.book_id, p.pno FROM book_record b, LATERAL (SELECT CAST(unnest(range(b.page_count)) AS INTEGER) AS pno) p WHERE b.page_count > 0 AND NOT EXISTS (SELECT 1 FROM page_markdown m WHERE m.book_id = b.book_id AND m.pno = p.pno)),
r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY pno) AS n, count(*) OVER (PARTITION BY book_id) AS missing FROM m) SELECT book_id, pno, missing FROM r WHERE n <= 5""")
def k6_first_missing(s: SparkSession, d: str) -> DataFrame:
    """The first five pages each book lacks, and how many it lacks."""
    m = U.missing_pages(table(s, d, "book_record"), table(s, d, "page_markdown"))
    n = m.groupBy("book_id").agg(F.count("*").alias("missing"))
    return U.top_per_group(m, ["book_id"], [F.asc("pno")], 5).join(n, "book_id").select("book_id", "pno", "missing")


@query("SELECT book_id, source_name FROM (SELECT *, row_number() OVER (PARTITION BY lower(source_name) ORDER BY created_at NULLS FIRST, book_id) AS n FROM book_record WHERE source_name IS NOT NULL) WHERE n = 1")
def x4_first_of_each_name(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "book_record").select("book_id", "source_name", "created_at")
    return V.first_named(r, F.col("source_name"), ["created_at", "book_id"]).select("book_id", "source_name")


# ---- order and geometry


@query("SELECT line_key, CASE WHEN cell_row IS NOT NULL THEN '#t' || cell_row || 'c' || coalesce(cell_col, 0) ELSE printf('L%04d', n - 1) END AS fragment FROM (SELECT *, row_number() OVER (PARTITION BY run_id, book_id, pno ORDER BY (y0 + y1) / 2.0, x0, line_key) AS n FROM geom_line)")
def w8_fragment_ids(s: SparkSession, d: str) -> DataFrame:
    g = G.reading_order(table(s, d, "geom_line"), "line_key")
    return g.select("line_key", G.fragment_id(F.col("reading_order"), F.col("cell_row"), F.col("cell_col")).alias("fragment"))


@query("""WITH p AS (SELECT run_id, book_id, pno, CAST(floor(y0 / 10) AS INTEGER) AS a, CAST(floor(y1 / 10) AS INTEGER) AS z FROM geom_line WHERE y1 >= y0), v AS (SELECT run_id, book_id, pno, unnest(range(a, z + 1)) AS pos FROM p),
n AS (SELECT run_id, book_id, pno, pos, count(*) AS c FROM v WHERE pos BETWEEN 0 AND 99 GROUP BY ALL), o AS (SELECT *, CASE WHEN pos - lag(pos) OVER w > 2 OR lag(pos) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM n WHERE c >= 1 WINDOW w AS (PARTITION BY run_id, book_id, pno ORDER BY pos)),
b AS (SELECT *, sum(new) OVER (PARTITION BY run_id, book_id, pno ORDER BY pos ROWS UNBOUNDED PRECEDING) AS band FROM o), r AS (SELECT run_id, book_id, pno, min(pos) AS "start", max(pos) AS last FROM b GROUP BY run_id, book_id, pno, band)
SELECT run_id, book_id, pno, CAST("start" AS INTEGER) AS "start", CAST(CASE WHEN 99 - last <= 1 THEN 99 ELSE last END AS INTEGER) AS "end" FROM r WHERE CASE WHEN 99 - last <= 1 THEN 99 ELSE last END - "start" + 1 BETWEEN 2 AND 60""")
def w7_bands_of_lines(s: SparkSession, d: str) -> DataFrame:
    """Bands of a page that bear lines, from a profile of a hundred steps."""
    at = table(s, d, "geom_line").where("y1 >= y0").select(*G.PAGE, F.explode(F.sequence(F.floor(F.col("y0") / 10).cast("int"), F.floor(F.col("y1") / 10).cast("int"))).alias("pos")).where("pos between 0 and 99")
    n = at.groupBy(*G.PAGE, "pos").agg(F.count("*").alias("c"))
    profile = n.groupBy(*G.PAGE).agg(F.map_from_entries(F.collect_list(F.struct("pos", "c"))).alias("m")).select(*G.PAGE, F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0))).alias("profile"))
    return G.ink_bands(profile, G.PAGE, "profile", 1, 1, 2, 60)


@query("""SELECT block_id, CASE WHEN x1 / 800.0 > x0 / 800.0 AND least(1000.0, greatest(0.0, x1 * 1000.0 / 800)) > least(1000.0, greatest(0.0, x0 * 1000.0 / 800)) AND least(1000.0, greatest(0.0, y1 * 1000.0 / 1200)) > least(1000.0, greatest(0.0, y0 * 1000.0 / 1200)) THEN
  printf('%.4f %.4f %.4f %.4f', least(1000.0, greatest(0.0, x0 * 1000.0 / 800))::DOUBLE, least(1000.0, greatest(0.0, y0 * 1000.0 / 1200))::DOUBLE, least(1000.0, greatest(0.0, x1 * 1000.0 / 800))::DOUBLE, least(1000.0, greatest(0.0, y1 * 1000.0 / 1200))::DOUBLE) END AS box FROM layout_block""")
def n1_normal_boxes(s: SparkSession, d: str) -> DataFrame:
    """Blocks as if given in points on a page of 800 x 1200."""
    b = table(s, d, "layout_block").select("block_id", G.normal_box(*(F.col(c) for c in ("x0", "y0", "x1", "y1")), F.lit(800.0), F.lit(1200.0)).alias("b"))
    return b.select("block_id", F.when(F.col("b").isNotNull(), F.format_string("%.4f %.4f %.4f %.4f", "b.x0", "b.y0", "b.x1", "b.y1")).alias("box"))


@query("SELECT block_id, greatest(0.0, least(1000.0, x1 * 1.2 - 50))::DOUBLE AS x, greatest(0.0, least(1000.0, y0 * 1.2 - 150))::DOUBLE AS y FROM layout_block")
def n2_clamped(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "layout_block").select("block_id", G.clamp(F.col("x1") * 1.2 - 50).alias("x"), G.clamp(F.col("y0") * 1.2 - 150).alias("y"))


@query("SELECT line_key, 50.0 + i * (900.0::DOUBLE / n) AS fy0, least(1000.0, 50.0 + i * (900.0::DOUBLE / n) + 20.0) AS fy1 FROM (SELECT line_key, row_number() OVER (PARTITION BY run_id, book_id, pno ORDER BY line_order, line_key) - 1 AS i, count(*) OVER (PARTITION BY run_id, book_id, pno) AS n FROM geom_line)")
def n3_plain_fallback_boxes(s: SparkSession, d: str) -> DataFrame:
    """The boxes of lines of which nothing is known, in the variant with lines of one height."""
    w = Window.partitionBy(*G.PAGE)
    g = table(s, d, "geom_line").select("line_key", (F.row_number().over(w.orderBy("line_order", "line_key")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    b = G.plain_fallback_box(F.col("i"), F.col("n"))
    return g.select("line_key", b["y0"].alias("fy0"), b["y1"].alias("fy1"))


# ---- tables and headings

_STRIPPED = "regexp_replace(c, '" + _BLANK + "', '', 'g')"


@query(f"""WITH l AS (SELECT page_id, k, trim(line) AS line FROM (SELECT page_id, unnest(string_split(markdown, chr(10))) AS line, unnest(range(len(string_split(markdown, chr(10))))) AS k FROM page_markdown)),
c AS (SELECT page_id, k, unnest(string_split(regexp_replace(line, '^\\|+|\\|+$', '', 'g'), '|')) AS c, unnest(range(len(string_split(regexp_replace(line, '^\\|+|\\|+$', '', 'g'), '|')))) AS j FROM l WHERE contains(line, '|') AND NOT regexp_full_match(line, '[\\s:\\-|]*'))
SELECT page_id, string_agg({_STRIPPED}, chr(10) ORDER BY k, j) AS cells FROM c WHERE {_STRIPPED} <> '' GROUP BY 1""")
def h4_markdown_cells(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "page_markdown").select("page_id", TB.markdown_cells(F.col("markdown")).alias("cells")).where(F.size("cells") > 0).select("page_id", F.array_join("cells", "\n").alias("cells"))


@query(f"SELECT run_id, book_id, pno, string_agg({_canon('text')}, chr(10) ORDER BY cell_row, cell_col, line_key) AS cells FROM geom_line WHERE cell_row IS NOT NULL AND {_canon('text')} <> '' GROUP BY 1, 2, 3")
def h5_cells_of_lines(s: SparkSession, d: str) -> DataFrame:
    """The texts of a page's table cells, from the lines that say they are cells."""
    c = table(s, d, "geom_line").where("cell_row is not null").select(*G.PAGE, F.struct("cell_row", "cell_col", "line_key", X.canonical(F.col("text")).alias("t")).alias("c")).where("c.t != ''")
    return c.groupBy(*G.PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["t"]), "\n").alias("cells"))


@query(f"""WITH m AS (SELECT book_id, pno, markdown FROM (SELECT *, row_number() OVER (PARTITION BY book_id, pno ORDER BY coalesce(epoch_us(produced_at), 0) DESC, page_id DESC) AS n FROM page_markdown WHERE markdown IS NOT NULL AND pno IS NOT NULL) WHERE n = 1),
l AS (SELECT book_id, pno, regexp_replace(line, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS line, k FROM (SELECT book_id, pno, unnest(string_split({_UNIX}, chr(10))) AS line, unnest(range(len(string_split({_UNIX}, chr(10))))) AS k FROM m))
SELECT book_id, pno, CAST(row_number() OVER (PARTITION BY book_id, pno ORDER BY k) - 1 AS INTEGER) AS seq, CAST(length(regexp_extract(line, '^(#{{1,6}})', 1)) AS INTEGER) AS level, regexp_replace(regexp_replace(line, '^#{{1,6}}', ''), '^{_BLANK}+', '') AS title FROM l WHERE regexp_matches(line, '^#{{1,6}}{_BLANK}+[^\\n]')""")
def h7_table_of_contents(s: SparkSession, d: str) -> DataFrame:
    from leafmill.functions import pages as P

    rows = B.latest_pages(table(s, d, "page_markdown"), "page_id", "markdown")
    return rows.select("book_id", "pno", F.posexplode(P.heading_list("markdown")).alias("seq", "h")).select("book_id", "pno", "seq", "h.level", "h.title")


_TRY = f"""m AS (SELECT book_id, pno, markdown FROM (SELECT *, row_number() OVER (PARTITION BY book_id, pno ORDER BY coalesce(epoch_us(produced_at), 0) DESC, page_id DESC) AS n FROM page_markdown WHERE markdown IS NOT NULL AND pno IS NOT NULL) WHERE n = 1),
f AS (SELECT book_id, pno, list(text ORDER BY line_key) AS footers FROM geom_line WHERE header_footer AND y0 > 500 GROUP BY 1, 2),
l AS (SELECT m.book_id, m.pno, list_filter(list_transform(string_split({_UNIX}, chr(10)), lambda x: regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '', 'g')), lambda x: x <> '') AS x, coalesce(f.footers, []) AS footers FROM m LEFT JOIN f ON f.book_id = m.book_id AND f.pno = m.pno),
t AS (SELECT book_id, pno, list_concat(list_concat(list_transform(footers, lambda x: regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '', 'g')), x[-3:]), x[1:1]) AS tries FROM l),
n AS (SELECT book_id, pno, list_filter(list_transform(tries, lambda x: coalesce(TRY_CAST(nullif(regexp_extract(x, '^[·.\\-—–\\s]*([0-9]{{1,4}})[·.\\-—–\\s]*$', 1), '') AS INTEGER), TRY_CAST(nullif(regexp_extract(x, '^第\\s*([0-9]{{1,4}})\\s*页$', 1), '') AS INTEGER))), lambda x: x BETWEEN 1 AND 3000)[1] AS d,
  list_filter(list_transform(tries, lambda x: list_position(['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x'], lower(regexp_extract(x, '^[·.\\-—–\\s]*([ivxIVX]{{1,8}})[·.\\-—–\\s]*$', 1)))), lambda x: x > 0)[1] AS r FROM t),
s AS (SELECT book_id, pno, CASE WHEN d IS NOT NULL THEN 'D' WHEN r IS NOT NULL THEN 'r' END AS style, coalesce(d, r) AS number FROM n)"""


def _numbers(s: SparkSession, d: str) -> DataFrame:
    from leafmill.functions import pages as P

    rows = B.latest_pages(table(s, d, "page_markdown"), "page_id", "markdown")
    foot = table(s, d, "geom_line").where("header_footer and y0 > 500").groupBy("book_id", "pno").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_key", "text"))), lambda x: x["text"]).alias("footers"))
    both = rows.join(foot, ["book_id", "pno"], "left")
    return both.select("book_id", "pno", P.printed_page_number(F.col("markdown"), F.coalesce("footers", F.array().cast("array<string>"))).alias("x")).select("book_id", "pno", "x.style", "x.number")


@query(f"WITH {_TRY} SELECT book_id, pno, style, number FROM s")
def t37_printed_numbers(s: SparkSession, d: str) -> DataFrame:
    """The number printed on each page: its footer lines first, then its last three lines, then its first."""
    return _numbers(s, d)


@query(f"""WITH {_TRY}, u AS (SELECT book_id, pno, style, number FROM s WHERE number IS NOT NULL UNION ALL SELECT book_id, 0, 'D', 1 FROM s GROUP BY book_id HAVING arg_min(coalesce(number, -1), pno) = -1),
w AS (SELECT *, lag(style) OVER k AS ps, lag(number - pno) OVER k AS pd FROM u WINDOW k AS (PARTITION BY book_id ORDER BY pno, style))
SELECT book_id, CAST(pno AS INTEGER) AS startpage, style, CAST(number AS INTEGER) AS firstpagenum FROM w WHERE ps IS NULL OR ps <> style OR pd <> number - pno""")
def w6_page_labels(s: SparkSession, d: str) -> DataFrame:
    return G.page_label_rules(_numbers(s, d))


@query()
def a14_cell_match(s: SparkSession, d: str) -> DataFrame:
    """The cells of each table block against the lines printed in its band."""
    b = table(s, d, "layout_block").where("block_type = 'table'").select("block_id", TB.table_grid("table_body").alias("g"))
    expected = b.select("block_id", F.transform(TB.grid_cells(F.col("g")), X.compact).alias("expected"))
    g = table(s, d, "geom_line").select("line_key", *G.PAGE, G.center("y0", "y1").alias("y"), X.compact(F.col("text")).alias("t"))
    rows = G.binned_join(g, _blocks(s, d), G.PAGE, F.col("y"), F.col("b0") - 15.0, F.col("b1") + 15.0)
    actual = rows.groupBy("block_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_key", "t"))), lambda x: x["t"]).alias("actual"))
    both = materialize(expected.join(actual, "block_id", "left"), "cells")
    m = both.select("block_id", A.cell_match("expected", "actual").alias("m")).select("block_id", "m.*")
    return m.withColumns({"recall": F.when(F.col("expected") > 0, F.col("matched") / F.col("expected")), "precision": F.when(F.col("actual") > 0, F.col("matched") / F.col("actual"))})


# ---- layout


@query("""SELECT case_id, len(regexp_extract_all(input, '[\\x{250}-\\x{36f}\\x{1d00}-\\x{1dbf}]+')) AS ipa, len(regexp_extract_all(input, '[\\x{2190}-\\x{22ff}\\x{25a0}-\\x{25ff}]+')) AS symbol, len(regexp_extract_all(input, '[\\x{0}-\\x{7f}]+')) AS latin,
  len(regexp_extract_all(input, '[^\\x{0}-\\x{7f}\\x{250}-\\x{36f}\\x{1d00}-\\x{1dbf}\\x{2190}-\\x{22ff}\\x{25a0}-\\x{25ff}]+')) AS han FROM notation_case""")
def t22_font_runs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "notation_case").select("case_id", *(c.alias(k) for k, c in LY.script_run_counts(F.col("input")).items()))


@query("""WITH p AS (SELECT run_id, book_id, pno, row_number() OVER (PARTITION BY run_id, book_id ORDER BY pno) - 1 AS pos, CASE WHEN pno % 7 <> 0 OR hash_free THEN pno END AS reported FROM (SELECT DISTINCT run_id, book_id, pno, run_id LIKE '%1' AS hash_free FROM geom_line WHERE pno IS NOT NULL)),
n AS (SELECT *, count(reported) OVER (PARTITION BY run_id, book_id) AS r, count(*) OVER (PARTITION BY run_id, book_id) AS n FROM p)
SELECT run_id, book_id, CAST(pos AS BIGINT) AS pos, CAST(CASE WHEN r >= n THEN reported ELSE pos END AS BIGINT) AS page FROM n""")
def j14_source_pages(s: SparkSession, d: str) -> DataFrame:
    """The pages of a run with lines, where some pages report no number: then the whole run goes by position."""
    p = table(s, d, "geom_line").where("pno is not null").select(*G.PAGE).distinct()
    w = Window.partitionBy("run_id", "book_id").orderBy("pno")
    p = p.withColumns({"pos": (F.row_number().over(w) - 1).cast("long"), "reported": F.when((F.col("pno") % 7 != 0) | F.col("run_id").endswith("1"), F.col("pno")), "given": F.lit(None).cast("int")})
    return LY.resolved_pages(p, ["run_id", "book_id"], "pos", "given", "reported")


@query("""WITH b AS (SELECT block_id, run_id, book_id, page_idx + CASE part_file WHEN 'part2' THEN 200 ELSE 0 END AS pno, x0, y0, x1, y1 FROM layout_block WHERE block_type = 'equation'),
h AS (SELECT g.line_key, min(b.block_id) AS block_id FROM geom_line g JOIN b USING (run_id, book_id, pno) WHERE (g.x0 + g.x1) / 2.0 BETWEEN b.x0 - 5 AND b.x1 + 5 AND (g.y0 + g.y1) / 2.0 BETWEEN b.y0 - 5 AND b.y1 + 5 GROUP BY 1)
SELECT block_id, string_agg(g.text, '' ORDER BY g.x0, g.y0, g.line_key) AS text, CAST(count(*) AS INTEGER) AS pieces FROM h JOIN geom_line g USING (line_key) GROUP BY 1""")
def h6_equation_texts(s: SparkSession, d: str) -> DataFrame:
    b = _blocks_all(s, d).where("block_type = 'equation'").select("block_id", *G.PAGE, *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))
    return LY.equation_texts(table(s, d, "geom_line"), b, G.PAGE, "line_key", "block_id")


@query("""WITH RECURSIVE g AS (SELECT run_id, book_id, pno, y0, x0, x1, y1, text, row_number() OVER (PARTITION BY run_id, book_id, pno ORDER BY round_even(y0 / 3, 0), x0, y0, x1, y1, text) AS k FROM geom_line WHERE x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL AND text IS NOT NULL),
m AS (SELECT run_id, book_id, pno, k, 1 AS line, y0, y1, x0, x1, text FROM g WHERE k = 1 UNION ALL
  SELECT g.run_id, g.book_id, g.pno, g.k, CASE WHEN j THEN line ELSE line + 1 END, CASE WHEN j THEN p0 ELSE g.y0 END, CASE WHEN j THEN greatest(p1, g.y1) ELSE g.y1 END, CASE WHEN j THEN q0 ELSE g.x0 END, CASE WHEN j THEN greatest(q1, g.x1) ELSE g.x1 END, g.text
  FROM (SELECT m.run_id, m.book_id, m.pno, m.line, m.k, m.y0 AS p0, m.y1 AS p1, m.x0 AS q0, m.x1 AS q1, h.k AS nk, abs(m.y0 - h.y0) <= 3 AND abs(m.y1 - h.y1) <= 3 AND h.x0 >= m.x0 - 1 AND h.x0 <= m.x1 + 30 AS j FROM m JOIN g h ON h.run_id IS NOT DISTINCT FROM m.run_id AND h.book_id IS NOT DISTINCT FROM m.book_id AND h.pno IS NOT DISTINCT FROM m.pno AND h.k = m.k + 1) s
  JOIN g ON g.run_id IS NOT DISTINCT FROM s.run_id AND g.book_id IS NOT DISTINCT FROM s.book_id AND g.pno IS NOT DISTINCT FROM s.pno AND g.k = s.nk),
t AS (SELECT run_id, book_id, pno, line, string_agg(text, '' ORDER BY k) AS t, count(*) AS n FROM m GROUP BY ALL)
SELECT run_id, book_id, pno, CAST(sum(n) AS INTEGER) AS fragments, CAST(count(*) AS INTEGER) AS lines, string_agg(t, chr(10) ORDER BY line) AS text FROM t GROUP BY ALL""")
def w3_merged_lines(s: SparkSession, d: str) -> DataFrame:
    """The lines of each page after fragments on one line are joined."""
    full = table(s, d, "geom_line").where("x0 is not null and y0 is not null and x1 is not null and y1 is not null and text is not null")
    g = full.groupBy(*G.PAGE).agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "x1", "y1", "text"))).alias("g"))
    return g.select(*G.PAGE, F.size("g").alias("fragments"), LY.merged_lines("g").alias("m")).select(*G.PAGE, "fragments", F.size("m").alias("lines"), F.array_join(F.transform("m", lambda x: x["text"]), "\n").alias("text"))


@query()
def w12_block_rows(s: SparkSession, d: str) -> DataFrame:
    """Each block's text dealt out to the rows printed in its band; no rows where it does not fit them."""
    text = table(s, d, "layout_block").where("block_type = 'text'").select("block_id", "text")
    g = table(s, d, "geom_line").select("line_key", *G.PAGE, G.center("y0", "y1").alias("y"), "text", "x0", "y0", "x1", "y1")
    rows = G.binned_join(g, _blocks(s, d), G.PAGE, F.col("y"), F.col("b0") - 15.0, F.col("b1") + 15.0).groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "line_key", "text", "x1", "y1"))).alias("r"))
    both = materialize(text.join(rows, "block_id"), "rows")
    return both.select("block_id", F.size("r").alias("rows"), A.dealt_out("text", "r").alias("p")).select("block_id", "rows", F.coalesce(F.size("p"), F.lit(0)).alias("pieces"))


@query()
def j15_not_exempt(s: SparkSession, d: str) -> DataFrame:
    """The lines of each page that are left once the text of its excluded lines is used up."""
    g = _routed(s, d)
    texts = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("line_order", "line_key", "text")))), lambda x: x["text"])
    out = F.col("mode").eqNullSafe("header_footer_excluded")
    per = g.groupBy(*G.PAGE).agg(texts(F.lit(True)).alias("all"), texts(out).alias("exempt"), texts(~out).alias("wanted"))
    return per.select(*G.PAGE, F.size("all").alias("lines"), A.kept_texts("all", "exempt", "wanted").alias("k")).select(*G.PAGE, "lines", F.size("k").alias("kept"))


@query()
def t21_weighted_split(s: SparkSession, d: str) -> DataFrame:
    """Block texts in three parts by the weights 1, 1, 2, cut at blanks only."""
    b = table(s, d, "layout_block").where("text is not null")
    p = b.select("block_id", A.split_by_weight("text", F.array(F.lit(1.0), F.lit(1.0), F.lit(2.0))).alias("p"))
    return p.select("block_id", F.size("p").alias("pieces"), F.array_join("p", "|").alias("text"))


def _refined(s: SparkSession, d: str) -> DataFrame:
    b = _blocks_all(s, d)
    caption = F.array_join(F.coalesce("table_caption", F.array().cast("array<string>")), "\n")
    b = b.select("block_id", *G.PAGE, "text", "x0", "y0", "x1", "y1", (F.col("block_type") == "table").alias("is_table"), TB.table_grid("table_body").alias("grid"), caption.alias("caption"))
    return RF.refined(b.where("is_table is not null"), table(s, d, "geom_line"), "block_id", "line_key")


@query()
def n9_refined_blocks(s: SparkSession, d: str) -> DataFrame:
    """Every block as the cells or rows printed for it, or whole."""
    return _refined(s, d)


@query()
def n8_table_cells(s: SparkSession, d: str) -> DataFrame:
    return _refined(s, d).where("how = 'cells'").groupBy("block_id").agg(F.count("*").alias("cells"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


@query("""SELECT page_id, k, 18.0::DOUBLE AS x, 96.0 + (k + 0.72::DOUBLE) * (1032.0::DOUBLE / n) AS y, greatest(1.0, least(8.0, 1032.0::DOUBLE / n * 0.55::DOUBLE)) AS size FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS k, count(*) OVER (PARTITION BY page_id) AS n
FROM (SELECT page_id, unnest(string_split(markdown, chr(10))) AS line, unnest(range(len(string_split(markdown, chr(10))))) AS k FROM page_markdown WHERE markdown IS NOT NULL) WHERE trim(line) <> '')""")
def n7_fallback_flow(s: SparkSession, d: str) -> DataFrame:
    """Where the lines of a text go on a page of 800 x 1200 of which nothing is known."""
    n = table(s, d, "page_markdown").where("markdown is not null").select("page_id", F.posexplode(F.filter(F.split("markdown", "\n"), lambda x: F.trim(x) != "")).alias("k", "line"))
    at = RF.flow_position(F.col("k"), F.count("*").over(Window.partitionBy("page_id")), 800.0, 1200.0)
    return n.select("page_id", F.col("k").cast("long").alias("k"), at.alias("p")).select("page_id", "k", "p.*")


# ---- streams


@query(_EVENTS + """ SELECT date_trunc('hour', received_at) AS hour, st AS status, count(*) AS rows, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM e GROUP BY 1, 2""".replace("date_trunc('hour', received_at)", "epoch_us(date_trunc('hour', received_at))"))
def r1_rows_per_hour(s: SparkSession, d: str) -> DataFrame:
    h = ST.per_hour(table(s, d, "usage_log"))
    return h.select(F.unix_micros("hour").alias("hour"), "status", "rows", "tokens")


@query(_latest("run_id") + " SELECT run_id, page_key, delivery_id, st AS status, total_tokens FROM l WHERE n = 1")
def r2_latest_after_batches(s: SparkSession, d: str) -> DataFrame:
    """The store of latest rows after three batches of the log, the last of which repeats the first."""
    log = table(s, d, "usage_log")
    batch = lambda k: log.where(F.col("batch_no") % 2 == k)
    store = materialize(ST.upsert_latest(batch(1), None), "store")
    store = materialize(ST.upsert_latest(batch(0), store), "store")
    return ST.upsert_latest(batch(1), store).select("run_id", "page_key", "delivery_id", "status", "total_tokens")
