"""What a build is checked by: damage that rules a text layer out, usable pages, gates per page and their summary, bindings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import corruption, visible_length

# fixed values: what each kind of damage is reported as, in this order
EVIDENCE = {
    "sample_replacement": "U+FFFD replacement characters in first 100 characters",
    "replacement_count": "U+FFFD replacement characters in document",
    "han_in_transcription": "CJK glyphs inside transcription brackets",
    "question_mark_count": "literal question marks in extracted text",
    "control_count": "unexpected control characters",
}
NO_EVIDENCE = "no explicit corruption marker in inspected text"
COUNTS = ("replacement_count", "question_mark_count", "han_in_transcription", "control_count")
#: a page is aligned if so much of its text is
ALIGNED = 0.95


def damage(pages: DataFrame, group: list[str], page: str, text: str, sample: int = 100) -> DataFrame:
    """(group, pages, the four counts, bad_pages, first_bad, evidence, must_discard) of each document.

    A text with any mark of damage is to be discarded. first_bad: the ten first damaged pages; evidence: the kinds found, or
    that none was. Null texts have no damage.
    """
    n = {k: F.coalesce(c, F.lit(0)) for k, c in corruption(F.col(text)).items()}
    here = pages.select(*group, page, *(c.alias(k) for k, c in n.items()), F.coalesce(F.regexp_count(F.left(text, F.lit(sample)), F.lit("\\ufffd")), F.lit(0)).alias("sample_replacement"))
    here = here.withColumn("bad", sum(F.col(k) for k in COUNTS) > 0)
    per = here.groupBy(*group).agg(
        F.count("*").alias("pages"), *(F.sum(k).cast("long").alias(k) for k in (*COUNTS, "sample_replacement")), F.count_if("bad").alias("bad_pages"),
    )
    # ten pages at most are gathered for a document
    first = _first(here.where("bad"), group, page, 10).groupBy(*group).agg(F.array_sort(F.collect_list(page)).alias("first_bad"))
    found = F.array_compact(F.array(*(F.when(F.col(k) > 0, F.lit(t)) for k, t in EVIDENCE.items())))
    out = per.join(first, group, "left").withColumn("evidence", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_EVIDENCE))))
    return out.withColumn("first_bad", F.coalesce("first_bad", F.array().cast("array<bigint>"))).withColumn("must_discard", F.col("bad_pages") > 0)


def _first(df: DataFrame, group: list[str], order: str, k: int) -> DataFrame:
    from leafmill.operators.usage import top_per_group

    return top_per_group(df.select(*group, order), group, [F.asc(order)], k).drop("rank")


def usable_pages(lines: DataFrame, page: list[str]) -> DataFrame:
    """(page, usable, aligned, header_footer, fallback): whether a page has real geometry, and its lines by route.

    A null mode counts as aligned; lines of any other mode have no route.
    """
    mode = F.col("mode")
    aligned = mode.isNull() | (mode == "aligned")
    n = lines.groupBy(*page).agg(F.count_if(aligned).alias("aligned"), F.count_if(mode == "header_footer_excluded").alias("header_footer"), F.count_if(mode == "fallback_capacity").alias("fallback"))
    return n.withColumn("usable", F.col("aligned") + F.col("header_footer") > 0)


def text_coverage(pages: DataFrame, page_id: str, page: list[str], text: Column, lines: DataFrame, least: float = ALIGNED) -> DataFrame:
    """(page_id, page, total, aligned, covered, shares, page_aligned): a page's own text against its lines of any source.

    Lines without a mode count as aligned. A page without visible text is covered; one without lines is not.
    """
    n = visible_length(F.col("text"))
    per = lines.groupBy(*page).agg(F.sum(F.when(F.col("mode").isNull() | (F.col("mode") == "aligned"), n)).alias("aligned"), F.sum(n).alias("covered"), F.count("*").alias("lines"))
    both = pages.select(page_id, *page, visible_length(text).alias("total")).join(per, page, "left").fillna(0, ["total", "aligned", "covered", "lines"])
    share = lambda c: F.when(F.col("total") > 0, F.bround(F.col(c) / F.col("total"), 6)).otherwise(1.0)
    out = both.withColumns({"aligned_coverage": share("aligned"), "covered_coverage": share("covered")})
    exact = F.when(F.col("total") > 0, F.col("aligned") / F.col("total")).otherwise(1.0)
    return out.withColumn("page_aligned", exact >= least)


def census(pages: DataFrame, group: list[str]) -> DataFrame:
    """(group, pages, predicted_embedded, predicted_fallback, aligned_pages). pages: group, usable, page_aligned; null is false."""
    use, ok = (F.coalesce(c, F.lit(False)) for c in ("usable", "page_aligned"))
    return pages.groupBy(*group).agg(F.count("*").alias("pages"), F.count_if(use).alias("predicted_embedded"), F.count_if(~use).alias("predicted_fallback"), F.count_if(ok).alias("aligned_pages"))


def verify_summary(pages: DataFrame, group: list[str], page: str) -> DataFrame:
    """One row per group over its pages' gates, with the pages that fail each.

    pages: group, page, zero_loss, order_ok (null where all lines are exempt), geometric_checked, geometric_ratio, geometric_ok,
    aligned_coverage, covered_coverage, page_aligned, table_unreliable, cell_recall, cell_precision (null where no table was
    compared). Means of the geometric gate are over checked pages, of cells over compared ones; without any they are 1 and 0.
    """
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    failed = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col(page))))
    computed = F.col("cell_recall").isNotNull()
    return pages.groupBy(*group).agg(
        F.count("*").alias("pages_total"),
        yes("zero_loss").alias("zero_loss_pages"),
        F.count("order_ok").alias("reading_order_checked_pages"),
        yes("order_ok").alias("reading_order_ok_pages"),
        yes("geometric_ok").alias("geometric_ok_pages"),
        F.coalesce(F.avg(F.when(F.col("geometric_checked") > 0, F.col("geometric_ratio"))), F.lit(1.0)).alias("mean_geometric_pass_ratio"),
        yes("page_aligned").alias("aligned_pages"),
        F.avg(F.coalesce("page_aligned", F.lit(False)).cast("int")).alias("aligned_pages_ratio"),
        F.avg(F.coalesce("aligned_coverage", F.lit(0.0))).alias("mean_aligned_coverage"),
        F.avg(F.coalesce("covered_coverage", F.lit(0.0))).alias("mean_covered_coverage"),
        F.count_if(computed).alias("computed_pages"),
        F.coalesce(F.avg(F.when(computed, F.col("cell_recall"))), F.lit(0.0)).alias("mean_cell_recall"),
        F.coalesce(F.avg(F.when(computed, F.col("cell_precision"))), F.lit(0.0)).alias("mean_cell_precision"),
        failed(~F.coalesce("zero_loss", F.lit(False))).alias("zero_loss_fail_pages"),
        failed(~F.coalesce("order_ok", F.lit(True))).alias("reading_order_fail_pages"),
        failed(~F.coalesce("geometric_ok", F.lit(False))).alias("geometric_fail_pages"),
        failed(F.coalesce("table_unreliable", F.lit(False))).alias("table_unreliable_pages"),
    )


def by_page_number(wanted: DataFrame, texts: DataFrame, keys: list[str], page: str, value: str) -> DataFrame:
    """`wanted` with `value` of the text stored under the page's number, else under the number after it; null where neither is.

    texts: keys, page, value, one row per page.
    """
    t = texts.select(*keys, page, value)
    own = wanted.join(t.withColumnRenamed(value, "__own"), [*keys, page], "left")
    after = t.select(*keys, (F.col(page) - 1).alias(page), F.col(value).alias("__after"))
    return own.join(after, [*keys, page], "left").withColumn(value, F.coalesce("__own", "__after")).drop("__own", "__after")


def binding(records: DataFrame, facts: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, status, warnings): whether a chosen file is a record's own.

    Both: book, path, size, pages; records also last_page (the last page done, from 0). The same path binds, with a warning
    `changed` where size or pages differ; another path binds with the warning `moved` only if size and pages are equal. A record
    without a path is a `mismatch`, and so is everything else. Pages done beyond the record's count give `foreign_pages`.
    """
    a, b = records.alias("a"), facts.alias("b")
    state = lambda c: F.when(F.col(f"a.{c}").isNull() | F.col(f"b.{c}").isNull(), "unknown").when(F.col(f"a.{c}") == F.col(f"b.{c}"), "same").otherwise("diff")
    both = a.join(b, F.col(f"a.{book}") == F.col(f"b.{book}"))
    same_path = F.coalesce(F.col("a.path") == F.col("b.path"), F.lit(False))
    equal = (state("size") == "same") & (state("pages") == "same")
    differs = (state("size") == "diff") | (state("pages") == "diff")
    bound = F.col("a.path").isNotNull() & (same_path | equal)
    foreign = F.coalesce(F.col("a.last_page") + 1 > F.col("a.pages"), F.lit(False))
    warnings = F.array_compact(F.array(F.when(same_path & differs, "changed"), F.when(~same_path & equal, "moved"), F.when(foreign, "foreign_pages")))
    return both.select(F.col(f"a.{book}").alias(book), F.when(bound, "bound").otherwise("mismatch").alias("status"), F.when(bound, warnings).otherwise(F.array().cast("array<string>")).alias("warnings"))


def ordered_distinct(df: DataFrame, group: list[str], value: str, order: Sequence[str]) -> DataFrame:
    """(group, values): the distinct values of each group in the order they were first seen; nulls are none."""
    first = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.min(F.struct(*order)).alias("at"))
    return first.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))


def first_named(df: DataFrame, name: Column, order: Sequence[str]) -> DataFrame:
    """The first row, by `order`, of each name without regard to case; rows without a name are left out."""
    named = df.withColumn("__name", F.lower(name)).where("__name is not null")
    kept = named.groupBy("__name").agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r"))
    return kept.select("r.*")
