"""Processing logs: latest row per page, summaries, progress, gaps, top lists. All one or two shuffles, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import first_count, strip_blanks


def events(log: DataFrame) -> DataFrame:
    """The log with a clean status and a page key: `pno_0based`, else `page_number` - 1, else one of its own per row."""
    page = F.coalesce(F.col("pno_0based").cast("string"), (F.col("page_number") - 1).cast("string"), F.concat(F.lit("row "), F.col("delivery_id")))
    return log.withColumns({"status": F.lower(strip_blanks(F.col("status"))), "page_key": page})


def latest_per_page(log: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each page of a group by `order` (ties: the last of its columns). Map-side combined, never collected."""
    kept = F.max_by(F.struct(*columns), F.struct(*order)).alias("r")
    return log.groupBy(*group, "page_key").agg(kept).select(*group, "page_key", *(F.col(f"r.{c}").alias(c) for c in columns))



def _disc(column: str, percent: int, where: str) -> Column:
    return F.expr(f"coalesce(percentile_disc({percent / 100}) within group (order by {column}) filter (where {where}), 0)").cast("long")


def _total(c: str, where: Column) -> Column:
    return F.coalesce(F.sum(F.when(where, first_count(F.col(c)))), F.lit(0)).cast("long")


def cost(prompt: Column, completion: Column, per_million_in: float | None, per_million_out: float | None) -> Column:
    """What tokens come to at rates a million; null unless both rates are given."""
    if per_million_in is None or per_million_out is None:
        return F.lit(None).cast("double")
    return (prompt * float(per_million_in) + completion * float(per_million_out)) / 1_000_000


def usage_summary(log: DataFrame, group: list[str], prices: tuple[float | None, float | None] | None = None) -> DataFrame:
    """Counts by status over the latest rows of pages, token sums and percentiles (zero durations included) of successes.

    prices: rates a million tokens in and out; with them there is a column `cost`.
    """
    rows = events(log)
    n = rows.groupBy(*group).agg(F.count("*").alias("records"))
    pages = latest_per_page(rows, group, ["received_at", "delivery_id"], ["status", "prompt_tokens", "completion_tokens", "total_tokens", "duration_ms"])
    pages = pages.withColumn("ms", F.coalesce("duration_ms", F.lit(0)))
    ok = F.col("status") == "success"
    out = pages.groupBy(*group).agg(
        F.count("*").alias("pages"),
        F.count_if(ok).alias("successful_pages"),
        F.count_if(F.col("status") == "failed").alias("failed_pages"),
        F.count_if(F.col("status") == "skipped").alias("skipped_pages"),
        _total("prompt_tokens", ok).alias("prompt_tokens"),
        _total("completion_tokens", ok).alias("completion_tokens"),
        _total("total_tokens", ok).alias("total_tokens"),
        _disc("ms", 50, "status = 'success'").alias("elapsed_p50_ms"),
        _disc("ms", 95, "status = 'success'").alias("elapsed_p95_ms"),
    )
    out = n.join(out, group)
    return out if prices is None else out.withColumn("cost", cost(F.col("prompt_tokens"), F.col("completion_tokens"), *prices))


def progress(log: DataFrame, group: list[str], planned: DataFrame | None = None, elapsed_ms: int | None = None) -> DataFrame:
    """As a poll sees it: durations without zeros, 429s over all rows, transient skips not counted, share and rate of pages.

    planned: group columns and `planned`; elapsed_ms since the start, from the caller, so that a run can be repeated.
    """
    rows = events(log)
    n = rows.groupBy(*group).agg(
        F.count("*").alias("records"),
        (F.sum(first_count(F.col("rate_429"))) + F.count_if((F.col("status") == "failed") & (F.col("http_status") == 429))).cast("long").alias("n429"),
    )
    pages = latest_per_page(rows, group, ["received_at", "delivery_id"], ["status", "transient", "total_tokens", "duration_ms"])
    out = pages.groupBy(*group).agg(
        F.count_if(F.col("status") == "success").alias("pages_ok"),
        _total("total_tokens", F.col("status") == "success").alias("tokens"),
        F.count_if((F.col("status") == "skipped") & ~F.coalesce("transient", F.lit(False))).alias("skipped"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        _disc("duration_ms", 50, "status = 'success' and duration_ms != 0").alias("p50_ms"),
        _disc("duration_ms", 95, "status = 'success' and duration_ms != 0").alias("p95_ms"),
    )
    out = n.join(out, group)
    if planned is None:
        return out
    out = out.join(planned, group, "left").withColumn("planned", F.coalesce("planned", F.lit(0)).cast("long"))
    out = out.withColumn("pct", F.when(F.col("planned") > 0, F.bround(F.col("pages_ok") / F.col("planned") * 100, 1)).otherwise(0.0))
    if elapsed_ms is not None:
        per_min = F.col("pages_ok") / (max(elapsed_ms, 1) / 60000.0)
        left = F.greatest(F.lit(0), F.col("planned") - F.col("pages_ok"))
        out = out.withColumn("pages_per_min", F.bround(per_min, 2)).withColumn("eta_ms", F.when((per_min > 0) & (left > 0), left / per_min * 60000).otherwise(0).cast("long"))
    return out


def missing_pages(totals: DataFrame, present: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, pno): pages 0 .. page_count - 1 that are not present. Null or zero counts have no pages."""
    wanted = totals.where("page_count > 0").select(book, F.explode(F.sequence(F.lit(0), F.col("page_count").cast("int") - 1)).alias("pno"))
    return wanted.join(present.select(book, "pno").distinct(), [book, "pno"], "left_anti")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts each map task's groups to k before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def retryable(log: DataFrame) -> Column:
    """Failures that may pass on a second try: no HTTP answer, too many requests, server errors."""
    code = F.col("http_status")
    return (F.col("status") == "failed") & (code.isNull() | (code == 429) | code.between(500, 599))


def payload_tier(size_of: Column, dpi: Column, limit: int = 1_500_000, tiers: tuple[int, ...] = (200, 150, 120)) -> Column:
    """The highest resolution not above `dpi` whose payload fits. size_of: map of dpi to base64 bytes. None fits: null."""
    fits = F.filter(F.array(*map(F.lit, tiers)), lambda t: (t <= dpi) & (size_of[t] <= limit))
    return F.try_element_at(fits, F.lit(1))


def adaptive_limits(outcomes: DataFrame, run: str, order: list[str], most: int) -> DataFrame:
    """(run, limits): the concurrency after each outcome of a run: halved by a 429 (1 at least), one more after 20 successes in a row.

    outcomes: run, order, http_status, status. A run's outcomes are folded in order inside one array; runs are bounded
    by the pages of a book.
    """
    rows = outcomes.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(*order, F.coalesce("http_status", F.lit(0)).alias("code"), F.col("status").alias("st")))).alias("x"))
    zero = F.struct(F.lit(most).alias("now"), F.lit(0).alias("good"), F.array().cast("array<int>").alias("all"))

    def step(acc, e):
        slow = e["code"] == 429
        good = F.when(slow | (e["st"] != "success"), 0).otherwise(acc["good"] + 1)
        grow = good >= 20
        now = F.when(slow, F.greatest(F.lit(1), F.floor(acc["now"] / 2).cast("int"))).when(grow, F.least(F.lit(most), acc["now"] + 1)).otherwise(acc["now"])
        return F.struct(now.alias("now"), F.when(grow, 0).otherwise(good).alias("good"), F.concat(acc["all"], F.array(now)).alias("all"))

    return rows.select(run, F.aggregate("x", zero, step, lambda a: a["all"]).alias("limits"))


def paged(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 200) -> DataFrame:
    """One page of a sorted list; a limit is brought into 1 .. `most`, a negative offset to 0."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))
