"""Boxes, reading order, ordered scans and spatial matching on pages with coordinates from 0 to 1000."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import anchor_form, is_page_like, visible_length

PAGE = ["run_id", "book_id", "pno"]


def center(a: str, b: str) -> Column:
    return (F.col(a) + F.col(b)) / 2.0


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1000.0), c))


def normal_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """A box in points as a struct from 0 to 1000; null where it or its page is degenerate or a side is null."""
    sides = [clamp(v * 1000.0 / F.nullif(n, F.lit(0.0))) for v, n in ((x0, width), (y0, height), (x1, width), (y1, height))]
    box = F.struct(*(s.alias(n) for s, n in zip(sides, ("x0", "y0", "x1", "y1"))))
    return F.when((width > 0) & (height > 0) & (sides[2] > sides[0]) & (sides[3] > sides[1]), box)


def valid_box(text: str = "text") -> Column:
    sides = F.least("x0", "y0", "x1", "y1") >= 0
    full = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    return F.coalesce(full & sides & (F.greatest("x0", "y0", "x1", "y1") <= 1000) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (F.length(F.trim(text)) > 0), F.lit(False))


def fallback_box(index: Column, total: Column) -> Column:
    """The box of line `index` of `total` when nothing is known: full width, spread from 50 to 950."""
    step = F.lit(900.0) / F.greatest(total, F.lit(1))
    y0 = F.when(total <= 1, 480.0).otherwise(50.0 + index * step)
    y1 = F.when(total <= 1, 520.0).otherwise(F.least(F.lit(1000.0), 50.0 + index * step + F.greatest(F.lit(20.0), step * 0.8)))
    return F.struct(F.lit(20.0).alias("x0"), y0.alias("y0"), F.lit(980.0).alias("x1"), y1.alias("y1"))


def rotated_label(text: str = "text") -> Column:
    """A short ASCII text in a narrow, tall box."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return F.coalesce(F.col(text).rlike(r"^[\x20-\x7e]{6,60}$") & (w < 40) & (h > 2 * w), F.lit(False))


def is_equation(text: str = "text") -> Column:
    t = F.trim(text)
    return F.coalesce(t.startswith("$$") & t.endswith("$$") & (F.length(t) >= 4), F.lit(False))


def reading_order(lines: DataFrame, row_id: str, page: list[str] = PAGE, by_column: bool = False) -> DataFrame:
    """`lines` with `reading_order` 0, 1, ... per page: by vertical centre, then left edge (ties: row id); optionally by column first."""
    keys = [F.col("column_no")] if by_column else []
    w = Window.partitionBy(*page).orderBy(*keys, center("y0", "y1"), center("x0", "x1") if by_column else F.col("x0"), row_id)
    return lines.withColumn("reading_order", (F.row_number().over(w) - 1).cast("long"))


def visual_order(lines: DataFrame, row_id: str, page: list[str] = PAGE, row_height: float = 12.0) -> DataFrame:
    """Order by visual row (centres rounded half to even to rows), then left edge, centres."""
    y, x = center("y0", "y1"), center("x0", "x1")
    w = Window.partitionBy(*page).orderBy(F.bround(y / row_height), F.bround("x0"), y, x, row_id)
    return lines.withColumn("visual_order", (F.row_number().over(w) - 1).cast("long"))


def split_columns(lines: DataFrame, page: list[str] = PAGE, gap: float = 120.0) -> DataFrame:
    """`split_column` 0 or 1: two columns, parted in the middle of the centres, where those spread over `gap` or more."""
    x, w = center("x0", "x1"), Window.partitionBy(*page)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return lines.withColumn("split_column", F.when((high - low >= gap) & (x > (low + high) / 2.0), 1).otherwise(0).cast("long"))


def repeated_lines(lines: DataFrame, text: str, page: list[str], group: list[str], least: int = 2, longest: int = 80, composed: bool = False) -> DataFrame:
    """(group, anchor, pages): texts on `least` pages of a group or more, counted once a page. Counts are combined map-side.

    composed: the texts are in composed form already.
    """
    a = lines.select(*dict.fromkeys([*group, *page]), anchor_form(F.col(text), composed).alias("anchor")).where(F.length("anchor").between(1, longest))
    return a.distinct().groupBy(*group, "anchor").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)


def header_footer(lines: DataFrame, anchors: DataFrame, text: str = "text", band: float = 120.0) -> DataFrame:
    """`in_margin`: in the top or bottom band and either like a page number or an anchor of its book."""
    marked = lines.withColumn("anchor", anchor_form(F.col(text))).join(anchors.select("book_id", "anchor").withColumn("known", F.lit(True)), ["book_id", "anchor"], "left")
    edge = (center("y0", "y1") <= band) | (center("y0", "y1") >= 1000 - band)
    return marked.withColumn("in_margin", F.coalesce(edge & (is_page_like(F.col(text)) | F.coalesce("known", F.lit(False))), F.lit(False))).drop("anchor", "known")


def coverage(lines: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """Aligned and covered visible characters of a page; only mode `aligned` counts as aligned, a page without any has 1."""
    n = visible_length(F.col("text"))
    zero = F.lit(0).cast("long")
    out = lines.groupBy(*page).agg(
        F.coalesce(F.sum(F.when(F.col("mode") == "aligned", n)), zero).alias("aligned_chars"),
        F.coalesce(F.sum(n), zero).alias("covered_chars"),
        *(F.count_if(F.col("mode") == m).alias(m) for m in ("aligned", "fallback_capacity", "header_footer_excluded")),
    )
    return out.withColumn("aligned_coverage", F.when(F.col("covered_chars") > 0, F.bround(F.col("aligned_chars") / F.col("covered_chars"), 6)).otherwise(1.0))


def upper_median(values: Column) -> Column:
    """The value at index n / 2 of the sorted array (not the mean of the middle two); null for none."""
    return F.try_element_at(F.array_sort(values), (F.size(values) / 2).cast("int") + 1)


def binned_join(points: DataFrame, boxes: DataFrame, page: list[str], y: Column, low: Column, high: Column, bin_height: float = 50.0) -> DataFrame:
    """Pairs of a point and a box of the same page with low <= y <= high: an equi-join on page and height bins, no cross join."""
    p = points.withColumn("__bin", F.floor(y / bin_height).cast("int"))
    b = boxes.withColumn("__bin", F.explode(F.sequence(F.floor(low / bin_height).cast("int"), F.floor(high / bin_height).cast("int"))))
    return p.join(b, [*page, "__bin"]).where((y >= low) & (y <= high)).drop("__bin")


def proportional_boxes(texts: DataFrame, boxes: DataFrame, page: list[str]) -> DataFrame:
    """Text i of n gets the boxes from floor(i B / n) to floor((i + 1) B / n), one at least.

    texts: page, i, n. boxes: page, b (from 0), total.
    """
    both = texts.join(boxes.select(*page, "total").distinct(), page)
    start = F.floor(F.col("i") * F.col("total") / F.col("n")).cast("int")
    stop = F.floor((F.col("i") + 1) * F.col("total") / F.col("n")).cast("int")
    spread = both.withColumn("b", F.explode(F.sequence(F.least(start, F.col("total") - 1).cast("int"), F.least(F.greatest(start + 1, stop), F.col("total")).cast("int") - 1)))
    return spread.drop("total").join(boxes, [*page, "b"])


def ink_bands(profiles: DataFrame, key: list[str], counts: str, least: int, gap: int, shortest: int, longest: int) -> DataFrame:
    """(key, start, end): runs of counts of `least` or more, across gaps up to `gap`, of allowed length.

    Islands by lag over the positions above the threshold; a band still open at the end of the profile reaches its end.
    """
    at = profiles.select(*key, F.size(counts).alias("n"), F.posexplode(counts).alias("pos", "v")).where(F.col("v") >= least)
    w = Window.partitionBy(*key).orderBy("pos")
    new = F.when(F.coalesce(F.col("pos") - F.lag("pos").over(w) > gap + 1, F.lit(True)), 1).otherwise(0)
    runs = at.withColumn("new", new).withColumn("band", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*key, "band", "n").agg(F.min("pos").alias("start"), F.max("pos").alias("last"))
    out = out.withColumn("end", F.when(F.col("n") - 1 - F.col("last") <= gap, F.col("n") - 1).otherwise(F.col("last")))
    return out.where((F.col("end") - F.col("start") + 1).between(shortest, longest)).select(*key, "start", "end")


def page_label_rules(pages: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, startpage, style, firstpagenum): label rules of printed numbers.

    pages: book, pno from 0, style and number (null where none was seen). A rule starts where (style, number - pno) differs
    from the detection before; undetected pages go on, undetected first pages count from 1 in decimal.
    """
    first = pages.groupBy(book).agg(F.min_by(F.struct("style", "number"), "pno").alias("f")).where("f.number is null").select(book, F.lit(0).alias("pno"), F.lit("D").alias("style"), F.lit(1).alias("number"))
    seen = pages.where("number is not null").select(book, F.col("pno").cast("int").alias("pno"), "style", F.col("number").cast("int").alias("number")).unionByName(first)
    w = Window.partitionBy(book).orderBy("pno")
    here = F.struct("style", (F.col("number") - F.col("pno")).alias("d"))
    marked = seen.withColumn("here", here).withColumn("before", F.lag("here").over(w))
    return marked.where(~F.col("here").eqNullSafe(F.col("before"))).select(book, F.col("pno").alias("startpage"), "style", F.col("number").alias("firstpagenum"))


def fold_rows(items: Column, limit: float) -> Column:
    """Array of row numbers of items sorted by `y`: a new row starts `limit` or more away from the first item of its row."""
    zero = F.struct(F.lit(None).cast("double").alias("y"), F.lit(-1).alias("row"), F.array().cast("array<int>").alias("all"))

    def step(acc, e):
        new = acc["y"].isNull() | (F.abs(e["y"] - acc["y"]) >= limit)
        row = F.when(new, acc["row"] + 1).otherwise(acc["row"])
        return F.struct(F.when(new, e["y"]).otherwise(acc["y"]).alias("y"), row.alias("row"), F.concat(acc["all"], F.array(row)).alias("all"))

    return F.aggregate(items, zero, step, lambda a: a["all"])


def plain_fallback_box(index: Column, total: Column) -> Column:
    """The box of line `index` of `total` in a plan without any geometry: full width, 20 high, spread from 50 to 950."""
    y0 = 50.0 + index * (F.lit(900.0) / F.greatest(total, F.lit(1)))
    return F.struct(F.lit(20.0).alias("x0"), y0.alias("y0"), F.lit(980.0).alias("x1"), F.least(F.lit(1000.0), y0 + 20.0).alias("y1"))


def fragment_id(order: Column, cell_row: Column, cell_col: Column) -> Column:
    """The id of a fragment: `#t<row>c<col>` of a cell, `L` and four digits of a line."""
    cell = F.concat(F.lit("#t"), cell_row.cast("int").cast("string"), F.lit("c"), F.coalesce(cell_col.cast("int"), F.lit(0)).cast("string"))
    return F.when(cell_row.isNotNull(), cell).otherwise(F.format_string("L%04d", order))


def contained(points: DataFrame, regions: DataFrame, page: list[str], point_id: str, region_id: str, kind: str, margins: dict[str, float], first_only: tuple[str, ...] = ()) -> DataFrame:
    """(point_id, region_id, kind): points (x, y) inside regions (bx0, by0, bx1, by1) of their page, widened by their kind's margin.

    Of the kinds in `first_only` a point is in one region, that with the smallest id. An equi-join on page and height bins.
    """
    m = F.create_map(*(F.lit(x) for kv in margins.items() for x in kv))[F.col(kind)]
    wide = regions.withColumn("__m", m)
    hit = binned_join(points, wide, page, F.col("y"), F.col("by0") - F.col("__m"), F.col("by1") + F.col("__m")).where((F.col("x") >= F.col("bx0") - F.col("__m")) & (F.col("x") <= F.col("bx1") + F.col("__m")))
    every = hit.where(~F.col(kind).isin(*first_only)).select(point_id, region_id, kind) if first_only else hit.select(point_id, region_id, kind)
    if not first_only:
        return every
    one = hit.where(F.col(kind).isin(*first_only)).groupBy(point_id, kind).agg(F.min(region_id).alias(region_id)).select(point_id, region_id, kind)
    return every.union(one)
