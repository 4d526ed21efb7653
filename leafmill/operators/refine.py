"""Layout blocks refined by what is printed on their page: tables to cells, texts to rows, the rest whole.

The rows of a block's band and the columns they vote for are found by joins and windows (`binned_join`, `table_columns`); only
the last step, which lays one table's grid on its rows, runs per table in an Arrow UDF, over the fragments of one page.
"""

from __future__ import annotations

from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.operators.align import dealt_out
from leafmill.operators.geometry import PAGE, binned_join, center, is_equation, rotated_label
from leafmill.operators.layout import rows_by_mean, table_columns
from leafmill.runtime import materialize

#: how far above and below a block its rows may be centred
REACH = 15.0
#: a fragment so many times as high as its row's usual one is none of the row; a cell's print may be so many times as wide as its column
TALL, BROAD = 1.5, 1.2
#: most ideographs of a heading that spans the rows below it
HEADING = 8


def _upper(values: list[float]) -> float:
    return sorted(values)[len(values) // 2]


def _is_heading(row: list[dict], first_end: float) -> bool:
    """A short text without ASCII, alone in its row and inside the first column: it names the rows below it."""
    text = "".join((row[0]["text"] or "").split())
    return len(row) == 1 and row[0]["x1"] <= first_end and 0 < len(text) <= HEADING and not any(ch.isascii() for ch in text)


def _filled_up(columns: list[tuple[float, float]], n: int) -> list[tuple[float, float]]:
    """The widest column is halved until there are n: an edge that too few rows voted for lies in it."""
    cols = list(columns)
    while len(cols) < n:
        k = max(range(len(cols)), key=lambda i: cols[i][1] - cols[i][0])
        a, z = cols[k]
        cols[k : k + 1] = [(a, (a + z) / 2.0), ((a + z) / 2.0, z)]
    return cols


def cells_on_rows(grid: list[list[str]], printed: list[dict], columns: list[tuple[float, float]], y0: float, y1: float, caption: str = "") -> list[dict] | None:
    """The cells of a grid, each with its place; None wherever grid and print do not have the same build.

    printed: the fragments of the page. Rows are clusters of fragments in the table's band; headings that span rows, and a row
    that ends above the next if there is one too many (the caption), are none. A row is as high as its usual fragments. A
    cell is as wide as the print in its column, or as the column where that is too broad or missing. Equal neighbours are one
    cell over their columns. A caption stands where the last line above the first row does, else on the first row.
    """
    inside = [f for f in printed if y0 - REACH <= (f["y0"] + f["y1"]) / 2.0 <= y1 + REACH]
    if not any(c.strip() for r in grid for c in r) or not inside or not columns:
        return None
    every = rows_by_mean(inside)
    rows = [r for r in every if not _is_heading(r, columns[0][1])]
    if len(rows) > max(1, len(grid)) and rows[0] is every[0] and max(f["y1"] for f in rows[0]) <= min(f["y0"] for f in rows[1]):
        rows = rows[1:]
    n = max(map(len, grid))
    cols = _filled_up(columns, n)
    if len(rows) != len(grid) or len(cols) != n or any(len(r) != n for r in grid):
        return None
    out = []
    if caption.strip():
        top = min(f["y0"] for f in rows[0])
        above = [f for f in printed if (f["y0"] + f["y1"]) / 2.0 < top]
        at = [max(above, key=lambda f: f["y0"] + f["y1"])] if above else every[0]
        out.append({"cell": "caption", "text": caption.strip(), "x0": min(f["x0"] for f in at), "y0": min(f["y0"] for f in at), "x1": max(f["x1"] for f in at), "y1": max(f["y1"] for f in at)})
    for r, (cells, row) in enumerate(zip(grid, rows)):
        usual = _upper([f["y1"] - f["y0"] for f in row])
        low = [f for f in row if f["y1"] - f["y0"] <= TALL * usual] or row
        mid, high = _upper([(f["y0"] + f["y1"]) / 2.0 for f in low]), _upper([f["y1"] - f["y0"] for f in low])
        a, z = (mid - high / 2.0, mid + high / 2.0) if high > 0 else (min(f["y0"] for f in low), max(f["y1"] for f in low))
        full = [(c, text.strip()) for c, text in enumerate(cells) if text.strip()]
        # an empty cell between two equal ones does not part them
        for text, group in groupby(full, key=lambda x: x[1]):
            own = [c for c, _ in group]
            left, right = min(cols[c][0] for c in own), max(cols[c][1] for c in own)
            room = max(1.0, right - left)
            print_ = [f for f in low if f["x0"] < right and f["x1"] > left]
            x0, x1 = left, right
            if print_:
                p0, p1 = min(f["x0"] for f in print_), max(f["x1"] for f in print_)
                if p0 < p1 <= p0 + BROAD * room:
                    x0, x1 = max(p0, left - room), min(p1, right + room)
            out.append({"cell": f"t{r}c{own[0]}", "text": text, "x0": x0, "y0": a, "x1": x1, "y1": z})
    return out or None


_CELLS = T.ArrayType(T.StructType([T.StructField("cell", T.StringType()), T.StructField("text", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1"))]))


@F.pandas_udf(_CELLS)
def _laid(grid: pd.Series, printed: pd.Series, columns: pd.Series, y0: pd.Series, y1: pd.Series, caption: pd.Series) -> pd.Series:
    rows = zip(grid, printed, columns, y0, y1, caption)
    return pd.Series([cells_on_rows([list(r) for r in g], [{**f} for f in p], [tuple(c) for c in cs], a, z, t) if g is not None and p is not None and cs is not None and len(g) else None for g, p, cs, a, z, t in rows], dtype=object)


def _fragments(lines: DataFrame, row_id: str) -> DataFrame:
    full = lines.where("x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    return full.select(*PAGE, F.col(row_id).alias("__row"), F.coalesce("text", F.lit("")).alias("text"), "x0", "y0", "x1", "y1", center("y0", "y1").alias("y"))


def table_cells(blocks: DataFrame, lines: DataFrame, block_id: str, row_id: str) -> DataFrame:
    """(block_id, cells): each table block's cells on its page's print; null where they do not fit, the block then stays whole.

    blocks: block_id, PAGE, y0, y1, grid (array of rows), caption.
    """
    frags = _fragments(lines, row_id)
    tables = blocks.select(block_id, *PAGE, F.col("y0").cast("double").alias("b0"), F.col("y1").cast("double").alias("b1"), "grid", "caption")
    band = binned_join(frags, tables.where("b1 >= b0").select(block_id, *PAGE, "b0", "b1"), PAGE, F.col("y"), F.col("b0") - REACH, F.col("b1") + REACH)
    columns = table_columns(band, [block_id], "__row")
    pages = frags.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "__row", "x1", "y1", "text"))).alias("printed"))
    both = materialize(tables.join(pages, PAGE, "left").join(columns, block_id, "left"), "tables")
    return both.select(block_id, _laid("grid", "printed", "columns", "b0", "b1", F.coalesce("caption", F.lit(""))).alias("cells"))


def refined(blocks: DataFrame, lines: DataFrame, block_id: str, row_id: str) -> DataFrame:
    """(block_id, how, n, fragment, text, x0, y0, x1, y1): every block once or more.

    how: `cells` of a table, `rows` of a text that fits the rows of its band, else `whole`: equations, rotated labels, empty texts,
    boxes upside down, and all that do not fit. fragment: `#caption`, `#t<row>c<col>`, `#r<row>`, or '' for a whole block.
    blocks: block_id, PAGE, text, x0, y0, x1, y1, is_table, grid, caption.
    """
    box = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    b = materialize(blocks.select(block_id, *PAGE, "text", *box, "is_table", "grid", "caption"), "blocks")
    cells = table_cells(b.where("is_table"), lines, block_id, row_id).select(block_id, F.posexplode("cells").alias("n", "c"))
    cells = cells.select(block_id, F.lit("cells").alias("how"), "n", F.concat(F.lit("#"), "c.cell").alias("fragment"), "c.text", "c.x0", "c.y0", "c.x1", "c.y1")
    movable = b.where(~F.col("is_table") & (F.length(F.trim("text")) > 0) & ~is_equation("text") & ~rotated_label() & (F.col("y1") >= F.col("y0")))
    frags = _fragments(lines, row_id)
    band = binned_join(frags, movable.select(block_id, *PAGE, F.col("y0").alias("b0"), F.col("y1").alias("b1")), PAGE, F.col("y"), F.col("b0") - REACH, F.col("b1") + REACH)
    rows = band.groupBy(block_id).agg(F.array_sort(F.collect_list(F.struct("y", "x0", "__row", "text", "y0", "x1", "y1"))).alias("rows"))
    both = materialize(movable.select(block_id, "text").join(rows, block_id), "bands")
    dealt = both.select(block_id, F.posexplode(dealt_out("text", "rows")).alias("n", "c"))
    dealt = dealt.select(block_id, F.lit("rows").alias("how"), "n", F.concat(F.lit("#r"), F.col("n").cast("string")).alias("fragment"), "c.text", "c.x0", "c.y0", "c.x1", "c.y1")
    parts = materialize(cells.union(dealt), "fragments")
    whole = b.join(parts.select(block_id).distinct(), block_id, "left_anti")
    return parts.union(whole.select(block_id, F.lit("whole"), F.lit(0), F.lit(""), "text", "x0", "y0", "x1", "y1"))


def flow_position(index: Column, total: Column, width: float, height: float, size: float = 8.0) -> Column:
    """struct(x, y, size) of line `index` of `total` that nothing is known of: spread from 8 % to 94 % of the page, no higher than its share."""
    top = min(height * 0.08, height - 2.0)
    share = F.lit(max(top + 2.0, height * 0.94) - top) / F.greatest(F.lit(1), total)
    y = top + (index + 0.72) * share
    return F.struct(F.lit(min(18.0, width * 0.04)).alias("x"), y.alias("y"), F.greatest(F.lit(1.0), F.least(F.lit(size), share * 0.55)).alias("size"))
