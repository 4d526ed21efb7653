"""Tables inside documents: HTML grids with spans, Markdown cells, LaTeX cells, text of layout blocks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROW = re.compile(r"<tr[^>]*>(.*?)(?:</tr>|(?=<tr[\s>])|\Z)", re.S | re.I)
_CELL = re.compile(r"<t[dh]\b([^>]*)>(.*?)(?:</t[dh]>|(?=<t[dh][\s>])|\Z)", re.S | re.I)
_SPANS = {k: re.compile(rf"{k}span\s*=\s*[\"']?\s*(\d+)", re.I) for k in ("col", "row")}
# fixed values: the HTML standard's bounds of colspan and rowspan
_BOUNDS = {"col": 1000, "row": 65534}

# fixed values: what the LaTeX of table cells becomes, in order
LATEX_REWRITES = [
    (r"\$", ""), (r"\\multirow\{[^}]*\}\{[^}]*\}\{([^}]*)\}", r"\1"), (r"\\multicolumn\{[^}]*\}\{[^}]*\}\{([^}]*)\}", r"\1"), (r"\^\{\\prime\}", "'"), (r"\\prime", "'"),
    (r"\^\\mathrm\{([^}]*)\}", r"\1"), (r"\^\{([^}]*)\}", r"\1"), (r"_\{([^}]*)\}", r"\1"), (r"\^(\S)", r"\1"), (r"_(\S)", r"\1"),
    (r"\\mathrm\{([^}]*)\}", r"\1"), (r"\\text\{([^}]*)\}", r"\1"), (r"\\([a-zA-Z]+)", ""), (r"[{}\\]", ""),
]


def latex_cell(c: Column) -> Column:
    """The visible text of a cell's LaTeX, all by built-ins."""
    c = F.trim(c)
    for pattern, to in LATEX_REWRITES:
        c = F.regexp_replace(c, pattern, to.replace("\\1", "$1"))
    return F.trim(c)


def latex_cell_text(cell: str) -> str:
    cell = cell.strip()
    for pattern, to in LATEX_REWRITES:
        cell = re.sub(pattern, to, cell)
    return cell.strip()


def grid(source: str | None) -> list[list[str]]:
    """Rows of equal width. A cell spanning columns is repeated, one spanning rows goes on below; short rows are padded.

    Rows and cells may lack their end tags. Spans are taken in full, up to the bounds of the HTML standard. No row: an empty grid.
    """
    below: dict[int, tuple[str, int]] = {}
    rows = []
    for r in _ROW.finditer(source or ""):
        row: list[str] = []

        def carried() -> bool:
            if len(row) not in below:
                return False
            text, left = below.pop(len(row))
            if left > 1:
                below[len(row)] = (text, left - 1)
            row.append(text)
            return True

        for attrs, inner in _CELL.findall(r[1]):
            while carried():
                pass
            text = latex_cell_text(re.sub(r"<[^>]+>", "", inner))
            across, down = (min(_BOUNDS[k], int(m[1])) if (m := _SPANS[k].search(attrs)) else 1 for k in ("col", "row"))
            for _ in range(across):
                if down > 1:
                    below[len(row)] = (text, down - 1)
                row.append(text)
        while carried():
            pass
        rows.append(row)
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def table_grid(s: pd.Series) -> pd.Series:
    return s.map(grid)


def grid_text(g: Column) -> Column:
    """A grid as lines; a cell equal to its left neighbour (a repeated span) is left out."""
    row = lambda r: F.array_join(F.filter(r, lambda t, i: ~((i > 0) & (t != "") & (t == F.try_element_at(r, i)))), " ")
    return F.array_join(F.transform(g, row), "\n")


def grid_cells(g: Column) -> Column:
    return F.filter(F.flatten(g), lambda t: t != "")


def has_spans(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)rowspan|colspan|<th"), F.lit(False))


def markdown_cells(c: Column) -> Column:
    """The non-empty cells of Markdown table rows, blanks dropped; separator rows are none."""
    from leafmill.functions.text import compact

    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x.contains("|") & ~x.rlike(r"^[\s:\-|]*$"))
    return F.filter(F.transform(F.flatten(F.transform(lines, lambda x: F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"))), compact), lambda x: x != "")


def block_text(kind: str, text: str, captions: str, images: str, body: Column) -> Column:
    """The text of a layout block by its type: its text, its captions, or captions and table."""
    join = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), "\n")
    return (
        F.when(F.col(kind).isin("text", "header", "footer", "page_number", "page_footnote", "ref_text", "equation", "title"), F.coalesce(text, F.lit("")))
        .when(F.col(kind).isin("image", "chart"), join(images))
        .when(F.col(kind) == "table", F.concat_ws("\n", F.nullif(join(captions), F.lit("")), F.coalesce(grid_text(table_grid(body)), F.lit(""))))
        .otherwise("")
    )
