"""Printed lines found in gray page images, and text laid on them where no other geometry is known."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.operators.align import weighted_pieces

# fixed values: what is ink, and sizes of bands in pixels
INK = 176
LEAST_INK, BAND_GAP, BAND_HEIGHT, BAND_WIDTH, COLUMN_GAP = 2, 2, 4, 4, 12
TALLEST = 0.25
#: a band this many times as high as the page's usual one is no printed line
STRETCH = 2.5


def bands(counts: np.ndarray, least: int, gap: int, shortest: int, longest: int) -> list[tuple[int, int]]:
    """Runs of counts of `least` or more over gaps up to `gap`; the last one reaches the end if only a gap follows."""
    on = np.flatnonzero(np.asarray(counts) >= least)
    if not on.size:
        return []
    cut = np.flatnonzero(np.diff(on) > gap + 1)
    starts, ends = on[np.r_[0, cut + 1]], on[np.r_[cut, on.size - 1]]
    if len(counts) - 1 - ends[-1] <= gap:
        ends[-1] = len(counts) - 1
    return [(int(a), int(b)) for a, b in zip(starts, ends) if shortest <= b - a + 1 <= longest]


def line_boxes(gray: bytes, width: int, height: int, columns: bool = False) -> list[list[float]]:
    """Boxes from 0 to 1000 of the printed lines of an image of one byte a pixel; [] where the bytes do not fit the size."""
    if not gray or width <= 0 or height <= 0 or len(gray) != width * height:
        return []
    ink = np.frombuffer(gray, dtype=np.uint8).reshape(height, width) <= INK
    out = []
    for y0, y1 in bands(ink.sum(axis=1), LEAST_INK, BAND_GAP, BAND_HEIGHT, max(BAND_HEIGHT, int(height * TALLEST))):
        across = bands(ink[y0 : y1 + 1].sum(axis=0), LEAST_INK, COLUMN_GAP, BAND_WIDTH, width)
        if across and not columns:
            across = [(across[0][0], across[-1][1])]
        out += [[round(v, 2) for v in (x0 * 1000 / width, y0 * 1000 / height, (x1 + 1) * 1000 / width, (y1 + 1) * 1000 / height)] for x0, x1 in across]
    return out


_BOXES = T.ArrayType(T.ArrayType(T.DoubleType()))


@F.pandas_udf(_BOXES)
def ink_boxes(gray: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([line_boxes(g, int(w), int(h)) for g, w, h in zip(gray, width.fillna(0), height.fillna(0))], dtype=object)


def lay_on_bands(lines: list[str], boxes: list[list[float]]) -> list[dict]:
    """Lines on bands in proportion of their order: a line over several bands is cut by their room, else takes them as one.

    Bands much higher than the upper median are cut down around their centre. No bands: no lines.
    """
    boxes = [b for b in boxes if b[2] > b[0] and b[3] > b[1]]
    lines = [x.strip() for x in lines if x.strip()]
    if not boxes or not lines:
        return []
    highest = STRETCH * sorted(b[3] - b[1] for b in boxes)[len(boxes) // 2]
    low = [[x0, max(y0, (y0 + y1 - highest) / 2), x1, min(y1, (y0 + y1 + highest) / 2)] for x0, y0, x1, y1 in boxes]
    out = []
    for i, text in enumerate(lines):
        a = min(i * len(low) // len(lines), len(low) - 1)
        own = low[a : max(a + 1, (i + 1) * len(low) // len(lines))]
        pieces = weighted_pieces(text, [(b[2] - b[0]) / max(1.0, b[3] - b[1]) for b in own])
        if len(pieces) != len(own):
            pieces, own = [text], [[min(b[0] for b in own), min(b[1] for b in own), max(b[2] for b in own), max(b[3] for b in own)]]
        out += [{"text": p, "x0": b[0], "y0": b[1], "x1": b[2], "y1": b[3], "order": len(out) + k} for k, (p, b) in enumerate(zip(pieces, own))]
    return out


_LAID = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1")), T.StructField("order", T.IntegerType())]))


@F.pandas_udf(_LAID)
def laid_lines(text: pd.Series, boxes: pd.Series) -> pd.Series:
    return pd.Series([lay_on_bands((t or "").splitlines(), [] if b is None else [list(x) for x in b]) for t, b in zip(text, boxes)], dtype=object)


def rotated_box(x0: Column, y0: Column, x1: Column, y1: Column, turn: Column, width: Column, height: Column, crop_x: Column, crop_y: Column) -> Column:
    """A raw box in the page as it is shown: moved by the crop's corner, then turned clockwise by 0, 90, 180 or 270 degrees.

    width, height: of the crop before turning. Any other angle, or a null side, gives null.
    """
    a0, b0, a1, b1 = x0 - crop_x, y0 - crop_y, x1 - crop_x, y1 - crop_y
    box = lambda *v: F.struct(F.least(v[0], v[2]).alias("x0"), F.least(v[1], v[3]).alias("y0"), F.greatest(v[0], v[2]).alias("x1"), F.greatest(v[1], v[3]).alias("y1"))
    full = a0.isNotNull() & b0.isNotNull() & a1.isNotNull() & b1.isNotNull()
    shown = (
        F.when(turn == 0, box(a0, b0, a1, b1))
        .when(turn == 90, box(height - b0, a0, height - b1, a1))
        .when(turn == 180, box(width - a0, height - b0, width - a1, height - b1))
        .when(turn == 270, box(b0, width - a0, b1, width - a1))
    )
    return F.when(full, shown)
