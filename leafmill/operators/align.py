"""Matching the lines of a page with its text, and the gates that compare what was meant with what is there.

Greedy matches use up their partners, so they run per page inside an Arrow UDF; a page's lines are bounded by the page.
The similarity is the ratio of the longest matching blocks (difflib), argument order as given.
"""

from __future__ import annotations

import difflib
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.pages import plain_markdown
from leafmill.functions.text import canonical
from leafmill.operators.geometry import PAGE

SIMILAR = 0.85


def ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def at_least(a: str, b: str, bound: float, counts: tuple[Counter, Counter] | None = None) -> float:
    """ratio(a, b) where it reaches the bound, else some value below it: what lengths and shared characters allow is tried first."""
    n = len(a) + len(b)
    if not n or a == b:
        return 1.0
    below = bound - 1e-9
    if 2.0 * min(len(a), len(b)) / n < bound:
        return below
    x, y = counts or (Counter(a), Counter(b))
    if 2.0 * sum(min(k, y[ch]) for ch, k in x.items() if ch in y) / n < bound:
        return below
    return ratio(a, b)


def bare(text: str) -> str:
    return "".join(unicodedata.normalize("NFC", text).split())


def _spread(i: int, n: int) -> tuple[float, float]:
    if n <= 1:
        return 480.0, 520.0
    step = 900.0 / n
    return 50.0 + i * step, min(1000.0, 50.0 + i * step + max(20.0, step * 0.8))


def align(markdown: str, lines: list[dict]) -> list[dict]:
    """Every line of the text once: on the geometry line it fits best, or spread over the page.

    Each geometry line, in order, takes the unused text line most like it (the first of equals) if that is SIMILAR or more.
    """
    texts = [x.strip() for x in plain_markdown(markdown).splitlines() if x.strip()]
    free, chars = dict(enumerate(texts)), [Counter(t) for t in texts]
    out = []
    for g in lines:
        own = (g["text"] or "").strip()
        if not own or not free:
            continue
        best = next((i for i, t in free.items() if t == own), -1)  # nothing is more like a text than itself
        score, mine = float(best >= 0), Counter(own)
        for i, t in free.items() if best < 0 else ():
            r = at_least(own, t, max(score, SIMILAR), (mine, chars[i]))
            if r > score and r >= SIMILAR:
                score, best = r, i
        if best >= 0 and score >= SIMILAR:
            margin = bool(g["header_footer"])
            out.append({"text": free.pop(best), "x0": g["x0"], "y0": g["y0"], "x1": g["x1"], "y1": g["y1"], "mode": "header_footer_excluded" if margin else "aligned", "similarity": score, "order_exempt": margin})
    done = len(out)
    for k, t in enumerate(free.values()):
        y0, y1 = _spread(k + done, len(free) + max(1, done))
        out.append({"text": t, "x0": 20.0, "y0": y0, "x1": 980.0, "y1": y1, "mode": "fallback_capacity", "similarity": None, "order_exempt": True})
    out.sort(key=lambda x: ((x["y0"] + x["y1"]) / 2.0, x["x0"]))
    return [x | {"order": i} for i, x in enumerate(out)]


_F = T.DoubleType()
ALIGNED = T.ArrayType(
    T.StructType(
        [T.StructField("order", T.IntegerType()), T.StructField("text", T.StringType()), *(T.StructField(n, _F) for n in ("x0", "y0", "x1", "y1")), T.StructField("mode", T.StringType()), T.StructField("similarity", _F), T.StructField("order_exempt", T.BooleanType())]
    )
)


@F.pandas_udf(ALIGNED)
def _align(markdown: pd.Series, lines: pd.Series) -> pd.Series:
    return pd.Series([align(m or "", [] if g is None else list(g)) for m, g in zip(markdown, lines)], dtype=object)


def align_pages(pages: DataFrame, page_id: str, markdown: str, lines: DataFrame, row_id: str) -> DataFrame:
    """(page_id, page, lines): each page's text on its lines. Pages without lines get spread lines only; null texts none."""
    few = lines.select(*PAGE, F.struct("line_order", row_id, "text", "x0", "y0", "x1", "y1", F.coalesce("header_footer", F.lit(False)).alias("header_footer")).alias("g"))
    per_page = few.groupBy(*PAGE).agg(F.array_sort(F.collect_list("g")).alias("g"))
    both = pages.select(page_id, *PAGE, markdown).join(per_page, PAGE, "left")
    return both.select(page_id, *PAGE, _align(markdown, "g").alias("lines"))


def alignment_metrics(aligned: DataFrame, page_id: str, least: float = 0.95) -> DataFrame:
    """Coverage and mode counts of aligned pages; total is all text of the page, so it is covered whole."""
    n = lambda want: F.aggregate(F.filter("lines", want), F.lit(0).cast("long"), lambda s, x: s + F.length(F.regexp_replace(x["text"], r"(?U)\s", "")))
    mode = lambda m: lambda x: x["mode"] == m
    out = aligned.select(page_id, n(lambda x: F.lit(True)).alias("total_chars"), n(mode("aligned")).alias("aligned_chars"), *(F.size(F.filter("lines", mode(m))).cast("long").alias(m) for m in ("aligned", "fallback_capacity", "header_footer_excluded")))
    share = F.when(F.col("total_chars") > 0, F.bround(F.col("aligned_chars") / F.col("total_chars"), 6)).otherwise(1.0)
    return out.withColumn("aligned_coverage", share).withColumn("page_aligned", F.col("aligned_coverage") >= least)


def same_characters(a: Column, b: Column) -> Column:
    """Whether two texts have the same characters, blanks and order aside (the zero-loss gate)."""
    chars = lambda c: F.array_sort(F.split(canonical(c), ""))
    return chars(a).eqNullSafe(chars(b))


def position_gate(expected: DataFrame, actual: DataFrame, page: list[str], row_id: str, tol: float = 16.0) -> DataFrame:
    """(page, checked, passed, pass_ratio, ok, worst): does each expected line have its text at its height?

    Of the actual lines within 2 tol of its centre, the one most like it (equal 1, contained by share of length, else the
    ratio; the first of equals) must reach 0.5 to be checked and lie within tol to pass. Both: page, row_id, text, y0, y1.
    """
    from leafmill.operators.geometry import binned_join

    e = expected.select(*page, F.col(row_id).alias("e_id"), canonical(F.col("text")).alias("e"), ((F.col("y0") + F.col("y1")) / 2).alias("ey")).where("e != ''")
    a = actual.select(*page, F.col(row_id).alias("a_id"), canonical(F.col("text")).alias("a"), F.col("y0").alias("a0"), F.col("y1").alias("a1")).where("a != ''")
    near = binned_join(e, a, page, F.col("ey"), F.col("a0") - 2 * tol, F.col("a1") + 2 * tol)

    @F.pandas_udf(T.DoubleType())
    def like(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([1.0 if p == q else min(len(p), len(q)) / max(len(p), len(q)) if p in q or q in p else at_least(p, q, 0.5) for p, q in zip(x, y)])

    best = near.withColumn("score", like("e", "a")).groupBy(*page, "e_id", "e", "ey").agg(F.max_by(F.struct("score", "a0", "a1"), F.struct("score", -F.col("a_id"))).alias("b"))
    dev = F.abs((F.col("b.a0") + F.col("b.a1")) / 2 - F.col("ey"))
    checked = best.where("b.score >= 0.5").select(*page, F.left("e", F.lit(40)).alias("expected"), dev.alias("dev"))
    worst = F.slice(F.sort_array(F.collect_list(F.when(F.col("dev") > tol, F.struct("dev", "expected"))), False), 1, 5)
    out = checked.groupBy(*page).agg(F.count("*").alias("checked"), F.count_if(F.col("dev") <= tol).alias("passed"), worst.alias("worst"))
    return out.withColumn("pass_ratio", F.col("passed") / F.col("checked")).withColumn("ok", F.col("pass_ratio") >= 0.9)


def matched_cells(expected: list[str], actual: list[str]) -> int:
    """Expected cells that find an unused actual cell equal or SIMILAR to them, the first that fits."""
    free, n = list(actual), 0
    for e in expected:
        k = next((i for i, a in enumerate(free) if e and a and (a == e or at_least(e, a, SIMILAR) >= SIMILAR)), None)
        if k is not None:
            free.pop(k)
            n += 1
    return n


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("expected", "actual", "matched")]))
def cell_match(expected: pd.Series, actual: pd.Series) -> pd.DataFrame:
    rows = [([] if e is None else list(e), [] if a is None else list(a)) for e, a in zip(expected, actual)]
    return pd.DataFrame({"expected": [len(e) for e, _ in rows], "actual": [len(a) for _, a in rows], "matched": [matched_cells(e, a) for e, a in rows]})


def without_exempt(actual: list[str], exempt: list[str], wanted: list[str]) -> list[str]:
    """Actual texts that are wanted, or no part of an exempt text; a part once found is used up."""
    chunks, keep = [bare(x) for x in exempt], []
    wanted = [bare(x) for x in wanted]
    for text in actual:
        c = bare(text)
        if not c:
            continue
        if not any(c == w or at_least(c, w, SIMILAR) >= SIMILAR for w in wanted):
            k = next((i for i, x in enumerate(chunks) if c in x), None)
            if k is not None:
                chunks[k] = chunks[k].replace(c, "", 1)
                continue
        keep.append(text)
    return keep


def weighted_pieces(text: str, weights: list[float]) -> list[str]:
    """A text cut at blanks into pieces by weight, an ideograph as two letters; no word is cut, so there may be fewer."""
    total = sum(max(0.0, w) for w in weights[:-1]) + max(0.0, weights[-1]) if weights else 0.0
    units = [0.0 if ch.isspace() else 1.0 if ord(ch) > 0x2E80 else 0.5 for ch in text]
    if len(weights) <= 1 or total <= 0 or not sum(units):
        return [text]
    marks, acc = [], 0.0
    for w in weights[:-1]:
        acc += max(0.0, w)
        marks.append(acc / total)
    pieces, start, done, due = [], 0, 0.0, False
    for i, (ch, u) in enumerate(zip(text, units)):
        done += u
        due = due or len(pieces) < len(marks) and done / sum(units) >= marks[len(pieces)]
        if due and ch.isspace() and text[start : i + 1].strip():
            pieces.append(text[start : i + 1].strip())
            start, due = i + 1, False
    return pieces + [text[start:].strip()] * bool(text[start:].strip())


def respaced(compact: str, spaced: str) -> str:
    """`compact` with the blanks of `spaced` if both have the same characters, else as it is."""
    if "".join(spaced.split()) != compact:
        return compact
    return " ".join(spaced.split())


def over_rows(text: str, rows: list[dict], least: float = 0.6) -> list[dict] | None:
    """A block's text dealt out to the rows of its band: by their own texts' lengths, or by width where they have none.

    None if there are no rows or the texts differ too much; what is left over goes to the last row.
    """
    compact = "".join(text.split())
    own = ["".join((r.get("text") or "").split()) for r in rows]
    if not rows or not compact:
        return None
    if any(own):
        if ratio(compact, "".join(own)) < least:
            return None
        takes = [len(x) for x in own]
    else:
        widths = [max(1.0, r["x1"] - r["x0"]) for r in rows]
        takes = [max(1, round(w / sum(widths) * len(compact))) for w in widths]
    out, at = [], 0
    for r, n, last in zip(rows, takes, [*[False] * (len(rows) - 1), True]):
        piece = compact[at:] if last else compact[at : at + n]
        at += len(piece)
        if piece:
            out.append({"text": respaced(piece, r["text"]) if r.get("text") else piece, **{k: r[k] for k in ("x0", "y0", "x1", "y1")}})
    return out


_PIECES = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1"))]))


@F.pandas_udf(_PIECES)
def dealt_out(text: pd.Series, rows: pd.Series) -> pd.Series:
    """`over_rows` of each block's text on its rows; null where it does not fit them."""
    return pd.Series([None if t is None or r is None else over_rows(t, [{**x} for x in r]) for t, r in zip(text, rows)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def kept_texts(actual: pd.Series, exempt: pd.Series, wanted: pd.Series) -> pd.Series:
    """`without_exempt` of each page's texts; null texts are none."""
    return pd.Series([without_exempt(*([] if x is None else [t for t in x if t is not None] for x in row)) for row in zip(actual, exempt, wanted)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_by_weight(text: pd.Series, weights: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else weighted_pieces(t, [] if w is None else list(w)) for t, w in zip(text, weights)], dtype=object)
