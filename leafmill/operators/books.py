"""Books: which record a source belongs to, records brought up to date, pages merged to books."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.pages import merge_pages


def match_sources(probes: DataFrame, records: DataFrame, probe_id: str, book: str = "book_id") -> DataFrame:
    """(probe_id, status, quality, book, candidates): the record of each probe.

    Both: source_name, source_size, page_count. Quality 3: the same name; 2: equal size and page count. One best record is
    `bound`, several are `ambiguous` (book null), none `not_found`. Nulls never match. Two equi-joins, no cross join; the
    candidates are counted, never gathered.
    """
    p = probes.select(probe_id, F.lower("source_name").alias("n"), "source_size", "page_count")
    r = records.select(book, F.lower("source_name").alias("n"), "source_size", "page_count")
    by_name = p.join(r.select(book, "n"), "n").select(probe_id, book, F.lit(3).alias("quality"))
    by_size = p.join(r.select(book, "source_size", "page_count"), ["source_size", "page_count"]).select(probe_id, book, F.lit(2).alias("quality"))
    best = by_name.union(by_size).groupBy(probe_id, book).agg(F.max("quality").alias("quality"))
    per = best.groupBy(probe_id, "quality").agg(F.count("*").alias("candidates"), F.min(book).alias(book))
    top = per.groupBy(probe_id).agg(F.max_by(F.struct("quality", "candidates", book), "quality").alias("t"))
    out = probes.select(probe_id).join(top, probe_id, "left")
    status = F.when(F.col("t").isNull(), "not_found").when(F.col("t.candidates") > 1, "ambiguous").otherwise("bound")
    return out.select(probe_id, status.alias("status"), F.coalesce("t.quality", F.lit(0)).alias("quality"), F.when(status == "bound", F.col(f"t.{book}")).alias(book), F.coalesce("t.candidates", F.lit(0)).cast("long").alias("candidates"))


def compared(records: DataFrame, facts: DataFrame, book: str, fields: Sequence[str]) -> DataFrame:
    """(book, field, state): `same`, `diff`, or `unknown` where either side is null, of each field of a record and its facts."""
    a, b = records.alias("a"), facts.alias("b")
    state = lambda f: F.when(F.col(f"a.{f}").isNull() | F.col(f"b.{f}").isNull(), "unknown").when(F.col(f"a.{f}") == F.col(f"b.{f}"), "same").otherwise("diff")
    rows = a.join(b, F.col(f"a.{book}") == F.col(f"b.{book}")).select(F.col(f"a.{book}").alias(book), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), state(f).alias("state")) for f in fields))).alias("x"))
    return rows.select(book, "x.*")


def updated_records(records: DataFrame, changes: DataFrame, book: str = "book_id", keep: Sequence[str] = ("created_at",)) -> DataFrame:
    """Records overlaid by changes: non-null new values win, unknown columns and `keep` stay, new books are added."""
    a, b = records.alias("a"), changes.alias("b")
    out = []
    for c in dict.fromkeys([*records.columns, *changes.columns]):
        old, new = F.col(f"a.{c}") if c in records.columns else None, F.col(f"b.{c}") if c in changes.columns else None
        pair = [old, new] if c in keep else [new, old]
        out.append(F.coalesce(*(x for x in pair if x is not None)).alias(c))
    return a.join(b, F.col(f"a.{book}") == F.col(f"b.{book}"), "full_outer").select(*out)


def pages_done(pages: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, pages_done, n): the sorted distinct pages of each book."""
    d = pages.where("pno is not null").select(book, "pno").distinct()
    return d.groupBy(book).agg(F.array_sort(F.collect_list("pno")).alias("pages_done"), F.count("*").alias("n"))


def latest_pages(pages: DataFrame, page_id: str, text: str) -> DataFrame:
    """(book_id, pno, text): of pages stored several times the last produced (ties: highest id); nulls count as oldest."""
    order = F.struct(F.coalesce(F.unix_micros("produced_at"), F.lit(0)).alias("t"), page_id)
    return pages.where(F.col(text).isNotNull() & F.col("pno").isNotNull()).groupBy("book_id", "pno").agg(F.max_by(text, order).alias(text))


def merged_books(pages: DataFrame, titles: DataFrame, text: str) -> DataFrame:
    """(book_id, pages, book): one document per book, pages in order, no page made up. pages: book_id, pno (from 0), text.

    A book is one row by nature, its pages are gathered in the last step only.
    """

    @F.pandas_udf(T.StringType())
    def merge(title: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([merge_pages({int(p["pno"]) + 1: p["t"] for p in x}, t or "") for t, x in zip(title, parts)], dtype=object)

    rows = pages.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("pno", F.col(text).alias("t")))).alias("parts"))
    return rows.join(titles.select("book_id", "title"), "book_id", "left").select("book_id", F.size("parts").cast("long").alias("pages"), merge("title", "parts").alias("book"))
