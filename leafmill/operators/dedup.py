"""Exactly one row of each message that was delivered at least once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import strip_blanks


def page_message_key(page: str = "pno_0based", number: str = "page_number", status: str = "status") -> dict[str, Column]:
    """Columns that identify a page message: run, page, attempt, status.

    The page is `pno_0based`, or `page_number` - 1 where that is null; the status counts without case and outer
    blanks. A null run, attempt or status is a value like any other; a row without any page has a null page.
    """
    return {
        "run_id": F.col("run_id"),
        "page": F.coalesce(F.col(page).cast("long"), F.col(number).cast("long") - 1),
        "attempt": F.col("attempt"),
        "status": F.lower(strip_blanks(F.col(status))),
    }


def _ranked(df: DataFrame, key: dict[str, Column], order: Sequence[Column], row_id: str) -> DataFrame:
    names = [f"__k_{n}" for n in key]
    arrival = [f"__o_{i}" for i in range(len(order))]
    keyed = df.select(
        F.col(row_id).alias("__row"), *(c.alias(n) for n, c in zip(names, key.values())), *(c.alias(n) for n, c in zip(arrival, order))
    )
    # rank 1 only: Spark keeps one candidate per key in every map task before the shuffle (WindowGroupLimit), so a
    # message that makes up a third of all rows sends one row per task
    w = Window.partitionBy(*names).orderBy(*(F.col(n).asc_nulls_last() for n in arrival), F.col("__row").asc_nulls_last())
    return keyed.withColumn("__rank", F.row_number().over(w)).where("__rank = 1")


def first_copies(df: DataFrame, key: dict[str, Column], order: Sequence[Column], row_id: str) -> DataFrame:
    """The row ids kept: of each message the copy that arrived first; column `row_id` only.

    key: named columns that identify a message, nulls equal each other. order: arrival columns, nulls last; ties go to
    the smallest `row_id`, which must be unique. An empty table gives an empty one.
    """
    return _ranked(df, key, order, row_id).select(F.col("__row").alias(row_id))


def keep_first(df: DataFrame, key: dict[str, Column], order: Sequence[Column], row_id: str, only: Column | None = None) -> DataFrame:
    """`df` without surplus copies, all columns kept. Rows where `only` is not true are no messages and stay."""
    part = df if only is None else df.where(F.coalesce(only, F.lit(False)))
    return df.join(surplus_copies(part, key, order, row_id), row_id, "left_anti")


def surplus_copies(df: DataFrame, key: dict[str, Column], order: Sequence[Column], row_id: str) -> DataFrame:
    """The row ids of all copies but the first of each message.

    The anti-join runs on the unique row id, never on the message, so that no key is hot.
    """
    return df.select(row_id).join(first_copies(df, key, order, row_id), row_id, "left_anti")


def new_messages(batch: DataFrame, stored: DataFrame, key: dict[str, Column], order: Sequence[Column], row_id: str) -> DataFrame:
    """Rows of `batch` whose message is not stored yet, one of each.

    stored: a table with the key's columns (by the key's names), one row or more per message. The batch is reduced to
    one row per message before the anti-join, which compares null-safe.
    """
    kept = keep_first(batch, key, order, row_id).withColumns({f"__k_{n}": c for n, c in key.items()})
    seen = stored.select(*(F.col(n).alias(f"__s_{n}") for n in key)).distinct()
    match = None
    for n in key:
        one = F.col(f"__k_{n}").eqNullSafe(F.col(f"__s_{n}"))
        match = one if match is None else match & one
    return kept.join(seen, match, "left_anti").drop(*(f"__k_{n}" for n in key))
