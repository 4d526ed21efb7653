"""Log operators over a growing folder of JSON lines: messages once, the latest row of each page, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.dedup import page_message_key
from leafmill.operators.usage import events
from leafmill.sources.files import USAGE, parse_usage

LOG = "delivery_id long, received_at timestamp, run_id string, book_id string, "


def stream_log(spark: SparkSession, folder: str, files_per_batch: int = 10) -> DataFrame:
    """Rows of JSON lines as they arrive: the USAGE columns with delivery id, time, run and book."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    own = F.from_json("value", LOG.rstrip(", "))
    return parse_usage(lines.withColumns({n: own[n] for n in ("delivery_id", "received_at", "run_id", "book_id")}))


def latest_pages(log: DataFrame) -> DataFrame:
    """The last row of each page, for update or complete mode: the state is one row per page, late rows never win."""
    rows = events(log)
    return rows.groupBy("run_id", "page_key").agg(F.max_by(F.struct("delivery_id", "status", "total_tokens", "duration_ms"), F.struct("received_at", "delivery_id")).alias("r")).select("run_id", "page_key", "r.*")


def messages_once(log: DataFrame, delay: str = "7 days") -> DataFrame:
    """The first copy of each message to arrive; copies more than `delay` late are seen as new, the state is bounded by it."""
    key = page_message_key()
    rows = log.where(key["page"].isNotNull()).withColumns({f"__{n}": c for n, c in key.items()})
    return rows.withWatermark("received_at", delay).dropDuplicatesWithinWatermark([f"__{n}" for n in key]).drop(*(f"__{n}" for n in key))


def upsert_latest(batch: DataFrame, store: DataFrame | None) -> DataFrame:
    """The store after a batch, for foreachBatch: latest wins over both, so batches may repeat or come out of order."""
    cols = ["run_id", "page_key", "received_at", "delivery_id", "status", "total_tokens", "duration_ms", "transient"]
    rows = events(batch).select(*cols)
    both = rows if store is None else rows.unionByName(store.select(*cols))
    rest = [c for c in cols if c not in ("run_id", "page_key")]
    return both.groupBy("run_id", "page_key").agg(F.max_by(F.struct(*rest), F.struct("received_at", "delivery_id")).alias("r")).select("run_id", "page_key", "r.*")


def per_hour(log: DataFrame, delay: str = "1 day") -> DataFrame:
    """Rows and tokens by hour of arrival and status, with a watermark for late rows."""
    rows = events(log).withWatermark("received_at", delay)
    return rows.groupBy(F.window("received_at", "1 hour").alias("w"), "status").agg(F.count("*").alias("rows"), F.sum("total_tokens").alias("tokens")).select(F.col("w.start").alias("hour"), "status", "rows", "tokens")


__all__ = ["USAGE", "latest_pages", "messages_once", "per_hour", "stream_log", "upsert_latest"]
