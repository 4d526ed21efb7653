"""Reading and writing the toolchain's files: page texts, JSONL logs, layout JSON, books."""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.payload import stored_text_of
from leafmill.functions.text import safe_stem
from leafmill.operators.geometry import clamp
from leafmill.runtime import materialize

PAGE_FILE = r"(?:^|/)page_(\d+)\.md$"

USAGE = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("schema_version", "pno_0based", "page_number", "attempt", "dpi", "dpi_actual", "http_status", "auto_leg", "rate_429")]
    + [T.StructField(n, T.LongType()) for n in ("image_bytes_orig", "image_bytes_final", "image_bytes", "prompt_tokens", "completion_tokens", "total_tokens", "duration_ms")]
    + [T.StructField(n, T.StringType()) for n in ("status", "endpoint_requested", "endpoint_normalized", "base_url_resolved", "model_resolved", "detail", "error", "endpoint", "base_url", "model", "output", "extra")]
    + [T.StructField("transient", T.BooleanType())]
)

BLOCK = "page_idx int, type string, text string, bbox array<double>, table_body string, table_caption array<string>, image_caption array<string>, chart_caption array<string>"


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, pno, page_number, markdown) of files `page_<n>.md`; other names and files that are no UTF-8 are skipped.

    Spark lists no empty files, so a page without any byte gives no row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "page_*.md").option("recursiveFileLookup", "true").load(folder)
    n = F.regexp_extract("path", PAGE_FILE, 1)
    rows = files.where(n != "").select("path", n.cast("int").alias("pno"), F.expr("try_validate_utf8(cast(content as string))").alias("markdown"))
    return rows.where("markdown is not null").select("path", "pno", (F.col("pno") + 1).alias("page_number"), "markdown")


def list_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(pno): distinct page numbers of files with content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "page_*.md").option("recursiveFileLookup", "true").load(folder)
    return files.where("length > 0").select(F.regexp_extract("path", PAGE_FILE, 1).alias("n")).where("n != ''").select(F.col("n").cast("int").alias("pno")).distinct()


def parse_usage(lines: DataFrame, line: str = "value") -> DataFrame:
    """Columns of USAGE from JSON lines; blank, broken and non-object lines are dropped.

    Everything is read as text first and cast by try_cast, so `"7"` counts as 7 and one bad field spoils no row.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in USAGE])
    rest = [c for c in lines.columns if c != line]
    ok = F.trim(line).startswith("{") & F.expr(f"try_parse_json(`{line}`) is not null")
    rows = lines.where(ok).select(*rest, F.from_json(line, text).alias("r"))
    return rows.select(*rest, *(F.expr(f"try_cast(r.{f.name} as {f.dataType.simpleString()})").alias(f.name) for f in USAGE))


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """JSONL logs with (file, line_no): a file is split inside its own row, so its order is known."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return parse_usage(lines)


def append_usage(events: DataFrame, folder: str) -> None:
    """Rows added to a folder of JSON lines, keys in their order; a job's files appear together or not at all."""
    events.select(*sorted(events.columns)).write.mode("append").option("ignoreNullFields", "false").json(folder)


def read_layout(spark: SparkSession, part1: str, part2: str | None = None, offset: int = 200) -> DataFrame:
    """Layout blocks with pno; the pages of the second part go on at `offset`. Boxes are clamped to 0 .. 1000."""
    def part(path: str, shift: int) -> DataFrame:
        b = spark.read.schema(BLOCK).option("multiLine", True).json(path).withColumn("pno", F.col("page_idx") + shift)
        return b.withColumns({n: clamp(F.get("bbox", F.lit(i))) for i, n in enumerate(("x0", "y0", "x1", "y1"))})

    one = part(part1, 0)
    return one if part2 is None else one.unionByName(part(part2, offset))


def ocr_rows(blocks: DataFrame) -> DataFrame:
    """Rows of recognised text: unit boxes scaled to 0 .. 1000, degenerate ones dropped, with their `row` in their page by height, then left.

    blocks: pno, type, bbox; without pno there are no rows to number.
    """
    sides = {n: clamp(F.get("bbox", F.lit(i)) * 1000.0) for i, n in enumerate(("x0", "y0", "x1", "y1"))}
    rows = blocks.where("type = 'ocr_text'").withColumns(sides).where("x1 > x0 and y1 > y0")
    if "pno" not in blocks.columns:
        return rows
    w = Window.partitionBy("pno").orderBy(F.col("y0") + F.col("y1"), F.col("x0") + F.col("x1"))
    return rows.withColumn("row", F.row_number().over(w) - 1)


def page_name(pno) -> F.Column:
    """The file name of a page."""
    return F.format_string("page_%04d.md", pno)


def page_plan(spark: SparkSession, n_pages: int, start: int = 0, stop: int | None = None) -> DataFrame:
    """(pno, page_number, output) of the pages from start to stop; a range outside the book is an error."""
    stop = n_pages if stop is None else min(stop, n_pages)
    if not 0 <= start < stop:
        raise ValueError(f"bad page range {start}..{stop} of {n_pages}")
    pages = spark.range(start, stop).select(F.col("id").cast("int").alias("pno"))
    return pages.select("pno", (F.col("pno") + 1).alias("page_number"), page_name(F.col("pno")).alias("output"))


def base64_content(spark: SparkSession, path: str, largest: int = 50 << 20) -> DataFrame:
    """(path, length, base64) of files up to `largest` bytes."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") <= largest).select("path", "length", F.base64("content").alias("base64"))


def write_books(books: DataFrame, folder: str) -> DataFrame:
    """(book_id, path) of the files written: `<stem>-ocr.md` of each book in a folder all executors share; none for no books.

    books: book_id, book, and `stem` (else the id). A file is written under another name and then renamed, so readers see whole
    ones, and a task that runs again writes the same.
    """
    stem = F.col("stem") if "stem" in books.columns else F.col("book_id")

    def write(batches):
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            paths = []
            for name, text in zip(b["stem"], b["book"]):
                path = os.path.join(folder, f"{name}-ocr.md")
                part = f"{path}.{uuid.uuid4().hex}"
                with open(part, "w", encoding="utf-8", newline="\n") as f:
                    f.write(text)
                os.replace(part, path)
                paths.append(path)
            yield pd.DataFrame({"book_id": b["book_id"], "path": paths})

    done = books.where("book is not null").select(F.col("book_id").cast("string").alias("book_id"), safe_stem(stem).alias("stem"), "book").mapInPandas(write, "book_id string, path string")
    return materialize(done, "books")


# fixed values: the reports a build leaves beside its books
ARTEFACTS = ("boxes", "align_report", "verify_report", "census_report", "llm_pages", "mineru_boxes", "usage_summary")


def write_artefact(df: DataFrame, folder: str, name: str) -> None:
    """One of the ARTEFACTS as JSON lines in its own folder, in place of an older one; null fields are kept."""
    if name not in ARTEFACTS:
        raise ValueError(f"no such artefact: {name}")
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder.rstrip('/')}/{name}")


def text_or_json(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of files: the text of a stored response for `.json`, else the file as it is. Files that are no UTF-8 are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = files.select("path", F.expr("try_validate_utf8(cast(content as string))").alias("text")).where("text is not null")
    is_json = F.lower("path").endswith(".json")
    return rows.where(~is_json).union(rows.where(is_json).select("path", stored_text_of("text").alias("text")))


def json_text(c):
    """The text of a stored response: the message of a chat response, else `text`, else `content`."""
    chat = F.get_json_object(c, "$.transcript_response.choices[0].message.content")
    return F.coalesce(chat, F.get_json_object(c, "$.text"), F.get_json_object(c, "$.content"))
