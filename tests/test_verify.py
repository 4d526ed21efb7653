"""Gates and their summary, bindings, page lookups, files."""

import glob
import json
import os

import pytest

from leafmill.functions import payload as PL
from leafmill.functions import text as X
from leafmill.operators import layout as L
from leafmill.operators import usage as U
from leafmill.operators import verify as V
from leafmill.plans import inventory
from leafmill.sources import files as S
from pyspark.sql import functions as F


def test_summary_of_gates(spark):
    cols = "g string, page int, zero_loss boolean, order_ok boolean, geometric_checked int, geometric_ratio double, geometric_ok boolean, aligned_coverage double, covered_coverage double, page_aligned boolean, table_unreliable boolean, cell_recall double, cell_precision double"
    rows = [("a", 0, True, True, 4, 0.5, False, 1.0, 1.0, True, False, 0.5, 1.0), ("a", 1, False, None, 0, 1.0, True, 0.0, 1.0, False, True, None, None), ("a", 2, None, False, 2, 1.0, True, None, None, None, None, 1.0, 0.0), ("b", 0, True, None, 0, 1.0, True, 0.0, 0.0, False, False, None, None)]
    got = {r.g: r for r in V.verify_summary(spark.createDataFrame(rows, cols), ["g"], "page").collect()}
    a, b = got["a"], got["b"]
    assert (a.pages_total, a.zero_loss_pages, a.reading_order_checked_pages, a.reading_order_ok_pages, a.geometric_ok_pages) == (3, 1, 2, 1, 2)
    assert a.mean_geometric_pass_ratio == 0.75 and abs(a.mean_covered_coverage - 2 / 3) < 1e-9 and (a.mean_cell_recall, a.mean_cell_precision, a.computed_pages) == (0.75, 0.5, 2)
    assert (a.zero_loss_fail_pages, a.reading_order_fail_pages, a.geometric_fail_pages, a.table_unreliable_pages) == ([1, 2], [2], [0], [1])
    assert b.mean_geometric_pass_ratio == 1.0 and b.mean_cell_recall == 0.0 and b.zero_loss_fail_pages == []


def test_damage(spark):
    rows = [("x", i, "ok?" if i % 2 else "fine [a字]") for i in range(30)] + [("y", 1, "clean"), ("y", 2, None), ("z", 1, "a" * 120 + "\ufffd\x01")]
    got = {r.d: r for r in V.damage(spark.createDataFrame(rows, "d string, p long, t string"), ["d"], "p", "t").collect()}
    assert got["x"].bad_pages == 30 and got["x"].first_bad == list(range(10)) and got["x"].must_discard and got["x"].question_mark_count == 15 and got["x"].han_in_transcription == 15
    assert not got["y"].must_discard and got["y"].evidence == [V.NO_EVIDENCE] and got["y"].pages == 2
    assert got["z"].sample_replacement == 0 and got["z"].evidence == [V.EVIDENCE["replacement_count"], V.EVIDENCE["control_count"]]


def test_bindings(spark):
    cols = "book_id string, path string, size long, pages int"
    records = spark.createDataFrame([("same", "p", 1, 9, 3), ("moved", "p", 1, 9, 12), ("changed", "p", 1, 9, None), ("other", "p", 1, None, 0), ("none", None, 1, 9, 0), ("old", "p", None, None, 5)], cols + ", last_page int")
    facts = spark.createDataFrame([("same", "p", 1, 9), ("moved", "q", 1, 9), ("changed", "p", 2, 9), ("other", "q", 1, 9), ("none", "p", 1, 9), ("old", "p", 5, 5), ("unknown", "p", 1, 1)], cols)
    got = {r.book_id: (r.status, r.warnings) for r in V.binding(records, facts).collect()}
    assert got == {"same": ("bound", []), "moved": ("bound", ["moved", "foreign_pages"]), "changed": ("bound", ["changed"]), "other": ("mismatch", []), "none": ("mismatch", []), "old": ("bound", [])}


def test_page_lookup_and_usable(spark):
    wanted = spark.createDataFrame([("b", 0), ("b", 1), ("b", 5)], "book string, pno int")
    texts = spark.createDataFrame([("b", 1, "one"), ("b", 2, "two")], "book string, pno int, t string")
    assert {r.pno: r.t for r in V.by_page_number(wanted, texts, ["book"], "pno", "t").collect()} == {0: "one", 1: "one", 5: None}
    lines = spark.createDataFrame([(1, None), (1, "aligned"), (2, "fallback_capacity"), (3, "header_footer_excluded"), (4, "other")], "p int, mode string")
    assert {r.p: (r.usable, r.aligned, r.header_footer, r.fallback) for r in V.usable_pages(lines, ["p"]).collect()} == {1: (True, 2, 0, 0), 2: (False, 0, 0, 1), 3: (True, 0, 1, 0), 4: (False, 0, 0, 0)}


def test_orders_and_names(spark):
    df = spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "b", 3), ("g", None, 0), ("h", None, 1)], "g string, v string, t int")
    assert {r.g: r.values for r in V.ordered_distinct(df, ["g"], "v", ["t"]).collect()} == {"g": ["b", "a"]}
    named = spark.createDataFrame([(1, "A.pdf"), (2, "a.PDF"), (3, None), (4, "b")], "i int, n string")
    assert sorted(r.i for r in V.first_named(named, F.col("n"), ["i"]).collect()) == [1, 4]
    pages = spark.createDataFrame([("d", 0, None, 7), ("d", 1, None, None), ("e", 0, 9, 1), ("f", 0, None, 3), ("f", 1, None, 5)], "d string, pos int, given int, reported int")
    assert {(r.d, r.pos): r.page for r in L.resolved_pages(pages, ["d"], "pos", "given", "reported").collect()} == {("d", 0): 0, ("d", 1): 1, ("e", 0): 9, ("f", 0): 3, ("f", 1): 5}


def test_tokens_and_invariants(spark):
    text = "a `x` $y$ ʰ\n  · 12 · \n```\nz\n``` \\frac{a}{b}"
    df = spark.createDataFrame([(text, text.replace("a ", "b ")), (text, text.replace("$y$", "y")), (text, text.replace("ʰ", "h")), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(X.keeps_invariants(F.col("a"), F.col("b"))).collect()] == [True, False, False, True]
    t = df.select(X.protected_tokens(F.col("a")).alias("t")).first().t
    assert t.code_math == ["`x`", "```\nz\n```", "$y$", "\\frac{a}{b}"] and t.footers == ["· 12 ·"]


def test_cost_limits_and_masks(spark):
    one = spark.createDataFrame([(1_000_000, 500_000, 7, 5, "secret")], "a long, b long, p int, n int, k string")
    r = one.select(U.cost(F.col("a"), F.col("b"), 2, 4), U.cost(F.col("a"), F.col("b"), None, 4), X.clamp_page(F.col("p"), F.col("n")), X.masked_key(F.col("k")), X.masked_key(F.lit(None).cast("string"))).first()
    assert tuple(r) == (4.0, None, 5, "sk-**** (6)", "")
    df = spark.range(30)
    assert [x.id for x in U.paged(df, [F.desc("id")], 3, 2).collect()] == [27, 26, 25] and U.paged(df, [F.asc("id")], 0).count() == 1 and U.paged(df, [F.asc("id")], 999, most=20).count() == 20


def test_secrets_of_nested_objects():
    data = {"a": 1, "api_key": {"b": 2}, "c": {"token": "x", "d": {"e": "sk-abcdefgh12", "f": [{"password": 1}]}, "g": {}}, "h": "Bearer abcdefgh1"}
    kept, dropped = PL.without_secrets(data)
    assert kept == {"a": 1, "c": {"d": {"f": [{"password": 1}]}, "g": {}}} and dropped == ["api_key", "c.token", "c.d.e", "h"]
    assert PL.without_secrets({}) == ({}, [])


def test_files(spark, tmp_path):
    books = spark.createDataFrame([("b1", "# one\n", "My:Book.pdf"), ("b2", None, "x"), ("b3", "three", None)], "book_id string, book string, stem string")
    assert {(r.book_id, os.path.basename(r.path)) for r in S.write_books(books, str(tmp_path / "out")).collect()} == {("b1", "My_Book-ocr.md"), ("b3", "book-ocr.md")}
    assert open(tmp_path / "out" / "My_Book-ocr.md", encoding="utf-8").read() == "# one\n" and len(os.listdir(tmp_path / "out")) == 2
    S.append_usage(spark.createDataFrame([(1, "b", None)], "z int, a string, m string"), str(tmp_path / "log"))
    S.append_usage(spark.createDataFrame([(2, "c", "d")], "z int, a string, m string"), str(tmp_path / "log"))
    lines = sorted(x for f in glob.glob(f"{tmp_path}/log/*.json") for x in open(f).read().splitlines())
    assert lines == ['{"a":"b","m":null,"z":1}', '{"a":"c","m":"d","z":2}']
    S.write_artefact(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path), "usage_summary")
    assert spark.read.json(f"{tmp_path}/usage_summary").count() == 1
    with pytest.raises(ValueError):
        S.write_artefact(books, str(tmp_path), "other")
    os.makedirs(tmp_path / "t")
    (tmp_path / "t" / "a.md").write_text("plain")
    (tmp_path / "t" / "b.json").write_text(json.dumps({"text": "stored"}))
    (tmp_path / "t" / "c.md").write_bytes(b"\xff\xfe")
    assert {os.path.basename(r.path): r.text for r in S.text_or_json(spark, str(tmp_path / "t")).collect()} == {"a.md": "plain", "b.json": "stored"}


def test_row_boxes_are_sorted(spark):
    rows = [(0, "ocr_text", [0.5, 0.5, 0.6, 0.6]), (0, "ocr_text", [0.1, 0.5, 0.2, 0.6]), (0, "ocr_text", [0.1, -0.5, 0.2, 0.2]), (0, "image", [0.0, 0.0, 1.0, 1.0]), (0, "ocr_text", [0.3, 0.3, 0.3, 0.4]), (1, "ocr_text", None)]
    got = [(r.row, r.x0, r.y1) for r in S.ocr_rows(spark.createDataFrame(rows, "pno int, type string, bbox array<double>")).orderBy("row").collect()]
    assert got == [(0, 100.0, 200.0), (1, 100.0, 600.0), (2, 500.0, 600.0)]


def test_printed_numbers_agree_with_plain_python(spark, data):
    from leafmill.functions import pages as P

    texts = [(r.page_id, r.markdown) for r in spark.read.parquet(f"{data}/page_markdown.parquet").select("page_id", "markdown").collect()] + [(-1, None), (-2, ""), (-3, "a\n\n— xii —\n"), (-4, "第 7 页\nb\nc\nd\ne"), (-5, "1\n2\n3001"), (-6, "vi\n\n12 a")]
    df = spark.createDataFrame(texts, "i long, t string")
    got = {r.i: (r.x.style, r.x.number) for r in df.select("i", P.printed_page_number(F.col("t"), F.array().cast("array<string>")).alias("x")).collect()}
    assert got == {i: P.printed_number(t, []) or (None, None) for i, t in texts}


def test_invariants_on_the_test_table(spark, data):
    got = inventory.g21_kept_by_cleaning(spark, data).groupBy("lines").count().collect()
    assert sum(r["count"] for r in got) > 0
    assert inventory.j5_position_gate(spark, data).where("checked > 0 and pass_ratio >= 0.9").count() > 0
    assert inventory.a14_cell_match(spark, data).where("matched > actual or matched > expected").count() == 0
