"""The toolchain's own operators: known cases, brute force, odd rows."""

import datetime as dt
import difflib
import json
import random
import re

import pytest

from leafmill.functions import pages as P
from leafmill.functions import rules as R
from leafmill.functions import text as X
from leafmill.operators import align as A
from leafmill.operators import books as B
from leafmill.operators import geometry as G
from leafmill.operators import tables as TB
from leafmill.operators import usage as U
from leafmill.plans import inventory as INV
from leafmill.plans import toolchain as TC

GOOD = ["[tʷ]", "[kʰ]", "ɕʲ", "[tɕʷ]", "[maŋ³⁵][kʰ][tʷ][aː][ˈma]", "[ã]", "语音学是研究人类说话声音的学科。", "· 1 ·", "| a | b |\n| --- | --- |\n| [tʷ] | [kʰ] |"]
BAD = ["[t_w]", "[k_w]", "[tc_w]", "[k^h]", "[tw]", "[tɕ'w]", "[kh]", "[ɕj]", "^jɕ", "_nt", "$[\\underset{w}{t}]$", "$[\\overset{h}{k}]$", "$k^{ʰ}$", "t ʷ", "̃maŋ", "[tʷ"]


@pytest.mark.parametrize("text", GOOD)
def test_good_notation(text):
    assert R.find_issues(text) == []


@pytest.mark.parametrize("text", BAD)
def test_bad_notation(text):
    found = R.find_issues(text)
    assert found and [(i["position"], i["code"]) for i in found] == sorted((i["position"], i["code"]) for i in found)


def test_issue_lines_and_brackets():
    assert [(i["code"], i["line"]) for i in R.find_issues("a\n[tw]\n(")] == [("dropped_attached_mark", 2), ("unbalanced_brackets", 3)]
    assert R.unbalanced("(]") == [1, 0] and R.unbalanced("\\( [a]") == [] and R.find_issues(None) == []


def test_rule_counts(spark):
    rows = spark.createDataFrame([(t,) for t in GOOD + BAD + [None, "", "\\$ \\_ $"]], "t string")
    got = rows.select("t", *(c.alias(k) for k, c in R.rule_counts(rows.t).items())).collect()
    for r in got:
        if r.t is not None:
            for k in ("latex_residue", "banned_bracket_mark", "dropped_attached_mark", "ascii_modifier_letter", "ascii_position_operator"):
                assert r[k] == sum(i["code"] == k for i in R.find_issues(r.t)), (r.t, k)


def test_clean_page():
    page = "中文,测试  \r\n\r\n\r\n![a](b.png) ![c](http://x/y.png)\r3.14 `代码,不改` $x,y$ \"a\" 'b'\n```\n![d](e.png)\n```\n· 12 ·  "
    clean = P.clean_page(page)
    assert "\r" not in clean and "\n\n\n" not in clean and "中文，测试" in clean and "[图片]" in clean and "http://x/y.png" in clean
    assert "`代码,不改`" in clean and "$x,y$" in clean and "3.14" in clean and "![d](e.png)" in clean and clean.endswith("· 12 ·") and "“a” ‘b”" in clean
    assert P.clean_page(clean) == clean and P.clean_page("") == "" and P.clean_page("中文，test,中文") == "中文，test，中文"


def test_books():
    assert P.merge_pages({4: ""}, "书") == "# 书\n\n---\n第 4 页\n\n---\n"
    book = P.merge_pages({5: "第五,页", 2: "---\n第 2 页\n\n第二,页\n\n---"}, "语音学,教程")
    assert book.startswith("# 语音学，教程\n") and book.index("第二，页") < book.index("第五，页") and "第 3 页" not in book and P.clean_book(book) == book
    old = "# 书\n\n## Page Index\n\n- Page 1: PAGE 5\n- Page 2: PAGE 2\n\n<!-- PAGE 5 -->\n\n---\n第 5 页\n\n五\n\n<!-- PAGE 2 -->\n第 2 页\n\n二,见第 12 页\n"
    new = P.clean_book(old)
    assert "Index" not in new and "PAGE" not in new and new.count("---\n第") == 2 and new.index("二，") < new.index("五")
    assert P.clean_book("# 测试书\n\n## Page Index\n- Page 1: PAGE 1\n\n正文,内容") == "# 测试书\n\n正文，内容"
    assert P.label_of("扉頁") == "扉页" and P.label_of("目录 第 3 页") == "目录 第 3 页" and P.label_of("P 7") == "第 7 页" and P.label_of("第三页") is None


def test_plain_markdown():
    assert P.plain_markdown("## a\n- **b** `c` [d](e) ![f](g)\n\n| A | B |\n（“|”表示音步的界线）\n|| 龈边音…") == "a\nb c d f\nA B\n（“|”表示音步的界线）\n|| 龈边音…"
    assert P.headings("# 第一章 绪论\n## 1.1 研究背景\n### 1.1.1 详细分类\nx # y") == [(1, "第一章 绪论"), (2, "1.1 研究背景"), (3, "1.1.1 详细分类")]
    assert [P.printed_number(t, []) for t in ("· 12 ·", "- 45 -", "第 88 页", "· iv ·", "text", None)] == [("D", 12), ("D", 45), ("D", 88), ("r", 4), None, None]


def _col(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, t {kind}")
    return [r.x for r in rows.select("i", f(rows.t).alias("x")).orderBy("i").collect()]


def test_text_columns(spark):
    odd = ["a　 b\x1c", None, "", "é\n", "x" * 100_000]
    assert _col(spark, odd, X.canonical)[:4] == ["ab", None, "", "é"]
    assert _col(spark, ["· 12 ·", "-12-", "PAGE 12", "第 12 页", "12", "第一章 语音学", "标题", "", None], X.is_page_like) == [True] * 5 + [False] * 4
    assert _col(spark, ["", None, "a?", "ok text", "\x01", "3abc"], X.garble_ratio) == [0.0, 0.0, 1.0, 0.0, 1.0, 1.0]
    assert _col(spark, ["a.b.pdf", "CON.pdf", "x/y:z.pdf", None, "...", "无名"], X.safe_stem) == ["a.b", "CON_book", "y_z", "book", "book", "无名"]
    assert _col(spark, ["0-2,7", "2,1,1", "0-0", ""], X.page_spec) == [[0, 1, 2, 7], [1, 2], [0], []]
    with pytest.raises(Exception, match="reversed"):
        _col(spark, ["3-1"], X.page_spec)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("中文,.;:()a \n") for _ in range(30)) for _ in range(60)]
    assert _col(spark, texts, X.cjk_punctuation) == [P.punctuate(t) for t in texts]
    lines = ["".join(rnd.choice("a中 \t\r\n\n　") for _ in range(25)) for _ in range(60)] + ["x\n  · 3 ·  \ny"]
    assert [t.strip("\n") for t in _col(spark, lines, X.normal_lines)] == [P.tidy_lines(t) for t in lines]


# ---- log


def _log(spark, rows):
    return spark.createDataFrame(
        rows,
        "delivery_id long, received_at timestamp, run_id string, pno_0based int, page_number int, status string, prompt_tokens long, completion_tokens long, total_tokens long, duration_ms long, http_status int, rate_429 int, transient boolean, records string",
    ).drop("records")


def test_usage(spark):
    t = lambda h: dt.datetime(2025, 1, 1, h)
    rows = [
        (1, t(1), "r", 0, 1, "success", 5, 5, 10, 100, 200, None, None, ""), (2, t(2), "r", 0, 1, " SKIPPED", 0, 0, 0, 0, None, None, None, ""),
        (3, t(1), "r", None, 2, "success", 7, 7, 14, 0, 200, 2, None, ""), (4, t(1), "r", None, None, "failed", 0, 0, 0, None, 429, None, None, ""),
        (5, t(1), "r", None, None, "success", 1, 1, None, 300, 200, None, None, ""), (6, t(1), "r", 9, None, "skipped", 0, 0, 0, 0, None, None, True, ""),
        (7, None, "q", 1, None, None, None, None, None, None, None, None, None, ""),
    ]
    log = _log(spark, rows)
    got = {r.run_id: r for r in U.usage_summary(log, ["run_id"]).collect()}
    r = got["r"]
    assert (r.records, r.pages, r.successful_pages, r.failed_pages, r.skipped_pages, r.total_tokens, r.elapsed_p50_ms, r.elapsed_p95_ms) == (6, 5, 2, 1, 2, 14, 0, 300)
    assert got["q"].pages == 1 and got["q"].elapsed_p50_ms == 0
    planned = spark.createDataFrame([("r", 8)], "run_id string, planned int")
    p = {x.run_id: x for x in U.progress(log, ["run_id"], planned, 60_000).collect()}["r"]
    assert (p.pages_ok, p.skipped, p.failed, p.p50_ms, p.n429, p.pct, p.pages_per_min, p.eta_ms) == (2, 1, 1, 300, 3, 25.0, 2.0, 180_000)
    assert U.usage_summary(log.limit(0), ["run_id"]).count() == 0


def test_missing_and_limits(spark):
    books = spark.createDataFrame([("a", 3), ("b", None), ("c", 0)], "book_id string, page_count int")
    have = spark.createDataFrame([("a", 1), ("a", 1), ("z", 0)], "book_id string, pno int")
    assert sorted(tuple(r) for r in U.missing_pages(books, have).collect()) == [("a", 0), ("a", 2)]
    rows = [("r", i, 429 if i in (3, 4, 5) else 200, "success") for i in range(50)]
    got = U.adaptive_limits(spark.createDataFrame(rows, "run_id string, at int, http_status int, status string"), "run_id", ["at"], 4).first().limits
    assert got[:6] == [4, 4, 4, 2, 1, 1] and got[25] == 2 and got[45] == 3 and max(got) == 4


# ---- geometry


def brute_bands(counts, least, gap, short, long):
    on = [i for i, c in enumerate(counts) if c >= least]
    bands = []
    for i in on:
        if bands and i - bands[-1][1] <= gap + 1:
            bands[-1][1] = i
        else:
            bands.append([i, i])
    if bands and len(counts) - 1 - bands[-1][1] <= gap:
        bands[-1][1] = len(counts) - 1
    return {(a, b) for a, b in bands if short <= b - a + 1 <= long}


def test_ink_bands(spark):
    cases = [([0, 0, 5, 5, 5, 0, 0], 2, 0, 1, 100), ([5, 5, 0, 5, 5], 2, 1, 1, 100), ([5, 5, 0, 5, 5], 2, 0, 1, 100), ([5, 0, 0, 0, 5, 5, 5], 2, 0, 3, 100), ([5] * 5, 2, 0, 1, 3), ([0, 5, 5, 5], 2, 0, 1, 100), ([1, 1, 1], 2, 0, 1, 100), ([], 1, 1, 1, 9)]
    want = [{(2, 4)}, {(0, 4)}, {(0, 1), (3, 4)}, {(4, 6)}, set(), {(1, 3)}, set(), set()]
    rnd = random.Random(5)
    for (c, *rest), w in zip(cases, want):
        assert brute_bands(c, *rest) == w
    many = [[rnd.choice([0, 0, 5]) for _ in range(rnd.randint(0, 14))] for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(many)), "k int, c array<int>")
    for gap in (0, 2):
        got = {}
        for r in G.ink_bands(df, ["k"], "c", 2, gap, 1, 6).collect():
            got.setdefault(r.k, set()).add((r.start, r.end))
        assert all(got.get(k, set()) == brute_bands(c, 2, gap, 1, 6) for k, c in enumerate(many))


def brute_labels(seen):
    rules = []
    for i, d in enumerate(seen):
        if d is None:
            if not rules:
                rules.append((0, "D", 1))
        elif not rules or d[0] != rules[-1][1] or d[1] != rules[-1][2] + i - rules[-1][0]:
            rules.append((i, *d))
    return rules


def test_page_labels(spark):
    rnd = random.Random(6)
    cases = [[("r", 1), ("r", 2), ("D", 1), ("D", 2), None]] + [[rnd.choice([None, ("D", i + 1), ("D", i), ("r", i + 1)]) for i in range(rnd.randint(1, 9))] for _ in range(150)]
    rows = [(str(k), i, d[0] if d else None, d[1] if d else None) for k, c in enumerate(cases) for i, d in enumerate(c)]
    got = {}
    for r in G.page_label_rules(spark.createDataFrame(rows, "book_id string, pno int, style string, number int")).collect():
        got.setdefault(r.book_id, []).append((r.startpage, r.style, r.firstpagenum))
    assert brute_labels(cases[0]) == [(0, "r", 1), (2, "D", 1)]
    assert all(sorted(got[str(k)]) == brute_labels(c) for k, c in enumerate(cases))


def test_boxes_and_bins(spark):
    from pyspark.sql import functions as F

    lit = lambda *v: [F.lit(float(x)) if x is not None else F.lit(None).cast("double") for x in v]
    one = spark.range(1).select(G.normal_box(*lit(10, 20, 60, 50, 100, 200)).alias("a"), G.normal_box(*lit(5, 5, 5, 9, 100, 100)).alias("b"), G.normal_box(*lit(-5, 0, 500, 9, 100, 0)).alias("c"), G.normal_box(*lit(None, 0, 5, 9, 100, 100)).alias("d"), G.upper_median(F.array(F.lit(4), F.lit(1), F.lit(3), F.lit(2))).alias("m")).first()
    assert tuple(one.a) == (100.0, 100.0, 600.0, 250.0) and one.b is None and one.c is None and one.d is None and one.m == 3
    rnd = random.Random(7)
    pts = [(i, rnd.choice("ab"), rnd.uniform(0, 1000)) for i in range(60)]
    box = [(i, rnd.choice("ab"), lo, lo + rnd.uniform(0, 300)) for i in range(25) for lo in [rnd.uniform(0, 900)]]
    p, b = spark.createDataFrame(pts, "i int, g string, y double"), spark.createDataFrame(box, "k int, g string, lo double, hi double")
    got = {(r.i, r.k) for r in G.binned_join(p, b, ["g"], F.col("y"), F.col("lo"), F.col("hi")).collect()}
    assert got == {(i, k) for i, g, y in pts for k, h, lo, hi in box if g == h and lo <= y <= hi}
    t = spark.createDataFrame([("a", i, 3) for i in range(3)], "g string, i int, n int")
    bx = spark.createDataFrame([("a", i, 7) for i in range(7)], "g string, b int, total int")
    spread = {}
    for r in G.proportional_boxes(t, bx, ["g"]).collect():
        spread.setdefault(r.i, []).append(r.b)
    assert {k: sorted(v) for k, v in spread.items()} == {0: [0, 1], 1: [2, 3], 2: [4, 5, 6]}
    rows = spark.sql("select array(named_struct('y', 1D), named_struct('y', 2D), named_struct('y', 2.4D), named_struct('y', 9D)) as a")
    assert rows.select(G.fold_rows(F.col("a"), 1.5).alias("r")).first().r == [0, 0, 0, 1]


def test_order_with_ties(spark):
    rows = [(k, "r", "b", 1, x, y, x + 10, y + 10) for k, (x, y) in enumerate([(5.0, 5.0), (5.0, 5.0), (0.0, 5.0), (9.0, 1.0)])]
    df = spark.createDataFrame(rows, "k long, run_id string, book_id string, pno int, x0 double, y0 double, x1 double, y1 double")
    assert {r.k: r.reading_order for r in G.reading_order(df, "k").collect()} == {3: 0, 2: 1, 0: 2, 1: 3}


# ---- matching


def test_align():
    md = "第一行文字\n第二行完全不同的文字"
    out = A.align(md, [{"text": "第一行文字", "x0": 1.0, "y0": 1.0, "x1": 9.0, "y1": 2.0, "header_footer": False}])
    assert [x["mode"] for x in out] == ["aligned", "fallback_capacity"] and {x["text"] for x in out} == set(md.split("\n"))
    spread = A.align("甲\n乙丙", [])
    assert all(x["order_exempt"] for x in spread) and "".join(x["text"] for x in spread) == "甲乙丙" and A.align("", []) == []


def test_at_least_is_the_ratio_above_the_bound():
    rnd = random.Random(8)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 9))) for _ in range(2))
        r = difflib.SequenceMatcher(None, a, b).ratio()
        got = A.at_least(a, b, 0.6)
        assert got == r if r >= 0.6 else got < 0.6


def test_gates(spark):
    line = "page int, k long, text string, y0 double, y1 double"
    want = spark.createDataFrame([(1, 1, "甲乙 丙", 400.0, 500.0), (2, 1, "甲乙丙", 400.0, 500.0), (2, 2, None, 1.0, 2.0)], line)
    have = spark.createDataFrame([(1, 1, "甲乙丙", 440.0, 460.0), (2, 1, "甲乙丙", 478.0, 498.0), (2, 2, "甲", 440.0, 460.0)], line)
    got = {r.page: (r.checked, r.passed) for r in A.position_gate(want, have, ["page"], "k").collect()}
    assert got == {1: (1, 1), 2: (1, 0)}
    assert A.matched_cells(["a", "b", "longer text"], ["b", "longer texts", "c"]) == 2 and A.matched_cells([], ["x"]) == 0
    assert A.without_exempt(["图", "abc", "def", ""], ["abcdef"], ["图"]) == ["图"]
    assert A.weighted_pieces("aa bb cc dd", [1, 1]) == ["aa bb", "cc dd"] and A.weighted_pieces("abc", [1, 1]) == ["abc"] and A.weighted_pieces("", [1, 2]) == [""]
    assert A.respaced("只有10毫秒", "只有 10毫秒") == "只有 10毫秒" and A.respaced("ab", "a c") == "ab"
    rows = [{"text": "甲乙", "x0": 0, "y0": 0, "x1": 9, "y1": 1}, {"text": "丙 丁", "x0": 0, "y0": 1, "x1": 5, "y1": 2}]
    assert [x["text"] for x in A.over_rows("甲乙丙丁戊", rows)] == ["甲乙", "丙丁戊"] and A.over_rows("xyz", rows) is None and A.over_rows("a", []) is None


# ---- tables and books

GRID = '<tr><td colspan="2">A B</td><th>C</th></tr><tr><td rowspan="2">R</td><td>x</td><td>y</td></tr><tr><td>p</td><td>q</td></tr>'


def test_grids(spark):
    assert TB.grid(GRID) == [["A B", "A B", "C"], ["R", "x", "y"], ["R", "p", "q"]]
    assert TB.grid(None) == [] and TB.grid("") == [] and TB.grid("plain") == [] and TB.grid("<TR><TD>a<TD>b") == [["a", "b"]]
    cells = ["$p^{\\prime}$", "\\text{x}_{1}", "\\mathrm{ab}", "", "\\multirow{2}{*}{塞音}"]
    assert [TB.latex_cell_text(c) for c in cells] == ["p'", "x1", "ab", "", "塞音"] == _col(spark, cells, TB.latex_cell)
    assert _col(spark, [GRID], lambda c: TB.grid_text(TB.table_grid(c))) == ["A B C\nR x y\nR p q"]
    assert _col(spark, ["| a | b |\n| --- | :-: |\n| c d |  |\nx", None], TB.markdown_cells) == [["a", "b", "cd"], None]


def test_book_matching(spark):
    rec = spark.createDataFrame([("a", "X.pdf", 10, 5), ("b", "y.pdf", 10, 5), ("c", None, None, None), ("d", "z.pdf", 7, None)], "book_id string, source_name string, source_size long, page_count int")
    probe = spark.createDataFrame([(1, "x.pdf", 10, 5), (2, "new.pdf", 10, 5), (3, None, None, None), (4, "q.pdf", 7, 1)], "probe int, source_name string, source_size long, page_count int")
    got = {r.probe: (r.status, r.quality, r.book_id, r.candidates) for r in B.match_sources(probe, rec, "probe").collect()}
    assert got == {1: ("bound", 3, "a", 1), 2: ("ambiguous", 2, None, 2), 3: ("not_found", 0, None, 0), 4: ("not_found", 0, None, 0)}
    new = spark.createDataFrame([("a", None, 6, "n"), ("e", 3, 1, "n")], "book_id string, source_size long, page_count int, created_at string")
    old = rec.selectExpr("*", "'o' as created_at")
    out = {r.book_id: r for r in B.updated_records(old, new).collect()}
    assert out["a"].page_count == 6 and out["a"].source_size == 10 and out["a"].created_at == "o" and out["e"].created_at == "n" and len(out) == 5
    state = {(r.book_id, r.field): r.state for r in B.compared(rec, new, "book_id", ["source_size", "page_count"]).collect()}
    assert state == {("a", "source_size"): "unknown", ("a", "page_count"): "diff"}


# ---- files and streams


def test_files(spark, tmp_path):
    from leafmill.sources import files as S

    d = tmp_path / "pages"
    d.mkdir()
    (d / "page_0002.md").write_text("二", "utf-8")
    (d / "page_0000.md").write_text("", "utf-8")
    (d / "page_x.md").write_text("no")
    (d / "page_0003.md").write_bytes(b"\xff\xfe\xfa")
    rows = {r.pno: (r.page_number, r.markdown) for r in S.read_pages(spark, str(d)).collect()}
    assert rows == {2: (3, "二")}
    assert sorted(r.pno for r in S.list_pages(spark, str(d)).collect()) == [2, 3]
    (tmp_path / "u.jsonl").write_text('{"pno_0based": "7", "status": "success"}\n\nnot json\n[1]\n{"pno_0based": "x", "total_tokens": 5}\n')
    got = [(r.line_no, r.pno_0based, r.status, r.total_tokens) for r in S.read_usage(spark, str(tmp_path / "u.jsonl")).orderBy("line_no").collect()]
    assert got == [(0, 7, "success", None), (4, None, None, 5)]
    (tmp_path / "a.json").write_text(json.dumps([{"page_idx": 0, "type": "text", "text": "x", "bbox": [-5, 0, 10, 2000]}]))
    both = S.read_layout(spark, str(tmp_path / "a.json"), str(tmp_path / "a.json")).orderBy("pno").collect()
    assert [(r.pno, r.x0, r.y1) for r in both] == [(0, 0.0, 1000.0), (200, 0.0, 1000.0)]
    assert [r.output for r in S.page_plan(spark, 3, 1).collect()] == ["page_0001.md", "page_0002.md"]
    with pytest.raises(ValueError):
        S.page_plan(spark, 3, 5)
    books = spark.createDataFrame([("a", "# A\n")], "book_id string, book string")
    S.write_books(books, str(tmp_path / "out"))
    assert "# A" in (tmp_path / "out" / "a-ocr.md").read_text()
    c = ['{"transcript_response":{"choices":[{"message":{"content":"hi"}}]},"text":"no"}', '{"text":"t"}', "x"]
    assert _col(spark, c, S.json_text) == ["hi", "t", None]
    assert S.base64_content(spark, str(d)).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    from leafmill.streaming import usage as ST

    rnd = random.Random(9)
    rows = [{"delivery_id": i, "received_at": f"2025-01-01T{rnd.randint(0, 23):02d}:00:00Z", "run_id": rnd.choice("ab"), "pno_0based": rnd.choice([None, 1, 2, 3]), "page_number": rnd.choice([None, 2]), "status": rnd.choice(["success", "FAILED"]), "attempt": 1, "total_tokens": i} for i in range(80)]
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"{k}.jsonl").write_text("\n".join(map(json.dumps, rows[k * 20 : k * 20 + 20])) + "\nbad\n")
    log = ST.stream_log(spark, str(tmp_path / "in"), 1)
    q = ST.latest_pages(log).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = spark.createDataFrame([(r["delivery_id"], r["received_at"], r["run_id"], r["pno_0based"], r["page_number"], r["status"], r["total_tokens"]) for r in rows], "delivery_id long, received_at string, run_id string, pno_0based int, page_number int, status string, total_tokens long").selectExpr("*", "cast(null as long) as duration_ms", "cast(null as boolean) as transient").withColumn("received_at", __import__("pyspark").sql.functions.to_timestamp("received_at"))
    want = {(r.run_id, r.page_key): r.delivery_id for r in U.latest_per_page(U.events(batch), ["run_id"], ["received_at", "delivery_id"], ["delivery_id"]).collect()}
    assert {(r.run_id, r.page_key): r.delivery_id for r in spark.table("latest").collect()} == want
    store = None
    for k in (2, 0, 3, 1, 1):
        store = ST.upsert_latest(batch.where(f"delivery_id >= {k * 20} and delivery_id < {k * 20 + 20}"), store)
    assert {(r.run_id, r.page_key): r.delivery_id for r in store.collect()} == want
    q = ST.messages_once(log).select("delivery_id").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    keys = {(r["run_id"], r["pno_0based"] if r["pno_0based"] is not None else r["page_number"] and r["page_number"] - 1, r["status"].lower()) for r in rows}
    assert spark.table("once").count() == len({k for k in keys if k[1] is not None})


def test_pages_without_lines_are_aligned_too(spark, data):
    got = {r.page_id: r for r in TC.j3_align_pages(spark, data).collect()}
    pages = spark.read.parquet(f"{data}/page_markdown.parquet").where("markdown is not null")
    bare = pages.join(spark.read.parquet(f"{data}/geom_line.parquet"), ["run_id", "book_id", "pno"], "left_anti").select("page_id").collect()
    assert bare and set(got) == {r.page_id for r in pages.select("page_id").collect()}
    assert all(got[r.page_id].aligned == 0 and got[r.page_id].aligned_coverage == (0.0 if got[r.page_id].total_chars else 1.0) for r in bare)


def test_page_like_of_every_line(spark, tmp_path):
    like = re.compile(r"(?i)[·.]\s*\d{1,4}\s*[·.]|[-–—]\s*\d{1,4}\s*[-–—]|\d{1,4}|PAGE\s*\d{1,4}|第\s*\d{1,4}\s*页|页\s*\d{1,4}")
    texts = ["· ８４ ·", "第 ５４ 页", "１２３４５", "12", "图 ８", "", None]
    spark.createDataFrame(list(enumerate(texts)), "line_key long, text string").write.parquet(f"{tmp_path}/geom_line.parquet")
    got = {r.line_key: r.page_like for r in INV.t19_page_like(spark, str(tmp_path)).collect()}
    assert got == {i: int(bool(like.fullmatch((t or "").strip()))) for i, t in enumerate(texts)} and sum(got.values()) == 3
