"""Look-alikes, noise, markup, cuts and mixing on small fixtures."""

import datetime as dt
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafmill.llm import cuts, lookalike, markup, mixing, noise, queries

SAME = [("kʰa", "k\u200bʰа"), ("ｋａ［", "ka["), ("a\u00a0b", "a b"), ("a\u0303", "ã"), ("ɡa", "ga"), ("⾳", "音"), ("non\u2011x", "non-x"), ("a\r\nb", "a\nb"), ("ǝ", "ə"), ("ε", "ɛ"), ("а\u0303", "ã")]
OTHER = [("ɑ", "a"), ("ɛ", "e"), ("ŋ", "n"), ("a⁵¹", "a51"), ("kʰ", "kh"), ("K", "k"), ("aː", "a"), ("ã", "a"), ("a  b", "a b"), ("²", "2"), ("…", "..."), ("a:", "aː")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert lookalike.visible(a) == lookalike.visible(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_other_look(a, b):
    assert lookalike.visible(a) != lookalike.visible(b)


def test_visible_is_stable():
    for a, b in SAME + OTHER:
        for t in (a, b):
            assert lookalike.visible(lookalike.visible(t)) == lookalike.visible(t)
            assert lookalike.search(lookalike.search(t)) == lookalike.search(t)
    assert lookalike.search("Straße") == lookalike.search("STRASSE")


def test_pairs_of_variants(spark):
    rows = [(1, "ka", "x"), (2, "kа", "x"), (3, "ka", "x"), (4, None, "x"), (5, "", "x"), (6, "", "x"), (7, "KA", "x"), (8, "ｋa", "x"), (9, "\u200b", "x"), (10, "k" * 50000, "x"), (None, "ka", None)]
    df = spark.createDataFrame(rows, "id long, t string, form string")
    got = {tuple(r) for r in lookalike.same_look_pairs(df, "id", "t").collect()}
    assert got == {(1, 2), (2, 3), (1, 8), (3, 8), (2, 8)}
    cls = {r.id: (r.class_id, r.spellings) for r in lookalike.variant_classes(df, "id", "t").collect()}
    assert cls[3] == (1, 3) and cls[6] == (5, 2) and 4 not in cls
    assert lookalike.same_look_pairs(df.limit(0), "id", "t").count() == 0


def test_search_classes_fold_case_and_form(spark):
    rows = [(1, "Straße 5"), (2, "STRASSE ５"), (3, "strasse ⁵"), (4, "straſſe 5"), (5, "ﬁn"), (6, "FIN"), (7, "İ"), (8, "i\u0307"), (9, None), (10, "other"), (11, "other")]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r.id: (r.class_id, r.spellings) for r in lookalike.variant_classes(df, "id", "t", lookalike.search_form).collect()}
    assert got == {**{i: (1, 4) for i in (1, 2, 3, 4)}, 5: (5, 2), 6: (5, 2), 7: (7, 2), 8: (7, 2), 10: (10, 1), 11: (10, 1)}


def test_letters_of_other_scripts():
    for a, b in (("ѡ", "w"), ("ո", "n"), ("⍺", "ɑ"), ("ν", "v"), ("ρ", "p"), ("ꓐ", "B"), ("Ꭺ", "A")):
        assert lookalike.visible(a) == b


def test_classes_of_both_tables(spark, data):
    got = {r.table_name: r.n for r in queries.p3_classes(spark, data).groupBy("table_name").agg(F.count_distinct("rec_id").alias("n")).collect()}
    for t, c in (("notation_case", "input"), ("page_markdown", "markdown")):
        assert got[t] == spark.read.parquet(f"{data}/{t}.parquet").where(f"{c} is not null").count(), t


# ---- noise


@pytest.mark.parametrize("text,page,yes", [("· 12 ·", 12, True), ("— l2 —", 12, True), ("PAGE 9", 9, True), ("第 88 页", 88, True), ("p. 4", 4, True), ("xiv", 14, True), ("第二十一页", 21, True), ("12", 13, False), ("F2 12 Hz", 12, False), ("图 12", 12, False)])
def test_page_number(text, page, yes):
    assert noise.is_page_number(text, page) is yes


def _pages(spark):
    body = ["The vowel precedes the consonant in the speech of speakers.", "The consonant and the vowel and the listeners follow the dental vowel.", "Listeners keep the long-term vowel. The dental consonant is kept."]
    rows = []
    for i in range(8):
        lines = ["The Dental Vowel of Karusi" if i % 2 else "THE DENTAL V0WEL OF KARUSI   %d" % (i + 1), "", *body, "短促的声带和声门都有声母和声带，声带，声门", "", "12", "", "more about the speech of vowels.", "", f"· {i + 1} ·"]
        rows.append((i, "b", i, "\n".join(lines)))
    rows.append((50, "b", 50, "The listeners keep the conso-\nnant and the long-\nterm dcntal vo\u00ad\nwe1.\r\n短促的芦带和声门\nthe spea�ers keep it"))
    rows.append((51, None, None, None))
    rows.append((52, None, None, ""))
    rows.append((53, "b", None, "the vowel�"))
    rows.append((None, None, 1, "no id"))
    return spark.createDataFrame(rows, "page_id long, book_id string, pno int, markdown string")


def test_noise(spark):
    df = _pages(spark)
    titles = spark.createDataFrame([("b", "The Dental Vowel of Karusi"), ("c", None)], "book_id string, title string")
    parts = [noise.lines_of_pages(df, "p", "page_id", "markdown")]
    found = noise.noisy_lines(parts, titles)
    got = {(r.rec_id, r.line_no, r.defect) for r in found.collect()}
    want = {(i, 1, "running") for i in range(8)} | {(i, 12, "pagenum") for i in range(8)}
    want |= {(50, 1, "hyphen"), (50, 3, "hyphen"), (50, 3, "misread"), (50, 4, "misread"), (50, 5, "misread"), (50, 6, "misread")}
    assert got == want
    clean = {r.page_id: r.clean for r in noise.repaired_pages(df, "p", "page_id", "markdown", found).collect()}
    assert "consonant and the long-term dental vowel." in clean[50] and "短促的声带" in clean[50] and clean[51] is None and clean[52] == ""
    assert "KARUSI" not in clean[0] and "· 1 ·" not in clean[0] and "\n12\n" in clean[0]
    empty = df.limit(0)
    assert noise.noisy_lines([noise.lines_of_pages(empty, "p", "page_id", "markdown")], titles).count() == 0


_BODY = [
    "the speech of the dental vowel and the nasal consonant", "the mouth and the tongue keep the acoustic breath", "they eat with the head", "the listener may hear the modern acoustic device", "the nasal vowel of the speech", "the breath of the dental consonant and the tongue",
]


def _corpus(spark, *lines):
    rows = [(i, "b", i, "\n".join(["x", *_BODY, "y"])) for i in range(12)] + [(90 + i, "b", 90 + i, f"x\n{line}\ny") for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "page_id long, book_id string, pno int, markdown string")
    titles = spark.createDataFrame([("c", "The Nasal Stop of Marble"), ("d", None)], "book_id string, title string")
    found = noise.noisy_lines([noise.lines_of_pages(df, "p", "page_id", "markdown")], titles).where("rec_id >= 90")
    return df, found


def test_real_words_and_lone_headings_stay(spark):
    df, found = _corpus(spark, "the cat sat on a bead", "The Nasal Drum of Marble", "The Nasal Stop of Marble")
    assert found.count() == 0
    lone = spark.createDataFrame([(1, "z", 0, "The Nasal Stop of Marble\n\nthe vowel\n\nthe end.")], df.schema)
    titles = spark.createDataFrame([("c", "The Dental Stop of Marble")], "book_id string, title string")
    assert noise.noisy_lines([noise.lines_of_pages(lone, "p", "page_id", "markdown")], titles).count() == 0


def test_common_misreadings_are_found(spark):
    wrong = {"tlie": "the", "voweI": "vowel", "sp3ech": "speech", "6reath": "breath", "acoustlc": "acoustic", "dentai": "dental", "nasaI": "nasal", "consoriant": "consonant", "speecb": "speech", "rnouth": "mouth", "t0ngue": "tongue", "tonque": "tongue", "modem": "modern", "devlce": "device", "lisfener": "listener", "dcvice": "device", "dentaI": "dental"}
    lines = ["the speech of tlie dental vowel", *(f"the {w} of the speech" for w in list(wrong)[1:])]
    _, found = _corpus(spark, *lines)
    got = {r.word: r.variant for r in found.where("defect = 'misread'").collect()}
    assert sum(got.get(w.lower()) == v for w, v in wrong.items()) >= 15, got


def test_heads_of_any_kind_that_recur(spark):
    rows = [(i, "b", i, f"Tone: an Outline\n\nthe vowel {i} of speech.\n\nmore {i}.") for i in range(6)] + [(9, "b", 9, "Tone: the Rest\n\nthe vowel.\n\nmore.")]
    df = spark.createDataFrame(rows, "page_id long, book_id string, pno int, markdown string")
    titles = spark.createDataFrame([("c", "The Dental Stop of Marble")], "book_id string, title string")
    got = {(r.rec_id, r.line_no, r.defect) for r in noise.noisy_lines([noise.lines_of_pages(df, "p", "page_id", "markdown")], titles).collect()}
    assert got == {(i, 1, "running") for i in range(6)}


def test_embedded_lines_become_paragraphs(spark):
    texts = ["THE DENTAL VOWEL", "The listeners keep the dcnso-", "nant and the vowel of", "all speakers.", "The plane tbe", "F1", "204"]
    rows = [(10 - k, "r", "b", 1, k, t, 90.0, 910.0 if k in (1, 2) else 400.0, 20.0 + 30 * k, 40.0 + 30 * k, 0, k - 5 if k > 4 else None) for k, t in enumerate(texts)]
    rows += [(20, None, "b", None, 0, "the vowel", None, None, None, None, None, None), (21, "r", "b", 2, 0, None, None, None, None, None, 0, None)]
    lines = spark.createDataFrame(rows, "line_key long, run_id string, book_id string, pno int, line_order int, text string, x0 double, x1 double, y0 double, y1 double, column_no int, cell_row int")
    found = spark.createDataFrame([("g", 10, "running", None, None), ("g", 9, "hyphen", "dcnsonant", None), ("g", 9, "misread", "dcnsonant", "consonant"), ("g", 6, "misread", "tbe", "the"), ("g", 6, "misread", "lane", "lone"), ("p", 8, "running", None, None)], "table_name string, rec_id long, defect string, word string, variant string")
    got = {(r.line_key, r.run_id, r.pno): (r.clean, r.n_defects) for r in noise.repaired_lines(lines, "g", "line_key", "text", ["run_id", "book_id", "pno"], ["line_order"], found).collect()}
    assert got == {(4, "r", 1): ("The listeners keep the consonant and the vowel of all speakers.\n\nThe plane the\n\nF1\n\n204", 5), (20, None, None): ("the vowel", 0)}


def test_both_tables_are_repaired(spark, data):
    got = queries.p1_clean(spark, data)
    pages = {(r.table_name, r.run_id, r.book_id, r.pno) for r in got.select("table_name", "run_id", "book_id", "pno").collect()}
    for t in ("page_markdown", "geom_line"):
        want = {(t, *r) for r in spark.read.parquet(f"{data}/{t}.parquet").select("run_id", "book_id", "pno").distinct().collect()}
        assert {p for p in pages if p[0] == t} == want
    lines = got.where("table_name = 'geom_line'")
    assert lines.count() == lines.select("run_id", "book_id", "pno").distinct().count() and lines.agg(F.sum("n_defects")).first()[0] > 0


# ---- markup

MARKUP = [
    ("<p align=center>x", {"html"}), ("a&nbsp;b", {"html"}), ("<!-- x", {"html"}), ("<TR><TD>a</TD>", {"html"}), ("## a", {"markdown"}), ("a\n===", {"markdown"}), ("| a | b |\n| --- | --- |", {"markdown"}),
    ("**a**", {"markdown"}), ("这是**重音**的。", {"markdown"}), ("这是__重音__的。", {"markdown"}), ("x**2 and y**3", set()), ("这里*音强*和音色对立", {"markdown"}), ("字*pa 和*ta", set()), ("a__b__c", set()), ("字*tʰa³³和*pa", set()), ("`<td>$x$</td>`", {"markdown"}), ("```\n<td>\n\\frac{a}{b}\n```", {"markdown"}), ("[a](b.md)", {"markdown"}), ("+ text", {"markdown"}), ("> quote", {"markdown"}), ("=== a ===", {"wiki"}),
    ("{{Note|x}}", {"wiki"}), ("[[a|b]]", {"wiki"}), ("''a''", {"wiki"}), ('{| class="x"\n|-\n| a || b\n|}', {"wiki"}), ("$F_{2}$", {"latex"}), ("\\textbf{a}", {"latex"}), ("\\(4 \\times 5\\)", {"latex"}), ("$[\\underset{w}{t}]$", {"latex"}),
    ("*kʰa and *pa are starred", set()), ("字母<gh>代表<th>", set()), ("F1 < 300 且 F2 > 200", set()), ("was $9 and later $22 & postage", set()), ("旧价 $8，新价 $10", set()), ("{i, u, a}", set()), ("[[tʰa³³]]", set()), ("V > 0 / _ #", set()),
    ("- 12 -", set()), ("· 4 ·", set()), ("[ 3 ]", set()), ("Item #7 is marked *", set()), ("", set()),
]


@pytest.mark.parametrize("text,want", MARKUP)
def test_markup_kinds(text, want):
    assert {k for k, *_ in markup.elements(text)} == want


def test_clean_text():
    assert markup.clean_text("<h2>a</h2><ul><li>b</li><li>c &lt;d&gt;</li></ul>") == "## a\n\n- b\n- c <d>"
    assert markup.clean_text("<table><tr><td>a<td>b</tr><tr><th>c</th><th>d</th></tr></table>") == "a | b\nc | d"
    assert markup.clean_text("{| class=x\n! a !! b\n|-\n| c || d\n|}") == "a | b\nc | d"
    assert markup.clean_text("\\section{a}\n\\begin{tabular}{ll}\na & b \\\\\nc & d \\\\ \\hline\n\\end{tabular}\n$F_{2}$ \\textit{x}") == "# a\n\na | b\nc | d\n\n$F_{2}$ x"
    assert markup.clean_text("**a** [b](c.md) `x*y`\n\n```\n<td>\n```\nV > 0 / _ #") == "a b x*y\n\n```\n<td>\n```\nV > 0 / _ #"
    assert markup.clean_text("{{Note|a}} [[b|c]] ''d'' [[kʰa]]") == "a c d [[kʰa]]"


def test_templates_are_cut(spark):
    rows = [(i, "h", f"<div>Home of the site | about</div>\ntext {i} <b>bold {i}</b>") for i in range(8)] + [(9, "g", "<div>Home of the site | about</div>"), (10, "h", None), (11, None, ""), (12, "h", "<table>" + "<tr><td>x" * 2000), (None, None, "<b>x</b>")]
    got = {r.id: r for r in markup.clean_texts(spark.createDataFrame(rows, "id long, host string, t string"), "id", "host", "t").collect()}
    assert got[3].clean == "text 3 bold 3" and got[3].n_template == 1 and got[3].kinds == ["html"]
    assert got[9].clean == "Home of the site | about" and got[10].clean is None and got[11].kinds == []


def test_subtrees_are_structural():
    def hashes(t):
        return [h for (_, n, _, _), h in zip(markup.elements(t), markup.subtree_hashes(t, markup.elements(t))) if n == "ul"]

    one = hashes('<ul class="a"><li>Home</li><li>About <a href="x.html">us</a></li></ul>')
    assert one == hashes('z <ul id=7 >\n<li>Home</li>\n<li class="on">About <a href="y.html">us</a></li></ul>')
    assert one != hashes("<ul><li>Home</li><li>About us</li></ul>") and one != hashes("<ul><li>About <a>us</a></li><li>Home</li></ul>")
    assert len(markup.subtree_hashes("", [])) == 0


def test_kinds_of_templates_are_told_apart(spark):
    rows = [(i, "h", f"<div>Home of the site | about</div>\n## text {i}") for i in range(8)]
    got = {(r.rec_id, r.kind, r.own) for r in markup.kinds(markup.element_rows(spark.createDataFrame(rows, "id long, host string, t string"), "id", "host", "t")).collect()}
    assert got == {(i, k, own) for i in range(8) for k, own in (("html", False), ("markdown", True))}


def test_recurring_cells_and_formulas_stay(spark):
    body = "<div>Home of the site | about</div><table><tr><td>affricate</td><td>$F_{2}$ and $$x_1 = y_1$$</td></tr></table>"
    got = markup.clean_texts(spark.createDataFrame([(i, "h", body) for i in range(8)], "id long, host string, t string"), "id", "host", "t").collect()
    assert {r.clean for r in got} == {"affricate | $F_{2}$ and $$x_1 = y_1$$"} and {r.n_template for r in got} == {1}


def test_both_tables_are_cleaned(spark, data):
    got = queries.p4_clean(spark, data)
    rows = {r.table_name: (r.n, r.texts) for r in got.groupBy("table_name").agg(F.count("*").alias("n"), F.count("clean").alias("texts")).collect()}
    for t, i, c in (("page_markdown", "page_id", "markdown"), ("layout_block", "block_id", "table_body")):
        df = spark.read.parquet(f"{data}/{t}.parquet")
        assert rows[t] == (df.count(), df.where(f"{c} is not null").count()), t
    assert not got.where("table_name = 'layout_block' and clean rlike '(?i)</?t[dhr]\\\\b'").count()
    assert queries.p4_templates(spark, data).columns == ["table_name", "host", "subtree", "n_pages"]


ODD = ["<td>x" * 20000, "{{a " * 20000, "[[" * 20000, "*a " * 20000, "`a" * 20001, "\\begin{a}" * 9000, "<code>" * 9000, "\\(a" * 9000, "-" * 50000, "| " + "a" * 100000, "- " * 30000, " " * 100000, "<a" + " " * 100000, "![" * 20000, "\u0303" * 50000]


def test_odd_texts_take_linear_time():
    began = time.time()
    for t in ODD:
        markup.elements(t)
        cuts.ending(t, 1)
        assert noise.title_shape(t) == "" and noise.is_page_number(t, 1) is False
        list(noise._page_lines("p")([pd.DataFrame({"rec_id": [1], "book_id": ["b"], "pno": [1], "text": [t]})]))
    assert time.time() - began < 60


# ---- cuts

ENDINGS = [("The vowel is short.", "stop"), ("参看附录。", "stop"), ("a b.\n\n## tongue", "label"), ("a b.\n\nF2 204 Hz", "closed"), ("a b.\n\n· 12 ·", "closed"), ("a b.\n\n[kʰa]", "closed"), ("a.\n\n$$\nx\n$$", "closed"), ("a.\n\n$$\nx = ", "open"), ("it was (", "open"), ("it was …", "sign"), ("it w�", "sign"), ("如果音节是短的，那么", "prose"), ("| a | b |\n| - | - |\n| c | d |", "closed"), ("| a | b |\n| - | - |\n| c |", "open"), ("", "empty")]


@pytest.mark.parametrize("text,state", ENDINGS)
def test_ending(text, state):
    assert cuts.ending(text, 1)[0] == state


def test_cuts(spark):
    whole = "The short vowel precedes the consonant of all speakers in this language.\n\nvowel"
    rows = [(i, "s", 1, whole) for i in range(6)] + [(10, "s", 1, "The short vowel pre"), (11, None, 1, "The short"), (12, "s", None, "The short vowel ends here."), (13, "s", 1, None), (14, "s", 1, ""), (15, None, 1, "The long\n\nThe"), (None, None, None, "The short vowel pre")]
    df = spark.createDataFrame(rows, "page_id long, source string, pno int, markdown string")
    tokens = spark.createDataFrame([(0, 18), (1, 18), (2, 18), (3, 18), (12, 90)], "page_id long, tokens long")
    got = {r.page_id: r.cut for r in cuts.cut_texts(df, "page_id", "markdown", "pno").collect()}
    assert {i for i, c in got.items() if c} == {10, 11, 15} and 13 not in got
    out = cuts.cut_texts(df, "page_id", "markdown", "pno", tokens)
    assert {r.page_id for r in out.where("cut").collect()} >= {10, 11, 15}
    share = {r.source: (r.texts, r.cut) for r in cuts.cut_share(df, "page_id", "source", cuts.cut_texts(df, "page_id", "markdown", "pno")).collect()}
    assert share == {"s": (9, 1), None: (2, 2)}
    assert cuts.cut_texts(df.limit(0), "page_id", "markdown", "pno", tokens).count() == 0


def test_tries_decide_first(spark):
    """A last word of any length is looked up; last tokens that go on everywhere are cut too."""
    long = "pneumono" * 6
    body = f"The {long}logy of the short vowel of speech is long.\n\nThe word {long}logy is of the short kind.\n\nThe tone of the short speaker is low."
    rows = [(i, "s", 1, body) for i in range(4)] + [(10, "s", 1, f"The word is the {long}"), (11, "s", 1, f"{body}\n\nAll of it, and a good deal more, is in the tone of the short"), (12, "s", 1, f"The word is the {long}…"), (13, "s", 1, f"The word is the {long}logy")]
    df = spark.createDataFrame(rows, "page_id long, source string, pno int, markdown string")
    got = {r.page_id: r.evidence for r in cuts.cut_texts(df, "page_id", "markdown", "pno").collect()}
    assert got[10] == got[12] == "word" and got[11] == "tokens_go_on" and got[0] is None and got[13] == "tokens_go_on"


def test_prefix_counts_against_plain_python(spark):
    words = {"vowel": 5, "vowels": 3, "voice": 2, "voiced": 7, "x" * 300: 1, "": 4}
    asked = ["vowel", "voi", "voiced", "zz", "x" * 120, "vowels and"]
    got = {r.key: (r.ends, r.goes_on) for r in cuts.prefix_counts(spark.createDataFrame(list(words.items()), "key string, n long"), spark.createDataFrame([(a,) for a in asked], "key string")).collect()}
    want = {a: (words.get(a, 0), sum(n for w, n in words.items() if w.startswith(a) and w != a)) for a in asked}
    assert got == {a: v for a, v in want.items() if v != (0, 0)}


# ---- mixing


def test_budget_runs_down_the_tree():
    leaves = [
        {"source": "a", "lang": "x", "tokens": 100, "repeats": 1}, {"source": "a", "lang": "y", "tokens": 300, "repeats": 1},
        {"source": "b", "lang": "x", "tokens": 10, "repeats": 2}, {"source": "b", "lang": None, "tokens": 0, "repeats": 2}, {"source": "c", "lang": "x", "tokens": 500, "repeats": 3},
    ]
    got = mixing.budget(leaves, ("source", "lang"), {("a",): 0.25, ("b",): 0.25, ("c",): 0.5}, 400)
    # b can give 20 of 100; the other 80 go to a and c by weight
    assert got[("b", "x")] == 20 and got[("b", None)] == 0 and abs(got[("c", "x")] - 800 / 3 * 0.95) < 1
    assert abs(sum(got.values()) - 400) < 1e-6 and abs(got[("a", "y")] / got[("a", "x")] - 3) < 1e-6
    # a shortage in a language goes to the other language of the source first
    got = mixing.budget(leaves[:2] + leaves[4:], ("source", "lang"), {("a",): 0.5, ("c",): 0.5, ("a", "x"): 0.8, ("a", "y"): 0.2}, 600)
    assert got[("a", "x")] == 100 and got[("a", "y")] == 200 and got[("c", "x")] == 300


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 7)
    day = dt.datetime(2025, 1, 1)
    rows = [(i, f"vowel {'short ' * (i % 9)}", "a" if i % 3 else "b", None if i % 5 == 0 else "en", day) for i in range(200)]
    rows += [(500, None, "a", "en", day), (501, "", "b", "en", day), (502, "left out", None, "en", day), (503, "left out", "z", "en", day), (1, "twice", "a", "en", day), (None, "no id", "a", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, rest timestamp")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    out = mixing.mix(df, "doc_id", "text", targets, total=900)
    got = out.collect()
    assert max(r.copies for r in got if r.source == "b") <= 3 and max(r.copies for r in got if r.source == "a") == 1 and {r.source for r in got} == {"a", "b"}
    share = {r.source: r for r in mixing.shares(out, targets).collect()}
    assert abs(share["a"].share - 5 / 9) < 0.03 and share["none"].tokens == 0 and 900 - 40 <= sum(r.tokens for r in share.values()) <= 900
    assert {r.doc_id for r in got} - set(range(200)) <= {None, 500, 501} and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(3), "doc_id", "text", targets, total=900).collect()), key=str)
    assert mixing.mix(df.limit(0), "doc_id", "text", targets).count() == 0


def test_queries_run(spark, data):
    for name in ("p1_found", "p3_found", "p4_found", "p6_found", "p8_shares"):
        assert queries.QUERIES[name](spark, data).count() >= 0, name
