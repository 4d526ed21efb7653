"""Rows, columns and plans of physical lines."""

from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.operators import layout as L
from leafmill.plans import toolchain


def box(x0, y0, x1, y1, text=""):
    return {"x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y1), "text": text}


def test_columns_by_votes(spark):
    table = [box(10, 10, 900, 20)] + [box(x, y, x + 80, y + 10) for y in (40, 70, 100) for x in (10, 300, 600)]
    stray = [box(0, 0, 40, 10), box(0, 40, 40, 50), box(100, 40, 140, 50), box(120, 40, 125, 50), box(0, 80, 40, 90), box(100, 80, 140, 90)]
    wide = [box(0, 0, 40, 10), box(0, 40, 40, 50), box(60, 41, 400, 51), box(300, 42, 340, 52)]
    groups = {"t": table, "one": table[:1], "stray": stray, "wide": wide, "twice": [*table, *table]}
    rows = [(k, i, b["x0"], b["y0"], b["x1"], b["y1"]) for k, bs in groups.items() for i, b in enumerate(bs)]
    df = spark.createDataFrame(rows, "g string, i int, x0 double, y0 double, x1 double, y1 double")
    got = {r.g: [tuple(c) for c in r.columns] for r in L.table_columns(df, ["g"], "i").collect()}
    assert got["t"] == [(10.0, 90.0), (300.0, 380.0), (600.0, 680.0)] and got["one"] == [] and got["stray"] == [(0.0, 40.0), (100.0, 140.0)]
    assert len(got) == 5 and L.table_columns(df.limit(0), ["g"], "i").count() == 0


def test_rows_and_columns():
    table = [box(10, 10, 900, 20)] + [box(x, y, x + 80, y + 10) for y in (40, 70, 100) for x in (10, 300, 600)]
    assert [len(r) for r in L.rows_by_mean(table)] == [1, 3, 3, 3]
    lines = L.merge_same_line([box(0, 10, 50, 20, "a"), box(55, 10, 90, 21, "b"), box(300, 10, 320, 20, "c"), box(0, 40, 9, 50, "d")])
    assert [x["text"] for x in lines] == ["ab", "c", "d"]
    cells = L.cells_of([box(0, 0, 1, 2) | {"column_no": 0}, box(9, 0.5, 10, 2.5) | {"column_no": 1}, box(0, 9, 1, 11) | {"column_no": 0}])
    assert [(c["cell_row"], c["cell_col"]) for c in cells] == [(0, 0), (0, 1), (1, 0)]


@settings(max_examples=80, deadline=None)
@given(st.text("ab 字音\n", min_size=1, max_size=60), st.floats(5, 400), st.floats(5, 60))
def test_plans_lose_nothing(text, w, h):
    plan, _ = L.physical_lines([box(10, 10, 10 + w, 10 + h, text)])
    assert "".join("".join(p["text"] for p in plan).split()) == "".join(text.split())
    assert all(p["size"] >= 1.0 and 10 <= p["y_center"] <= 10 + h + 1 for p in plan)
    assert "".join(L.wrapped(text, 10, w)) == text


def test_sizes_and_special_lines():
    assert L.fitted_size("字" * 10, 10, 100) <= 10.0 and L.fitted_size("字", 10, 1000) == 16.0 and L.fitted_size("字" * 99, 10, 100) == L.SMALLEST
    plan, over = L.physical_lines([box(0, 0, 20, 200, "Frequency (Hz)"), box(0, 0, 10, 10, "$$" + "x" * 90 + "$$"), box(0, 0, 5, 5, None) | {"text": None}])
    assert plan[0]["rotated"] and plan[1]["text"].startswith("$$") and over == 1 and plan[2]["text"] == ""
    units = L.equation_units([box(455, 130, 460, 140, "$$"), box(470, 130, 480, 140, "清浊"), box(500, 130, 510, 140, "$$"), box(0, 0, 9, 9, "out")], [box(450, 128, 525, 152)])
    assert units[-1]["text"] == "$$清浊$$" and (units[-1]["y0"] + units[-1]["y1"]) / 2 == 140 and units[0]["text"] == "out"
    assert L.page_numbers([3, 4], [1], 2) == [3, 4] and L.page_numbers(None, [100], 1) == [100] and L.page_numbers(None, [5], 3) == [0, 1, 2] and L.page_numbers(None, ["x", 4], 1) == [4]
    assert L.table_gate(["a", "b"], "") == (2, 0, 0.0, 0.0) and L.table_gate(["ab", "c"], "a b c")[1:] == (2, 1.0, 1.0)
    assert L.script_runs("ab字ɕ字") == [("latin", "ab"), ("han", "字"), ("ipa", "ɕ"), ("han", "字")] and L.script_runs("") == [] and L.script_runs("a→■") == [("latin", "a"), ("symbol", "→■")]


def test_cells_on_rows():
    from leafmill.operators import refine as R

    printed = [box(100, 60, 500, 70, "caption"), box(100, 100, 150, 110, "a"), box(300, 100, 340, 110, "雪"), box(100, 121, 150, 131, "b"), box(310, 120, 330, 130, "c"), box(305, 118, 335, 148, "，"), box(0, 900, 9, 910, "other")]
    cols = [(100.0, 150.0), (300.0, 340.0)]
    got = R.cells_on_rows([["A", "p"], ["B", "C"]], printed, cols, 95.0, 135.0, "表 1")
    assert [(c["cell"], c["text"]) for c in got] == [("caption", "表 1"), ("t0c0", "A"), ("t0c1", "p"), ("t1c0", "B"), ("t1c1", "C")]
    assert (got[0]["y0"], got[0]["x1"]) == (60.0, 500.0) and (got[4]["x0"], got[4]["x1"], got[4]["y1"] - got[4]["y0"]) == (310.0, 330.0, 10.0)
    merged = R.cells_on_rows([["A", "A"], ["B", ""]], printed, cols, 95.0, 135.0)
    assert [(c["cell"], c["x0"], c["x1"]) for c in merged] == [("t0c0", 100.0, 340.0), ("t1c0", 100.0, 150.0)]
    for grid, p, c in (([["A"]], printed, cols), ([["A", "B"], ["C"]], printed, cols), ([["", ""]], printed, cols), ([["A", "B"], ["C", "D"]], [], cols), ([["A", "B"], ["C", "D"]], printed, [])):
        assert R.cells_on_rows(grid, p, c, 95.0, 135.0) is None
    wider = R.cells_on_rows([["A", "x", "y"], ["B", "C", "D"]], printed, [(100.0, 150.0), (160.0, 340.0)], 95.0, 135.0)
    assert len(wider) == 6 and wider[2]["x1"] <= 340.0


def test_refined_blocks_lose_nothing(spark, data):
    from leafmill.plans import inventory

    got = inventory.n9_refined_blocks(spark, data).collect()
    ids = {r.block_id for r in spark.read.parquet(f"{data}/layout_block.parquet").select("block_id").collect()}
    assert {r.block_id for r in got} == ids and all(r.n == 0 and r.fragment == "" for r in got if r.how == "whole")
    assert len({(r.block_id, r.fragment) for r in got}) == len(got)


def test_pages(spark, data):
    assert toolchain.n6_page_plans(spark, data).count() > 0 and toolchain.w10_table_columns(spark, data).count() > 0
    df = spark.createDataFrame([(1, ["e"], None, ["m"]), (2, None, [], ["m"]), (3, None, None, None)], "k int, external array<string>, ink array<string>, embedded array<string>")
    assert {r.k: r.reason for r in L.routed(df, ["k"]).collect()} == {1: "external", 2: "embedded", 3: "fallback"}
