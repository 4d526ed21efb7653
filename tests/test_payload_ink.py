"""Stored payloads and ink bands."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from leafmill.functions import payload as P
from leafmill.operators import ink as I
from tests.test_toolchain import brute_bands


def test_stored_text(spark):
    chat = {"transcript_response": {"choices": [{"message": {"content": "hi"}}]}, "text": "no"}
    deep = {"a": [{"text": "x"}, {"b": {"text": "y"}}, {"text": "x"}], "raw_stream": [{"text": "z"}], "transcript_response": {"choices": []}}
    assert P.stored_text(chat) == "hi" and P.stored_text(deep) == "x\ny" and P.stored_text({"content": "c"}) == "c" and P.stored_text([]) == ""
    rows = [(1, json.dumps(chat)), (2, "not json"), (3, None), (4, "[1]"), (5, json.dumps({"a": 1, "api_key": "k", "b": {"note": "sk-abcdefghij", "x": [1]}}))]
    df = spark.createDataFrame(rows, "k int, t string")
    got = {r.k: r for r in df.select("k", P.stored_text_of("t").alias("s"), P.public_json("t").alias("p"), P.dropped_secrets("t").alias("d")).collect()}
    assert [got[k].s for k in range(1, 6)] == ["hi", None, None, "", ""]
    assert json.loads(got[5].p) == {"a": 1, "b": {"x": [1]}} and got[5].d == ["api_key", "b.note"] and got[3].d is None


def test_response_shapes():
    assert P.response_text({"output": [{"content": [{"type": "output_text", "text": "a"}, {"type": "x", "text": "no"}]}, {"text": "b"}, 3]}) == "a\nb"
    assert P.response_text({"content": [{"type": "text", "text": "a"}]}) == "a" and P.response_text({"content": " a "}) == "a"
    assert P.response_text({"choices": [{"message": {"content": [{"text": "a"}, {"text": "b"}]}}]}) == "ab" and P.response_text({"output_text": "o"}) == "o" and P.response_text(None) == ""


def test_names_and_errors(spark):
    df = spark.createDataFrame([(" /v1/Messages", "300", 429, None), (None, "x", None, " <HTML>"), ("Responses", "60", 503, ""), ("", "72", None, None)], "e string, d string, s int, m string")
    got = df.select(P.endpoint(df.e).alias("e"), P.resolution(df.d).alias("d"), P.error_class(df.s, df.m).alias("c")).collect()
    assert [tuple(r) for r in got] == [("messages", 300, "RATE_LIMITED"), ("chat", None, "BAD_GATEWAY_HTML"), ("responses", None, "GATEWAY_5XX"), ("chat", 72, "TIMEOUT")]


def test_ink():
    rnd = random.Random(4)
    for _ in range(300):
        c = [rnd.choice([0, 0, 5]) for _ in range(rnd.randint(0, 15))]
        assert set(I.bands(np.array(c), 2, 1, 1, 6)) == brute_bands(c, 2, 1, 1, 6)
    page = np.full((200, 300), 255, np.uint8)
    page[20:30, 50:250] = 0
    page[60:70, 50:120] = 0
    page[60:70, 200:280] = 0
    raw = page.tobytes()
    assert I.line_boxes(raw, 300, 200) == [[166.67, 100.0, 833.33, 150.0], [166.67, 300.0, 933.33, 350.0]]
    assert len(I.line_boxes(raw, 300, 200, columns=True)) == 3 and I.line_boxes(raw, 10, 10) == [] and I.line_boxes(b"", 0, 0) == []
    laid = I.lay_on_bands(["aa bb", "", "cc"], [[0, 0, 100, 10], [0, 20, 100, 30], [0, 40, 100, 240]])
    assert [x["text"] for x in laid] == ["aa bb", "cc"] and I.lay_on_bands([], [[0, 0, 1, 1]]) == []
    assert max(x["y1"] - x["y0"] for x in I.lay_on_bands(["a", "b", "c"], [[0, 0, 100, 10], [0, 20, 100, 30], [0, 40, 100, 240]])) == 25.0


def test_ink_columns(spark):
    page = np.full((50, 60), 255, np.uint8)
    page[10:20, 5:50] = 0
    df = spark.createDataFrame([(bytearray(page.tobytes()), 60, 50, "one line"), (None, None, None, None)], "g binary, w int, h int, t string")
    got = df.select(I.ink_boxes("g", "w", "h").alias("b"), "t").select("b", I.laid_lines("t", "b").alias("l")).collect()
    assert len(got[0].b) == 1 and got[0].l[0].text == "one line" and got[1].b == [] and got[1].l == []
    lit = lambda *v: [F.lit(x).cast("double") for x in v]
    turned = {t: spark.range(1).select(I.rotated_box(*lit(10, 20, 30, 25), F.lit(t), *lit(100, 200, 0, 0)).alias("b")).first().b for t in (0, 90, 180, 270, 45)}
    assert tuple(turned[90]) == (175.0, 10.0, 180.0, 30.0) and tuple(turned[180]) == (70.0, 175.0, 90.0, 180.0) and tuple(turned[270]) == (20.0, 70.0, 25.0, 90.0) and turned[45] is None
