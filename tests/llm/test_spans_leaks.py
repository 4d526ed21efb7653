"""Shared spans and leaked items against brute force."""

import random
import unicodedata

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import leaks, queries, rolling, spans


def brute_pairs(texts, span):
    seen = {}
    for i, t in texts:
        for a in range(len(t) - span + 1):
            seen.setdefault(t[a : a + span], set()).add(i)
    return {(x, y) for s in seen.values() for x in s for y in s if x < y}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab字🙂", max_size=60), max_size=5), st.integers(2, 8), st.integers(1, 9))
def test_winnowing_takes_one_place_of_every_reach(texts, k, w):
    cp, starts = rolling.joined(texts)
    p, h = rolling.winnow(cp, starts, k, w)
    taken = {(int(np.searchsorted(starts, x, side="right")) - 1, int(x)) for x in p}
    words = {}
    for x, v in zip(p, h):
        assert words.setdefault(int(v), "".join(map(chr, cp[x : x + k]))) == "".join(map(chr, cp[x : x + k]))
    for i, t in enumerate(texts):
        lens = [len(x) for x in texts[:i]]
        for a in range(len(t) - (k + w - 1) + 1):
            assert any((i, sum(lens) + b) in taken for b in range(a, a + w)) or not t


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, h long, pos int")


def test_spans_of_odd_texts(spark):
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("abcdefgh字音🙂") for _ in range(n))
    a, b, c = word(200), word(199), word(260)
    texts = [(1, word(50) + a + word(30)), (2, a), (3, b + word(50)), (4, b), (5, c + c), (6, word(9) + c), (7, "x" * 700), (8, "x" * 250 + "y"), (9, ""), (10, a), (11, "z" * 199), (12, "x" * 199)]
    texts += [(20 + i, f"{i:04d}" + c[:230] + f"{i:05d}") for i in range(45)]  # more than are compared directly
    texts += [(100 + i, f"{i:04d}" + b[:190] + f"{i:05d}") for i in range(40)]  # hot, and too short
    df = _docs(spark, [(i, t, 0, 0) for i, t in texts] + [(13, None, 0, 0), (None, a, 0, 0)])
    got = {tuple(r) for r in spans.sharing_pairs(df, "doc_id", "text").collect()}
    want = brute_pairs(texts, 200)
    assert got == want and (7, 8) in got and (2, 10) in got and (3, 4) not in got
    members: dict = {}
    for r in spans.sharing_classes(df, "doc_id", "text").collect():
        members.setdefault(r.class_id, set()).add(r.doc_id)
        assert r.docs > 1
    assert {(x, y) for m in members.values() for x in m for y in m if x < y} == want and len({frozenset(m) for m in members.values()}) == len(members)
    part = {r.doc_id: r for r in spans.shared_parts(df, "doc_id", "text").collect()}
    assert part[2].shared_chars == 200 and part[2].share == 1.0 and part[3].shared_chars == 0 and part[9].share == 0.0
    assert part[8].shared_chars == 250 and part[7].shared_chars == 700
    assert spans.sharing_pairs(df.limit(0), "doc_id", "text").count() == 0


def test_a_long_home_is_split(spark):
    """One text of two million characters whose parts recur elsewhere: no shard beyond its bound, the same pairs."""
    rnd = random.Random(3)
    long = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz字音", k=2_000_000))
    parts = [(2 + k, long[k * 40_000 : (k + 1) * 40_000]) for k in range(50)]
    df = _docs(spark, [(1, long, 0, 0), *((i, t, 0, 0) for i, t in parts)])
    texts = spans._texts(df, "doc_id", "text", spans.SPAN)
    found = spans.shards(texts.mapInPandas(spans._marks(spans.SPAN, spans.PHRASE), "doc long, part long, pos int, h long"))
    sizes = [r["count"] for r in found.groupBy("shard").count().collect()]
    assert sum(sizes) > 40_000 and max(sizes) <= spans.SHARD_PASSAGES and found.groupBy("home").count().count() == 1
    assert {tuple(r) for r in spans.sharing_pairs(df, "doc_id", "text").collect()} == {(1, i) for i, _ in parts}


def test_rows_of_one_id_with_other_texts(spark):
    rnd = random.Random(4)
    a, b = ("".join(rnd.choices("abcdefgh", k=300)) for _ in range(2))
    df = _docs(spark, [(1, a, 0, 0), (1, b, 0, 0), (1, a, 0, 0), (2, "x" + b, 0, 0), (3, a + "y", 0, 0)])
    assert {tuple(r) for r in spans.sharing_pairs(df, "doc_id", "text").collect()} == {(1, 2), (1, 3)}


def test_spans_of_the_test_table(spark, data):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect() if r.text]
    assert {tuple(r) for r in queries.p9_found(spark, data).collect()} == brute_pairs(texts, 200)


def letters(t):
    return "".join(c for c in unicodedata.normalize("NFKC", t).lower() if c.isalnum())


def brute_leaks(items, docs):
    grams = {}
    for i, t in items:
        t = letters(t)
        for a in range(len(t) - 59):
            grams.setdefault(t[a : a + 60], set()).add(i)
    out = set()
    for d, t in docs:
        t = letters(t)
        for a in range(len(t) - 59):
            out |= {(i, d) for i in grams.get(t[a : a + 60], ())}
    return out


def test_leaks_of_the_test_table(spark, data):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/eval_item.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect() if r.text]
    got = {tuple(r) for r in queries.p7_found(spark, data).collect()}
    assert got and got == brute_leaks(items, docs)


def test_leaks_of_odd_texts(spark, monkeypatch):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("abcdefghijklmn字音") for _ in range(n))
    items = [(i, word(rnd.randint(55, 110))) for i in range(30)] + [(90, ""), (91, None), (92, "x" * 80)]
    docs = []
    for d in range(60):
        i = items[d % 30][1]
        a, n = rnd.randint(0, max(0, len(i) - 59)), rnd.choice([58, 59, 60, 61, 75])
        part = i[a : a + n]
        docs.append((d, word(rnd.randint(0, 40)) + " ".join(part.upper()) + "!" + word(5)))
    docs += [(100, ""), (101, None), (102, "x" * 500), (103, "ｘ" * 60), (104, "x" * 59)]
    di = spark.createDataFrame(items, "item_id long, text string")
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_leaks([x for x in items if x[1]], [x for x in docs if x[1]])
    for most in (10**6, 200):  # one scan, several scans
        monkeypatch.setattr(leaks, "PASS_WINDOWS", most)
        found = leaks.leaked_items(di, "item_id", "text", dd, "doc_id", "text")
        assert {(r.item_id, r.doc_id) for r in found.where("run >= 60").collect()} == want
    assert leaks.leaked_items(di.limit(0), "item_id", "text", dd, "doc_id", "text").count() == 0
    assert leaks.leaked_items(di, "item_id", "text", dd.limit(0), "doc_id", "text").count() == 0
    assert leaks.shingle_similarity("abcdefg", "abcdefg") == 1.0 and leaks.shingle_similarity("abcdefg", "tuvwxyz") == 0.0


def test_many_equal_items_and_a_run(spark):
    items = [(i, "x" * 80) for i in range(2000)] + [(5000 + i, "the same stock sentence that opens every single item of the suite number " + "abcdefghij"[i % 10] * (5 + i)) for i in range(60)]
    docs = [(1, "x" * 200_000), (2, "the same stock sentence that opens every single item of the suite number zz"), (3, "x" * 59)]
    found = leaks.leaked_items(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    got = {(r.item_id, r.doc_id) for r in found.where("run >= 60").collect()}
    assert got == {(i, 1) for i in range(2000)} | {(5000 + i, 2) for i in range(60)}
