"""Drifting schemas and repeated deliveries, against plain Python."""

import datetime as dt
import json
import random
from collections import defaultdict

from leafmill.operators import dedup, drift
from leafmill.plans import corpus

RAW = "stream_id string, file_seq int, file_name string, line_no int, rec_uid string, record string"


def _kind(v):
    return {bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object"}[type(v)]


def _text(v):
    return v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def brute_changes(rows):
    files = defaultdict(list)
    for stream, seq, _, _, uid, record in rows:
        files[stream, seq]
        try:
            o = json.loads(record)
        except (TypeError, ValueError):
            continue
        if isinstance(o, dict):
            files[stream, seq].append((uid, o))
    out = set()
    for stream in {s for s, _ in files}:
        seqs = sorted(q for s, q in files if s == stream)
        for a, b in zip(seqs, seqs[1:]):
            fa, fb = files[stream, a], files[stream, b]
            ka, kb = ({k for _, o in f for k in o} for f in (fa, fb))
            kinds = lambda f, k: {_kind(o[k]) for _, o in f if o.get(k) is not None}
            new, ren = defaultdict(dict), []
            for uid, o in fb:
                new[uid].update(o)
            for old in ka - kb:
                for come in kb - ka:
                    seen = [(o[old], new[u].get(come)) for u, o in fa if u is not None and u in new and o.get(old) is not None]
                    if seen and all(y is not None and _text(x) == _text(y) for x, y in seen):
                        ren.append((old, come))
            out |= {(stream, b, "renamed", x, y) for x, y in ren}
            out |= {(stream, b, "removed", x, "") for x in ka - kb - {x for x, _ in ren}}
            out |= {(stream, b, "added", y, "") for y in kb - ka - {y for _, y in ren}}
            for x, y in [(k, k) for k in ka & kb] + ren:
                p, q = kinds(fa, x), kinds(fb, y)
                if p and q and p != q:
                    out.add((stream, b, "type_changed", y, ""))
    return out


def test_changes_on_the_test_table(spark, data):
    raw = spark.read.parquet(f"{data}/usage_raw.parquet")
    rows = [tuple(r) for r in raw.select("stream_id", "file_seq", "file_name", "line_no", "rec_uid", "record").collect()]
    assert {tuple(r) for r in corpus.p2_found(spark, data).collect()} == brute_changes(rows)


def test_changes_in_odd_lines(spark):
    rows = [
        ("s", 1, "f", 1, "u1", '{"a":1,"b":"x","n":null}'),
        ("s", 1, "f", 2, "u2", '{"a":2,"b":"y"}'),
        ("s", 1, "f", 3, None, "[1,2]"),
        ("s", 1, "f", 4, None, None),
        ("s", 1, "f", 5, None, ""),
        ("s", 1, "f", 6, None, '{"zz":1} {"zy":2}'),
        ("s", 3, "f", 1, "u1", '{"a2":"1","b":"x","n":5}'),
        ("s", 3, "f", 2, "u3", '{"a2":"7","b":1.5}'),
        ("s", 4, "f", 1, None, "null"),
        ("s", 5, "f", 1, "u1", '{"b":{"c":1}}'),
        ("t", 1, "f", 1, "u1", '{"only":1}'),
    ]
    got = {tuple(r) for r in drift.schema_changes(spark.createDataFrame(rows, RAW)).collect()}
    assert got == brute_changes(rows)
    assert ("s", 3, "renamed", "a", "a2") in got and ("s", 3, "type_changed", "a2", "") in got and ("s", 4, "removed", "b", "") in got


def test_no_lines(spark):
    empty = spark.createDataFrame([], RAW)
    assert drift.schema_changes(empty).count() == 0
    assert drift.consistent_table(empty).columns == ["stream_id", "file_seq", "line_no", "rec_uid"]


def test_one_table(spark):
    rows = [("s", 1, "f", 1, "u", '{"a":1,"line_no":"x"}'), ("s", 2, "f", 1, "u", '{"b":"1","line_no":"x"}'), ("s", 2, "f", 2, "v", '{"b":"y","line_no":null}')]
    got = drift.consistent_table(spark.createDataFrame(rows, RAW)).orderBy("file_seq", "line_no")
    assert got.columns == ["stream_id", "file_seq", "line_no", "rec_uid", "a", "line_no_in_record"]
    assert [r.a for r in got.collect()] == ["1", "1", "y"]


LOG = "delivery_id long, received_at timestamp, run_id string, pno_0based int, page_number int, attempt int, status string, __k_run_id string"


def brute_surplus(rows):
    first = {}
    for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or dt.datetime.min, r[0])):
        page = r[3] if r[3] is not None else None if r[4] is None else r[4] - 1
        first.setdefault((r[2], page, r[5], r[6] and r[6].strip().lower()), r[0])
    return {r[0] for r in rows} - set(first.values())


def test_copies(spark):
    rnd = random.Random(4)
    day = dt.datetime(2025, 1, 1)
    rows = [
        (i, rnd.choice([None, day, day + dt.timedelta(hours=rnd.randint(1, 3))]), rnd.choice(["r", None, "q"]), rnd.choice([None, 1, 2]), rnd.choice([None, 2, 3]), rnd.choice([None, 1]), rnd.choice([None, "ok", " OK\t", "no", "　ok"]), "x")
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, LOG)
    got = {r[0] for r in dedup.surplus_copies(df, dedup.page_message_key(), [df.received_at], "delivery_id").collect()}
    assert got == brute_surplus(rows)
    kept = dedup.keep_first(df, dedup.page_message_key(), [df.received_at], "delivery_id")
    assert kept.columns == df.columns and {r[0] for r in kept.collect()} == {r[0] for r in rows} - got
    assert dedup.surplus_copies(df.limit(0), dedup.page_message_key(), [df.received_at], "delivery_id").count() == 0


def test_new_batch_adds_only_unknown_messages(spark):
    rows = [(1, None, "r", 1, None, 1, "ok", ""), (2, None, "r", None, 2, 1, "OK", ""), (3, None, None, 1, None, 1, "ok", ""), (4, None, None, 1, None, 1, "ok", "")]
    df = spark.createDataFrame(rows, LOG)
    key = dedup.page_message_key()
    stored = df.where("delivery_id = 1").select(*(c.alias(n) for n, c in key.items()))
    batch = df.where("delivery_id > 1").drop("__k_run_id")
    assert [r[0] for r in dedup.new_messages(batch, stored, key, [F_received()], "delivery_id").collect()] == [3]


def F_received():
    from pyspark.sql import functions as F

    return F.col("received_at")


def test_names_given_back_and_forth(spark):
    """a -> b -> c -> a in one stream is one column; another stream has a and b at once."""
    rows = [("s", k + 1, "f", 1, "u", '{"%s":7}' % n) for k, n in enumerate("abcab")]
    rows += [("t", 1, "f", 1, "u", '{"a":1,"b":2,"A":3}'), ("t", 2, "f", 1, "u", '{"a":1,"b":2,"A":3}')]
    raw = spark.createDataFrame(rows, RAW)
    alias = {(r.stream_id, r.field, r.first_seq): r.name for r in drift.aliases(raw).collect()}
    assert {alias["s", n, k + 1] for k, n in enumerate("abcab")} == {"a"} and alias["t", "b", 1] == "b"
    got = drift.consistent_table(raw)
    assert sorted(got.columns[4:]) == ["A", "a__2", "b"]
    assert sorted((r.stream_id, r.file_seq, r.a__2, r.b, r.A) for r in got.collect()) == [*(("s", k, 7, None, None) for k in range(1, 6)), ("t", 1, 1, 2, 3), ("t", 2, 1, 2, 3)]


def test_a_chain_of_many_renames(spark):
    n = 70
    rows = [("s", k, "f", 1, "u", '{"f%d":"v"}' % (n - k)) for k in range(n)]
    alias = drift.aliases(spark.createDataFrame(rows, RAW))
    assert {r.name for r in alias.collect()} == {f"f{n}"}


def test_an_old_name_given_anew(spark):
    """a goes on as b while a new a comes: two columns; both keep their values."""
    rows = [("s", 1, "f", 1, "u", '{"a":5}'), ("s", 2, "f", 1, "u", '{"b":5}'), ("s", 3, "f", 1, "u", '{"b":5,"a":"x"}'), ("s", 3, "f", 2, None, '{"b":null,"a":null}')]
    raw = spark.createDataFrame(rows, RAW)
    assert {(r.field, r.first_seq, r.name) for r in drift.aliases(raw).collect()} == {("a", 1, "a"), ("b", 2, "a"), ("a", 3, "a__2")}
    got = {(r.file_seq, r.line_no): (r.a, r.a__2) for r in drift.consistent_table(raw).collect()}
    assert got == {(1, 1): (5, None), (2, 1): (5, None), (3, 1): (5, "x"), (3, 2): (None, None)}


def test_catalogue(spark):
    rows = [("s", 1, "f", 1, "u", '{"a":1}'), ("s", 2, "f", 1, "u", '{"a":1.5}'), ("s", 4, "f", 1, "u", '{"z":null}'), ("s", 5, "f", 1, "u", '{"a":"x"}'), ("s", 5, "f", 2, "w", '{"a":2}')]
    got = {tuple(r) for r in drift.catalogue(spark.createDataFrame(rows, RAW)).collect()}
    assert got == {("s", "a", "integer", 1, 1), ("s", "a", "number", 2, 2), ("s", "z", "", 4, 4), ("s", "a", "integer string", 5, 5)}


def test_numbers_as_written(spark):
    rows = [("s", 1, "f", 1, "u", '{"a":200.0,"b":7,"c":12345678901234567890123,"d":1e2,"e":1.50,"f":-0,"g":{"y":1,"x":2}}')]
    got = {r.field: (r.kind, r.text) for r in drift.field_rows(spark.createDataFrame(rows, RAW)).collect()}
    assert got == {"a": ("number", "200.0"), "b": ("integer", "7"), "c": ("integer", "12345678901234567890123"), "d": ("number", "100.0"), "e": ("number", "1.5"), "f": ("integer", "0"), "g": ("object", '{"y":1,"x":2}')}
