"""Long exact spans that records share.

1. Winnowing marks phrases of PHRASE code points in every document, so that any shared span of SPAN code points holds a
   phrase marked in both documents; phrases marked in two documents or more are the confirmed recurring passages.
2. The passages are compiled into sharded Aho-Corasick automata; the documents holding a passage of a shard are streamed
   through its automaton, which locates every occurrence, with as much text on both sides as a span can reach.
3. Occurrences of one passage are held against each other on that text. Passages with many occurrences are split by the
   exact SPAN-long windows first, so that only documents that do share a span ever meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm import rolling
from leafmill.runtime import materialize

SPAN = 200
#: code points of a phrase; SPAN - PHRASE + 1 successive phrases are a winnowing window. Longer: fewer false candidates, more marks
PHRASE = 120
#: passages in an automaton (some 80 bytes a character), documents that one automaton is built for
SHARD_PASSAGES, SHARD_DOCS = 3000, 20_000
#: code points of a document whose passages may go to one shard: half as many passages as one holds, on average
SHARD_REACH = 50_000
#: occurrences up to which those of a passage are compared directly; above, exact windows part them first
DIRECT = 32
#: document ids that may be broadcast (8 bytes each)
BROADCAST_IDS = 500_000


def _marks(span: int, phrase: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cp, starts = rolling.joined(b["text"].tolist())
            p, h = rolling.winnow(cp, starts, phrase, span - phrase + 1)
            row = np.searchsorted(starts, p, side="right") - 1
            out = pd.DataFrame({"doc": b["doc"].to_numpy()[row], "part": b["part"].to_numpy()[row], "pos": (p - starts[row]).astype("int32"), "h": h.view(np.int64)})
            yield out

    return run


def _texts(docs: DataFrame, row_id: str, text: str, span: int) -> DataFrame:
    return docs.select(F.col(row_id).alias("doc"), F.xxhash64(text).alias("part"), F.col(text).alias("text")).where((F.length("text") >= span) & F.col("doc").isNotNull())


def _cut_out(phrase: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text, at in zip(b["text"], b["at"]):
                for i in range(0, len(at), 20_000):
                    rows = [(x["shard"], x["h"], text[x["at"] : x["at"] + phrase]) for x in at[i : i + 20_000]]
                    yield pd.DataFrame(rows, columns=["shard", "h", "text"])

    return run


def _locate(margin: int, every: bool):
    """Rows (shard, salt, of, key, text): passages (of = 0, key: hash) come first in their shard, then documents (of = 1, key: id)."""

    def table(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["h", "doc", "pos", "before", "after"]).astype({"h": "int64", "doc": "int64", "pos": "int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, auto, built = None, None, False
        for b in batches:
            rows = []
            for shard, salt, of, key, text in zip(b["shard"], b["salt"], b["of"], b["key"], b["text"]):
                if (shard, salt) != at:
                    at, auto, built = (shard, salt), ahocorasick.Automaton(), False
                if of == 0:
                    auto.add_word(text, (key, len(text)))
                    continue
                if not built:
                    auto.make_automaton()
                    built = True
                if not len(auto):
                    continue
                seen = set()
                for end, (phrase, n) in auto.iter(text):
                    a = end - n + 1
                    one = (phrase, text[max(0, a - margin) : a], text[end + 1 : end + 1 + margin])
                    if every or one not in seen:  # to pairs, a text that repeats itself has no more to say
                        seen.add(one)
                        rows.append((phrase, key, a, one[1], one[2]))
                        if len(rows) >= 20_000:
                            yield table(rows)
                            rows = []
            yield table(rows)

    return run


def shards(marks: DataFrame) -> DataFrame:
    """(h, home, home_part, at, shard): the recurring passages, each with a document and place it stands in.

    Passages that are near each other in their home go to one shard, so that a document meets few; no shard has more than
    SHARD_PASSAGES, however many a document has. marks: doc, part, pos, h.
    """
    found = marks.groupBy("h").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min(F.struct("doc", "part", "pos")).alias("at")).where("low < high")
    found = materialize(found.select("h", F.col("at.doc").alias("home"), F.col("at.part").alias("home_part"), F.col("at.pos").alias("at")), "found")
    n = max(1, -(-found.count() // SHARD_PASSAGES))
    near = found.withColumn("bucket", F.pmod(F.xxhash64("home", "home_part", F.floor(F.col("at") / SHARD_REACH)), F.lit(n)))
    w = Window.partitionBy("bucket").orderBy("home", "home_part", "at", "h")
    shard = F.col("bucket") + n * F.floor((F.row_number().over(w) - 1) / SHARD_PASSAGES)
    return near.withColumn("shard", shard.cast("long")).drop("bucket")


def occurrences(docs: DataFrame, row_id: str, text: str, span: int = SPAN, phrase: int = PHRASE, every: bool = True) -> DataFrame:
    """(h, doc, pos, before, after): every occurrence of every recurring passage, with its surroundings.

    every = False: of occurrences of one document with equal surroundings one is enough.

    Null texts and texts shorter than `span` hold none, nor do rows without an id. Row ids are long; rows with one id count as one document.
    """
    texts = _texts(docs, row_id, text, span)
    marks = materialize(texts.mapInPandas(_marks(span, phrase), "doc long, part long, pos int, h long"), "marks")
    passages = materialize(shards(marks), "passages")
    wanted = materialize(marks.join(passages.select("h", "shard"), "h").select("doc", "part", "shard").distinct(), "wanted")
    ids = wanted.select("doc").distinct()
    holders = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc", "left_semi")
    holders = materialize(holders, "holders")

    salts = wanted.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_DOCS).cast("int").alias("salts"))
    # a home's places are fewer than its characters; cut out in one pass over its text
    at = passages.groupBy(F.col("home").alias("doc"), F.col("home_part").alias("part")).agg(F.collect_list(F.struct("shard", "h", "at")).alias("at"))
    # rows that repeat an id and a text give their passage once
    first = at.join(holders, ["doc", "part"]).select("text", "at").mapInPandas(_cut_out(phrase), "shard long, h long, text string").groupBy("shard", "h").agg(F.min("text").alias("text"))
    first = first.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("of"), F.col("h").alias("key"), "text")
    second = wanted.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("salts")).cast("int"))
    second = second.join(holders, ["doc", "part"]).select("shard", "salt", F.lit(1).alias("of"), F.col("doc").alias("key"), "text")
    rows = first.union(second).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "of")
    return materialize(rows.mapInPandas(_locate(span - phrase, every), "h long, doc long, pos int, before string, after string"), "occurrences")


def _windows(occ: DataFrame, span: int, phrase: int) -> DataFrame:
    """(h, a, w, doc, begin): the span-long windows around occurrences, a code points of them before the passage."""
    margin = span - phrase
    wide = occ.select("h", "doc", "pos", "before", "after", F.explode(F.sequence(F.greatest(F.lit(0), margin - F.length("after")), F.least(F.lit(margin), F.length("before")))).alias("a"))
    # the passage itself is equal where h is
    w = F.xxhash64("h", "a", F.expr("right(before, a)"), F.lit(0), F.expr(f"left(after, {margin} - a)"))
    return wide.select("h", "a", w.alias("w"), "doc", (F.col("pos") - F.col("a")).alias("begin"))


def sharing_pairs(docs: DataFrame, row_id: str, text: str, span: int = SPAN, phrase: int = PHRASE) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents that share at least `span` successive code points. Not expanded: none."""
    occ = occurrences(docs, row_id, text, span, phrase, every=False)
    margin = span - phrase
    sizes = occ.groupBy("h").agg(F.count("*").alias("n"))
    few, many = (occ.join(sizes.where(cond).select("h"), "h", "left_semi") for cond in (f"n <= {DIRECT}", f"n > {DIRECT}"))
    a = few.select("h", F.col("doc").alias("doc_id_a"), F.col("before").alias("b1"), F.col("after").alias("a1"))
    b = few.select("h", F.col("doc").alias("doc_id_b"), F.col("before").alias("b2"), F.col("after").alias("a2"))
    reach = F.expr(
        f"exists(sequence(0, {margin}), a -> length(b1) >= a and length(b2) >= a and length(a1) >= {margin} - a and length(a2) >= {margin} - a"
        f" and right(b1, a) = right(b2, a) and left(a1, {margin} - a) = left(a2, {margin} - a))"
    )
    direct = a.join(b, "h").where("doc_id_a < doc_id_b").where(reach).select("doc_id_a", "doc_id_b")
    w = _windows(many, span, phrase).select("w", "doc").distinct()
    w = w.join(_one_of_each_set(w), "w", "left_semi")
    split = w.select("w", F.col("doc").alias("doc_id_a")).join(w.select("w", F.col("doc").alias("doc_id_b")), "w").where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")
    return direct.union(split).distinct()


def sharing_classes(docs: DataFrame, row_id: str, text: str, span: int = SPAN, phrase: int = PHRASE) -> DataFrame:
    """(class_id, row_id, docs): the sets of documents that share one stretch of `span` or more, as membership.

    `sharing_pairs` are the pairs within the classes; this form is linear in the occurrences, however many documents share a
    stretch. Stretches shared by one and the same documents are one class; a document may be in several. docs: the class's size.
    """
    occ = occurrences(docs, row_id, text, span, phrase, every=False)
    w = _windows(occ, span, phrase).select("w", "doc").distinct()
    one = _one_of_each_set(w)
    return w.join(one, "w").select(F.col("w").alias("class_id"), F.col("doc").alias(row_id), F.col("n").alias("docs"))


def _one_of_each_set(w: DataFrame) -> DataFrame:
    """(w, n): of all windows with one and the same set of two documents or more, one. Sets are told by two sums of hashes."""
    sums = [F.sum(F.xxhash64("doc", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (0, 1)]
    sets = w.groupBy("w").agg(F.count("*").alias("n"), *sums, F.min("doc").alias("low")).where("n > 1")
    return sets.groupBy("n", "s0", "s1", "low").agg(F.min("w").alias("w")).select("w", "n")


def shared_parts(docs: DataFrame, row_id: str, text: str, span: int = SPAN, phrase: int = PHRASE) -> DataFrame:
    """(row_id, shared_chars, n_chars, share): how much of each document stands in others, in spans of `span` or more.

    One row per document with a text that is not null; linear in the occurrences, no pairs. A span of one document
    that only it repeats is not shared.
    """
    occ = occurrences(docs, row_id, text, span, phrase)
    w = _windows(occ, span, phrase)
    shared = w.groupBy("w").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("w")
    begins = w.join(shared, "w", "left_semi").groupBy("doc").agg(F.array_sort(F.collect_set("begin")).alias("b"))
    # the union of [b, b + span): each begin adds its distance to the next one, at most span
    size = F.expr(f"aggregate(sequence(2, size(b)), cast({span} as bigint), (s, i) -> s + least({span}, b[i - 1] - b[i - 2]))")
    size = F.when(F.size("b") > 1, size).otherwise(F.lit(span).cast("long"))
    begins = begins.select(F.col("doc").alias(row_id), size.alias("shared_chars"))
    n = docs.where(F.col(text).isNotNull()).groupBy(row_id).agg(F.max(F.length(text)).cast("long").alias("n_chars"))
    out = n.join(begins, row_id, "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0).cast("long")))
    return out.select(row_id, "shared_chars", "n_chars", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0).alias("share"))
