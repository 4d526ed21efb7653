"""Test items that stand, wholly or partly, inside the documents of a corpus.

Texts are compared as their letters and digits (NFKC, lower case). A leak is RUN successive characters of an item, so
windows are sized by the part that must be shared: every run holds a document window of WINDOW characters on a grid of
STEP, and the item has the same window at one of its offsets. Windows are compared by SimHash over their character
shingles: a table per 16-bit block of the fingerprints finds all item windows within RADIUS bits (RADIUS < 4 blocks: one
block is equal), the shingle multisets are then compared exactly, and what is left is extended letter by letter.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import rolling

RUN = 60
STEP, STEPS = 14, 3  # a window's shingles: STEPS blocks of STEP
SHINGLE = 5
WINDOW = STEP * STEPS + SHINGLE - 1
RADIUS = 3
SIMILAR = 0.8
#: item windows that one pass over the corpus holds in memory (some 60 bytes each); more are worked off in further passes
PASS_WINDOWS = 400_000
#: pairs of fingerprints compared at once
_CANDIDATES = 2_000_000
#: blocks of STEP shingles fingerprinted at once
_SLICE = 1 << 13


def letters(text: str) -> str:
    return "".join(filter(str.isalnum, unicodedata.normalize("NFKC", text).lower()))


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() or c == 0 for c in range(0x110000)), dtype=bool, count=0x110000)


def letter_stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the letters and digits, each text ended by a 0; each text's start and, at last, the end)."""
    cp = rolling.code_points("\0".join(unicodedata.normalize("NFKC", t).lower().replace("\0", "") for t in texts) + "\0")
    cp = cp[_is_letter()[cp]]
    return cp, np.concatenate([[0], np.flatnonzero(cp == 0) + 1])


def _bit_sums(shingles: np.ndarray, step: int) -> np.ndarray:
    """For every `step` shingle hashes, how often each of the 64 bits is set."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1)
    return bits.reshape(-1, step, 64).sum(axis=1, dtype=np.uint8)


def _fingerprint(counts: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(counts * 2 > n, axis=1).view(np.uint64).ravel()


def grid_fingerprints(cp: np.ndarray) -> np.ndarray:
    """SimHash of the WINDOW characters at 0, STEP, 2 STEP, ..."""
    blocks = (cp.size - SHINGLE + 1) // STEP
    out = [np.empty(0, dtype=np.uint64)]
    for a in range(0, blocks - STEPS + 1, _SLICE):
        b = min(blocks, a + _SLICE + STEPS - 1)
        sums = _bit_sums(rolling.window_hashes(cp[a * STEP : b * STEP + SHINGLE - 1], SHINGLE), STEP)
        out.append(_fingerprint(sum(sums[i : sums.shape[0] - STEPS + 1 + i] for i in range(STEPS)), STEP * STEPS))
    return np.concatenate(out)


def all_fingerprints(cp: np.ndarray) -> np.ndarray:
    """SimHash of every window of WINDOW characters."""
    h = rolling.window_hashes(cp, SHINGLE)
    n = STEP * STEPS
    if h.size < n:
        return np.empty(0, dtype=np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((h.size + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    return _fingerprint((sums[n:] - sums[:-n]).astype(np.uint8), n)


class ItemIndex:
    """The windows of a bounded set of items, with a table per 16-bit block of their fingerprints.

    Each distinct window is held once, with the list of items and places it stands in, so that a sentence many items share
    or that repeats itself is compared once.
    """

    def __init__(self, texts: list[str]):
        self.texts = texts
        prints, keys, item, at = ([np.empty(0, t)] for t in (np.uint64, np.uint64, np.int64, np.int64))
        for i, t in enumerate(texts):
            cp = rolling.code_points(t)
            f = all_fingerprints(cp)
            prints.append(f)
            keys.append(rolling.window_hashes(cp, WINDOW)[: f.size])
            item.append(np.full(f.size, i))
            at.append(np.arange(f.size))
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])) if key.size else np.empty(0, np.int64)
        # window w stands at places[begin[w] : begin[w + 1]]
        self.begin = np.append(first, key.size)
        self.item, self.at = (np.concatenate(x)[order] for x in (item, at))
        self.prints = np.concatenate(prints)[order[first]]
        self.tables = []
        for key in self._keys(self.prints):
            order = np.argsort(key, kind="stable")
            self.tables.append((order, np.searchsorted(key[order], np.arange((1 << 16) + 1))))

    @staticmethod
    def _keys(f: np.ndarray) -> list[np.ndarray]:
        return [((f >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]

    def near(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in f, windows) within RADIUS bits: all of them. Candidates are compared in slices of bounded size."""
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for key, (order, begin) in zip(self._keys(f), self.tables):
            n = begin[key + 1] - begin[key]
            some = np.flatnonzero(n)
            sums = np.cumsum(n[some])
            a = 0
            while a < some.size:
                z = max(a + 1, int(np.searchsorted(sums, (sums[a - 1] if a else 0) + _CANDIDATES, side="right")))
                part = some[a:z]
                m = n[part]
                q = np.repeat(part, m)
                within = np.arange(q.size) - np.repeat(np.cumsum(m) - m, m)
                w = order[np.repeat(begin[key[part]], m) + within]
                close = np.bitwise_count(f[q] ^ self.prints[w]) <= RADIUS
                left.append(q[close])
                right.append(w[close])
                a = z
        both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
        return both[0], both[1]


def shingle_similarity(a: str, b: str) -> float:
    """Weighted Jaccard similarity of the multisets of character shingles."""
    x, y = ({}, {})
    for t, c in ((a, x), (b, y)):
        for i in range(len(t) - SHINGLE + 1):
            s = t[i : i + SHINGLE]
            c[s] = c.get(s, 0) + 1
    least = sum(min(n, y.get(s, 0)) for s, n in x.items())
    most = sum(x.values()) + sum(y.values()) - least
    return least / most if most else 1.0


def equal_run(doc: np.ndarray, at: int, item: np.ndarray, begin: int) -> int:
    """Longest run of equal characters on the diagonal through doc[at], item[begin]."""
    back = min(at, begin)
    n = min(doc.size - at + back, item.size - begin + back)
    same = doc[at - back : at - back + n] == item[begin - back : begin - back + n]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max(initial=0))


def _search(index: ItemIndex, ids: list[list[int]]):
    """ids: the item ids of each text of the index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = [rolling.code_points(t) for t in index.texts]
        for b in batches:
            cp, starts = letter_stream(b["text"].tolist())
            docs = b["doc"].to_numpy()
            f = grid_fingerprints(cp)
            best: dict[tuple[int, int], list] = {}
            seen: set[tuple[int, int, int]] = set()
            for a in range(0, f.size, 1 << 18):
                q, w = index.near(f[a : a + (1 << 18)])
                p = (q + a) * STEP
                row = np.searchsorted(starts, p, side="right") - 1
                inside = p + WINDOW < starts[np.minimum(row + 1, starts.size - 1)]
                for at, r, win in zip(p[inside].tolist(), row[inside].tolist(), w[inside].tolist()):
                    places = range(int(index.begin[win]), int(index.begin[win + 1]))
                    i, begin = int(index.item[places[0]]), int(index.at[places[0]])
                    here, own = cp[at : at + WINDOW], items[i][begin : begin + WINDOW]
                    like = 1.0 if np.array_equal(here, own) else shingle_similarity(here.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), index.texts[i][begin : begin + WINDOW])
                    if like < SIMILAR:
                        continue
                    for k in places:
                        i, begin = int(index.item[k]), int(index.at[k])
                        one = best.setdefault((r, i), [0.0, 0])
                        one[0] = max(one[0], like)
                        if (r, i, at - begin) not in seen:  # a diagonal is measured once
                            seen.add((r, i, at - begin))
                            one[1] = max(one[1], equal_run(cp[starts[r] : starts[r + 1] - 1], at - int(starts[r]), items[i], begin))
            rows = [(n, docs[r], like, run_len) for (r, i), (like, run_len) in best.items() for n in ids[i]]
            yield pd.DataFrame(rows, columns=["item", "doc", "similarity", "run"]).astype({"item": "int64", "doc": "int64", "similarity": "float64", "run": "int32"})

    return run


def leaked_items(items: DataFrame, item_id: str, item_text: str, docs: DataFrame, doc_id: str, doc_text: str) -> DataFrame:
    """(item_id, doc_id, similarity, run): documents with a window like one of an item.

    similarity: the best shingle similarity of two windows (0.8 at least); run: the longest run of the item's letters
    and digits that stands in the document, as far as it passes through such windows; it is exact wherever it is RUN or
    more. Items with fewer than WINDOW letters and digits, null texts and rows without an id give nothing. The items are
    a stated query set: they are read block by block, each block is held against all documents in one scan.
    """
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text")).where(F.col("text").isNotNull() & F.col("doc").isNotNull())
    schema = "item long, doc long, similarity double, run int"
    out, held, size = None, {}, 0

    def scan():
        found = texts.mapInPandas(_search(ItemIndex(list(held)), list(held.values())), schema)
        return found if out is None else out.union(found)

    for i, t in items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(item_id, item_text).distinct().toLocalIterator():
        t = letters(t)
        if t in held:  # items of one text are one, until the end
            held[t].append(i)
            continue
        held[t] = [i]
        size += max(0, len(t) - WINDOW + 1)
        if size >= PASS_WINDOWS:
            out, held, size = scan(), {}, 0
    if held or out is None:
        out = scan()
    best = out.groupBy("item", "doc").agg(F.max("similarity").alias("similarity"), F.max("run").alias("run"))
    return best.select(F.col("item").alias(item_id), F.col("doc").alias(doc_id), "similarity", "run")
