"""A mixed set of documents in which each source has its target share of all tokens.

The budget runs down a tree of levels (here source, then language): at each node the amount is split by weight among
the children, none gets more than its subtree can give (tokens times allowed repeats), and what one lacks goes to its
siblings first, then, at the next node up, to the siblings of the parent. Each leaf then takes whole epochs of its
documents and, of the last epoch, the prefix of a seeded order that fits its remaining tokens.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from leafmill.runtime import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: leaves of the tree that the driver may plan for; more are an error, never cut
MOST_LEAVES = 100_000
#: documents of a leaf in one bucket of its seeded order
BUCKET_DOCS = 5_000


@lru_cache(2)
def _encoder(path: str):
    import base64

    import tiktoken

    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    # fixed value: the pre-splitting pattern this public vocabulary was made with
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, out: str = "n_tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """`df` without `text`, with its number of tokens; null and empty texts have 0. tokenizer: a tiktoken vocabulary file."""

    @F.pandas_udf(LongType())
    def count(s: pd.Series) -> pd.Series:
        enc = _encoder(tokenizer)
        return pd.Series([0 if t is None else len(enc.encode_ordinary(t)) for t in s], dtype="int64")

    return df.select(*(c for c in df.columns if c != text), count(text).alias(out))


@dataclass
class Node:
    weight: float | None = None  # None: by its tokens
    tokens: int = 0
    capacity: int = 0
    children: dict = field(default_factory=dict)
    given: float = 0.0


def spread(amount: float, nodes: Sequence[Node]) -> None:
    """Split an amount by weight among nodes, none beyond its capacity; the rest goes to those with room, by weight."""
    total = sum(n.tokens for n in nodes) or 1
    left = {i: (n.tokens / total if n.weight is None else n.weight) for i, n in enumerate(nodes)}
    left = {i: w for i, w in left.items() if w > 0 and nodes[i].capacity > 0}
    while left and amount > 0:
        weight = sum(left.values())
        full = [i for i, w in left.items() if amount * w / weight >= nodes[i].capacity]
        if not full:
            for i, w in left.items():
                nodes[i].given = amount * w / weight
            return
        for i in full:
            nodes[i].given = nodes[i].capacity
            del left[i]
        amount -= sum(nodes[i].given for i in full)


def plan(root: Node, amount: float) -> None:
    """Hand `amount` down the tree; every leaf's `given` is set."""
    root.given = min(amount, root.capacity)
    if root.children:
        spread(root.given, list(root.children.values()))
        for n in root.children.values():
            plan(n, n.given)


def budget(leaves: list[dict], levels: Sequence[str], weights: dict[tuple, float], total: float | None) -> dict[tuple, float]:
    """{leaf path: tokens to take}. leaves: a dict with the levels, tokens, repeats each. weights: of nodes, by path.

    Where any child of a node has a weight, those without have none; where none has, all weigh by their tokens.
    """
    root = Node()
    for leaf in leaves:
        node, path = root, ()
        capacity = leaf["tokens"] * leaf["repeats"]
        for name in levels:
            node.tokens += leaf["tokens"]
            node.capacity += capacity
            path += (leaf[name],)
            node = node.children.setdefault(leaf[name], Node(weights.get(path)))
        node.tokens += leaf["tokens"]
        node.capacity += capacity

    def settle(node: Node) -> None:
        if any(n.weight is not None for n in node.children.values()):
            for n in node.children.values():
                n.weight = n.weight or 0.0
        for n in node.children.values():
            settle(n)

    settle(root)
    plan(root, root.tokens if total is None else total)
    out = {}

    def collect(node: Node, path: tuple) -> None:
        if not node.children:
            out[path] = node.given
        for k, n in node.children.items():
            collect(n, path + (k,))

    collect(root, ())
    return out


def mix(docs: DataFrame, doc_id: str, text: str, targets: DataFrame, levels: Sequence[str] = ("source", "lang"), total: float | None = None, seed: int = 7, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, levels, n_tokens, copies): the mixed set, each document with how often it is used (at least once).

    targets: source, target_share, max_repeats; a null or negative share counts as 0, null repeats as 1; of a source
    named twice the shares add up. Documents of sources without a target (null ones too) are left out; a null lower
    level is a leaf of its own. total: tokens wanted, by default those of all documents of target sources. A document
    is used max_repeats times at most; a leaf never takes more than its share, so it may miss it by less than one document.
    Repeated rows of one doc_id count as documents of their own. The same seed gives the same set.
    """
    first = levels[0]
    t = targets.where(F.col(first).isNotNull()).groupBy(first).agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("repeats"))
    few = docs.select(F.col(doc_id).alias("doc"), *levels, F.col(text).alias("text")).join(F.broadcast(t) if t.count() <= MOST_LEAVES else t, first)
    sized = materialize(token_counts(few, "text", tokenizer=tokenizer), "tokens")
    found = sized.groupBy(*levels, "share", "repeats").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    leaves = [r.asDict() for r in found.limit(MOST_LEAVES + 1).toLocalIterator()]
    if len(leaves) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    takes = budget(leaves, levels, {(x[first],): x["share"] for x in leaves}, total)
    spark = docs.sparkSession
    rows = []
    for x in leaves:
        path = tuple(x[n] for n in levels)
        give = takes[path]
        epochs = min(int(x["repeats"]), int(give // x["tokens"])) if x["tokens"] else 0
        rest = give - epochs * x["tokens"] if epochs < x["repeats"] else 0.0
        rows.append((*path, epochs, float(rest), max(1, -(-int(x["docs"]) // BUCKET_DOCS))))
    types = dict(docs.dtypes)
    names = ", ".join(f"{n} {types[n]}" for n in levels)
    leaf = F.broadcast(spark.createDataFrame(rows, f"{names}, epochs int, rest double, buckets int"))
    same = None
    for n in levels:
        one = sized[n].eqNullSafe(leaf[n])
        same = one if same is None else same & one
    keyed = sized.join(leaf, same).select("doc", *(sized[n] for n in levels), "n_tokens", "epochs", "rest", "buckets")
    # the seeded order of the epoch after the whole ones; buckets are stretches of it
    order = F.xxhash64(F.lit(seed), "epochs", "doc")
    keyed = keyed.withColumn("__h", order).withColumn("__b", F.floor((F.shiftright("__h", 33) + (1 << 30)) * F.col("buckets") / F.lit(1 << 31)).cast("int"))

    from pyspark.sql import Window

    by_leaf = Window.partitionBy(*levels)
    sums = keyed.groupBy(*levels, "__b").agg(F.sum("n_tokens").alias("__in"))
    before = sums.withColumn("__before", F.sum("__in").over(by_leaf.orderBy("__b")) - F.col("__in"))
    a, b = keyed.alias("a"), before.alias("b")
    near = None
    for n in [*levels, "__b"]:
        one = F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}"))
        near = one if near is None else near & one
    placed = a.join(b, near).select("a.*", "b.__before", "b.__in")
    # whole buckets below the rest are taken; only the bucket in which it runs out is put in order
    inside = placed.where("__before < rest and __before + __in > rest")
    w = Window.partitionBy(*levels, "__b").orderBy("__h", "doc").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("__more", (F.col("__before") + F.sum("n_tokens").over(w) <= F.col("rest")).cast("int"))
    outside = placed.where("not (__before < rest and __before + __in > rest)").withColumn("__more", ((F.col("__before") + F.col("__in") <= F.col("rest")) & (F.col("rest") > 0)).cast("int"))
    both = inside.unionByName(outside).withColumn("copies", F.col("epochs") + F.col("__more")).where("copies > 0")
    return both.select(F.col("doc").alias(doc_id), *levels, "n_tokens", "copies")


def shares(mixed: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """(source, target_share, tokens, documents, most_copies, share): what each target reached; targets without text have 0."""
    got = mixed.groupBy(source).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    total = got.agg(F.sum("tokens")).first()[0] or 0  # one number
    both = targets.groupBy(source).agg(F.sum("target_share").alias("target_share")).join(got, source, "left").withColumn("total", F.lit(total))
    none = F.lit(0).cast("long")
    return both.select(
        source, "target_share", F.coalesce("tokens", none).alias("tokens"), F.coalesce("documents", none).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.when(F.col("total") > 0, F.coalesce("tokens", none) / F.col("total")).otherwise(0.0).alias("share")
    )
