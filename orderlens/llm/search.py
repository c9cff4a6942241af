"""Ranked lexical search of many queries at once: what queries share is computed once per document.

Terms that the same items hold form one node; then the pair of nodes that most items share becomes a node of its
own, again and again, until no two items share a pair. The nodes form a DAG in which every item is one root. For a
slice of documents each node holds a vector of partial scores, computed once as the sum of its two children, so
terms that items share are added up once for all of them.

Items come in blocks of bounded size; for a block one pass over the documents keeps the counts of the block's terms,
one more pass over these counts scores them. Each task keeps its best documents per item; only those are shuffled.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Bytes that end a term become a space, A-Z become a-z, all others (also those of non-ASCII characters) stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Bounds of a block: items, and the sum of the squares of their numbers of terms (pairs that are looked at).
BLOCK_ITEMS, BLOCK_PAIRS = 1024, 8_000_000
_SLICE_BYTES = 32 << 20


def terms(text: str | bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case; none for null."""
    raw = b"" if text is None else text.encode("utf-8", "replace") if isinstance(text, str) else text
    return raw.translate(_TABLE).split()


@dataclass
class SharedPlan:
    """The DAG of one block. Node k below ``len(leaves)`` is ``leaves[k]`` = (term number, times); later nodes are
    ``sums[k - len(leaves)]`` = two smaller nodes; ``roots[i]`` is the node of item i (None without a term)."""

    vocabulary: dict[bytes, int]
    leaves: list[tuple[int, int]]
    sums: list[tuple[int, int]]
    roots: list[int | None]


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def share(items: list[list[bytes]]) -> SharedPlan:
    """Mine the term sets that items share. A term that an item repeats is another leaf (the term that many times)."""
    vocabulary: dict[bytes, int] = {}
    holders: dict[tuple[int, int], int] = {}
    for i, words in enumerate(items):
        for word, times in Counter(words).items():
            leaf = (vocabulary.setdefault(word, len(vocabulary)), times)
            holders[leaf] = holders.get(leaf, 0) | 1 << i
    leaves = sorted(holders)
    sums: list[tuple[int, int]] = []

    def add(a: int, b: int) -> int:
        sums.append((a, b))
        return len(leaves) + len(sums) - 1

    together: dict[int, list[int]] = {}
    for k, leaf in enumerate(leaves):
        together.setdefault(holders[leaf], []).append(k)
    held = {reduce(add, nodes): items_of for items_of, nodes in together.items()}     # node -> its items, as bits
    parts: list[set[int]] = [set() for _ in items]
    for node, items_of in held.items():
        for i in _bits(items_of):
            parts[i].add(node)

    def common(a: int, b: int) -> int:
        return (held[a] & held[b]).bit_count()

    pairs = {(a, b) for nodes in parts for a in nodes for b in nodes if a < b and held[a] & (held[a] - 1) and held[b] & (held[b] - 1)}
    queue = [(-n, a, b) for a, b in pairs if (n := common(a, b)) > 1]
    heapq.heapify(queue)
    while queue:
        n, a, b = heapq.heappop(queue)
        now = common(a, b)
        if now < 2:
            continue
        if now != -n:                                           # earlier merges took items from this pair
            heapq.heappush(queue, (-now, a, b))
            continue
        both = held[a] & held[b]
        new = add(a, b)
        held[new] = both
        held[a] ^= both
        held[b] ^= both
        others = set()
        for i in _bits(both):
            parts[i] -= {a, b}
            others |= parts[i]
            parts[i].add(new)
        for other in others:
            if (n := common(new, other)) > 1:
                heapq.heappush(queue, (-n, min(new, other), max(new, other)))
    return SharedPlan(vocabulary, leaves, sums, [reduce(add, sorted(nodes)) if nodes else None for nodes in parts])


def partial_scores(plan: SharedPlan, term: np.ndarray, doc: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
    """Item scores (items x docs) of a slice of documents: ``value[i]`` is what term ``term[i]`` adds in document ``doc[i]``."""
    by_term = np.zeros((len(plan.vocabulary), docs), np.int64)
    by_term[term, doc] = value
    nodes = np.empty((len(plan.leaves) + len(plan.sums), docs), np.int64)
    for k, (t, times) in enumerate(plan.leaves):
        np.multiply(by_term[t], times, out=nodes[k])
    for k, (a, b) in enumerate(plan.sums, len(plan.leaves)):
        np.add(nodes[a], nodes[b], out=nodes[k])
    return np.stack([nodes[r] if r is not None else np.zeros(docs, np.int64) for r in plan.roots])


def _item_blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list[int | None], list[list[bytes]]]]:
    """Blocks of items, streamed to the driver; an item too large for the pair bound is a block of its own."""
    ids, lists, pairs = [], [], 0
    rows = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    for row in rows.toLocalIterator():
        words = terms(row["text"])
        size = len(set(words)) ** 2
        if ids and (len(ids) >= BLOCK_ITEMS or pairs + size > BLOCK_PAIRS):
            yield ids, lists
            ids, lists, pairs = [], [], 0
        ids.append(row["item"])
        lists.append(words)
        pairs += size
    if ids:
        yield ids, lists


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, terms, tf``: the number of all terms of each whole text, and the counts of the vocabulary's terms."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in batches:
            n, at, found, tf = [], [0], [], []
            for text in batch.column("text"):
                words = terms(text.as_py())
                n.append(len(words))
                got = Counter([number[w] for w in words if w in number])
                found.extend(got.keys())
                tf.extend(got.values())
                at.append(len(found))
            offsets = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))], ["doc_id", "n", "terms", "tf"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")) \
        .mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


class _Best:
    """The ``k`` best documents of every item so far: highest score, then smallest id (a null id last)."""

    def __init__(self, items: int, k: int):
        self.k, self.rows, self.least = k, [[] for _ in range(items)], np.ones(items, np.int64)

    def offer(self, scores: np.ndarray, ids: list[int | None]) -> None:
        for i, d in zip(*(x.tolist() for x in np.nonzero(scores >= self.least[:, None]))):
            self.rows[i].append((-int(scores[i, d]), ids[d] is None, ids[d]))
        for i, rows in enumerate(self.rows):
            if len(rows) > self.k:
                self.rows[i] = rows = heapq.nsmallest(self.k, rows, key=lambda r: (r[0], r[1], r[2] or 0))
                self.least[i] = max(1, -rows[-1][0])


def _block_top(counts: DataFrame, plan: SharedPlan, k: int) -> DataFrame:
    """``item`` (number in the block), ``doc_id, score``: the best ``k`` documents of every item and task."""
    stats = counts.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    total, length = stats["docs"], stats["words"]
    df = dict(counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect())     # one row per term of the block
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(plan.vocabulary))], np.int64)
    shared = counts.sparkSession.sparkContext.broadcast((plan, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weight = shared.value
        best = _Best(len(plan.roots), k)
        width = max(16, _SLICE_BYTES // 8 // (len(plan.leaves) + len(plan.sums) + len(plan.vocabulary) + len(plan.roots) + 1))
        for batch in batches:
            for start in range(0, batch.num_rows, width):
                part = batch.slice(start, width)
                n = part.column("n").to_numpy()
                found = part.column("terms")
                term = found.flatten().to_numpy()
                tf = part.column("tf").flatten().to_numpy()
                doc = np.repeat(np.arange(len(n)), np.diff(found.offsets.to_numpy()))
                m = 100 - 75 + (75 * n * total) // max(1, length)
                value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                best.offer(partial_scores(plan, term, doc, value, len(n)), part.column("doc_id").to_pylist())
        rows = [(i, r[2], -r[0]) for i, held in enumerate(best.rows) for r in held]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64()))],
                                             ["item", "doc_id", "score"])

    return counts.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``k`` highest-scoring documents of every item: ``item_id, rank, doc_id, score``, scores above 0 only.

    With N the documents that hold a term, L all their terms, n a document's terms and df the documents that hold a term:
    a term weighs floor(1000 ln((2N+2)/(2df+1))), a document has m = 25 + (75 n N) div L, and an item scores the sum, over its
    terms with repeats, of weight * ((10^9 tf) div (1000 tf + 8 m)). Equal scores go by ascending document id, a null id last.
    Whole texts are read; null texts have no terms. Rows that share an id, or repeat, are documents (or items) of their own;
    an item without terms, and an empty table on either side, give no rows. Other columns are not read.
    """
    spark, out = docs.sparkSession, []
    for ids, words in _item_blocks(items, item_col, item_text_col):
        plan = share(words)
        counts = stage(term_counts(docs, plan.vocabulary, id_col, text_col), "search-counts")
        found = stage(_block_top(counts, plan, k), "search-best")
        order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
        few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
        top = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        names = F.array(*[F.lit(i).cast("long") for i in ids])          # at most BLOCK_ITEMS
        out.append(top.select(F.get(names, F.col("item")).alias("item_id"), "rank", "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, out)
