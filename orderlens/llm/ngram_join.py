"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets verify them.

Texts with equal n-gram sets are one class. Band hashes are the shuffle key; each bucket ties its classes to its
smallest one (no pairs), which cuts the classes into candidate groups, and every pair that shares a band lies inside
one. Groups are verified block against block, a bounded number of texts at a time, on their full sets of n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, long_ids, row_key, same_row, stage, star_edges

_MIX = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float, recall: float, low: float = 0.1, false_rate: float = 1e-4) -> tuple[int, int]:
    """(bands, rows): the fewest hash values that find a pair at ``threshold`` with probability ``recall`` and take
    a pair at similarity ``low`` (texts that only share a passage) for a candidate with ``false_rate`` at most."""
    rows = 1
    while True:
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))
        if 1 - (1 - low ** rows) ** bands <= false_rate:
            return bands, rows
        rows += 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """Hashes of the n-grams of whole texts: words between ASCII white space, ASCII letters in lower case."""

    def __init__(self, n: int = 5, cache_entries: int = 500_000):
        self.n, self.words, self.limit = n, {}, cache_entries

    def _numbers(self, words: list[bytes]) -> list[int]:
        known = self.words
        try:
            return [known[w] for w in words]
        except KeyError:
            import xxhash
            if len(known) > self.limit:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return [known[w] for w in words]

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; a text of fewer than n words is one gram, one without words has none."""
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.array(self._numbers(words), np.uint64)
        m = min(self.n, len(h))
        out = np.full(len(h) - m + 1, m, np.uint64)
        for k in range(m):
            out = _mix(out * _MIX + h[k:len(h) - m + 1 + k])
        out.sort()
        return out if len(out) < 2 else out[np.concatenate(([True], out[1:] != out[:-1]))]


def _seeds(count: int, seed: int = 5) -> np.ndarray:
    return _mix(np.arange(1, count + 1, dtype=np.uint64) * _MIX + np.uint64(seed)) | np.uint64(1)


def minhash(grams: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One minimum per seed of a multiply-xorshift hash of the n-gram hashes."""
    x = grams ^ (grams >> np.uint64(32))
    out = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(x), 512):
        np.minimum(out, (x[k:k + 512, None] * seeds).min(axis=0), out=out)
    return out


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def band_hashes(grams: np.ndarray, seeds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    values = minhash(grams, seeds).reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        out = _mix(out * _MIX + values[:, r])
    return out


def signatures(docs: DataFrame, bands: int, rows: int, n: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t1, t2, n_grams, set1, set2, bands): the row's key, two independent 64-bit fingerprints of the whole n-gram set
    and the band hashes; texts without words have 0 and no band."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, seeds = Grams(n), _seeds(bands * rows)
        for batch in batches:
            out = []
            for i, t1, t2, text in zip(batch["doc_id"].array, batch["t1"].array, batch["t2"].array, batch["text"].array):
                g = grams.of(text if isinstance(text, str) else None)
                if len(g):
                    one, two = (_mix(g + np.uint64(c)).sum(dtype=np.uint64) for c in (11, 23))
                    out.append((i, t1, t2, len(g), *_signed(np.array([one, two])), _signed(band_hashes(g, seeds, bands, rows))))
                else:
                    out.append((i, t1, t2, 0, 0, 0, None))
            yield pd.DataFrame(out, columns=["doc_id", "t1", "t2", "n_grams", "set1", "set2", "bands"])

    keyed = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    return long_ids(keyed.withColumn("doc_id", F.col("doc_id").cast("string"))
                    .mapInPandas(run, "doc_id string, t1 long, t2 long, n_grams long, set1 long, set2 long, bands array<long>"))


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum())


def verify_block(rows: pd.DataFrame, threshold: float, n: int, grams: Grams) -> list[tuple]:
    """Links inside one block pair: per class the documents and classes it is linked with (``kind`` 0), and
    a forest of links that ties the linked classes together (``kind`` 1), at most one per class."""
    left = rows[rows["side"] == 0].sort_values("id")
    right = left if not (rows["side"] == 1).any() else rows[rows["side"] == 1].sort_values("id")
    same = right is left
    sets = {i: grams.of(t) for i, t in zip([*left["id"], *right["id"]], [*left["text"], *right["text"]])}
    la, ra = left["id"].to_numpy(), right["id"].to_numpy()
    lsize, rsize = left["size"].to_numpy(), right["size"].to_numpy()
    lb, rb = np.array(left["bands"].tolist(), np.int64), np.array(right["bands"].tolist(), np.int64)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    docs, classes, forest = dict.fromkeys(sets, 0), dict.fromkeys(sets, 0), []
    for x, i in enumerate(la):
        for y in np.flatnonzero((rb == lb[x]).any(axis=1)):
            j = ra[y]
            if same and j <= i:
                continue
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) < threshold * max(len(a), len(b)):
                continue
            both = _shared(a, b)
            if both >= threshold * (len(a) + len(b) - both):
                docs[i] += int(rsize[y])
                docs[j] += int(lsize[x])
                classes[i] += 1
                classes[j] += 1
                if find(i) != find(j):
                    parent[find(j)] = find(i)
                    forest.append((1, i, j, 0))
    return [(0, i, docs[i], classes[i]) for i in sets if docs[i]] + forest


def ngram_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.999, block: int = 128,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, class_id, copy_id, n_copies, n_links, n_classes``, and ``class_key, t1, t2``.

    Two documents are linked when the Jaccard similarity of their sets of ``n``-word shingles is at least the
    threshold. ``copy_id`` is the smallest id among documents with the same set and ``n_copies`` how many they are,
    ``class_id`` the smallest id among all documents tied to it by links, directly or through others, ``n_links`` the
    number of other documents it is linked with (copies too), ``n_classes`` that of other sets. ``class_key`` names the same class
    by the fingerprint of one of its sets, ``t1, t2`` are 128 bits of the row's text. Every pair that
    shares a band is checked on the full sets. Texts without words (null, empty) are alone, without links; texts
    shorter than ``n`` words are one gram. Rows are told apart by their texts, not by their ids: rows without an id or with a
    shared one are linked like all others (an id of null is no smallest id, unless a class has no other). Repeated rows count as
    copies; an empty table gives no rows; columns other than the two named are not read.
    """
    bands, rows = choose_bands(threshold, recall)
    sig = stage(signatures(docs, bands, rows, n, id_col, text_col), "ngram-signatures")
    same = ["set1", "set2", "n_grams"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "t2")).alias("first")
    classes = sig.where("n_grams > 0").groupBy(*same).agg(first, F.count("*").alias("size"), F.min("bands").alias("bands"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("id"), *same, "first", "size", "bands"), "ngram-classes")
    keys = classes.select(F.col("id").alias("node"), F.posexplode("bands").alias("band", "hash")) \
        .select(F.xxhash64("band", "hash").alias("key"), "node")
    groups = components(star_edges(keys, "ngram-buckets")[0], "ngram-candidates")
    found = stage(_verify(docs, classes, groups, threshold, n, block, id_col, text_col), "ngram-links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("docs"), F.sum("c").alias("n_classes"))
    roots = components(found.where("kind = 1").select("a", "b"), "ngram-groups")
    labelled = classes.drop("bands").join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left") \
        .withColumn("root", F.coalesce("root", "id"))
    # whole groups are named once; the names go back to the classes, of which a group has as many as it has different sets
    names = labelled.groupBy("root").agg(F.min("first.doc_id").alias("class_id"), F.min(F.concat_ws("-", F.hex("set1"), F.hex("set2"), "n_grams")).alias("class_key"))
    final = labelled.join(names, "root").select(*same, F.col("first.doc_id").alias("copy_id"), "size", F.coalesce("docs", F.lit(0)).alias("docs"),
                                                F.coalesce("n_classes", F.lit(0)).alias("n_classes"), "class_id", "class_key")
    out = sig.drop("bands").join(final, same, "left")
    alone = F.col("size").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
                      F.coalesce("size", F.lit(1)).alias("n_copies"),
                      F.coalesce(F.col("size") - 1 + F.col("docs"), F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("n_classes", F.lit(0)).cast("long").alias("n_classes"),
                      F.coalesce("class_key", F.concat_ws("-", F.lit("none"), "doc_id", F.hex("t1"), F.hex("t2"))).alias("class_key"), "t1", "t2")


def one_of_each_class(docs: DataFrame, joined: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their class in the result of ``ngram_join``: of each class the row with the smallest
    id (a null id last), then text; of rows equal in both any one."""
    best = joined.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "t2")).alias("f")) \
        .select(F.col("f.doc_id").alias("_d"), F.col("f.t1").alias("_t1"), F.col("f.t2").alias("_t2"))
    rows = docs.select(F.struct("*").alias("row"), *row_key(id_col, text_col)).join(best, same_row("_d", "_t1", "_t2"), "left_semi")
    return rows.groupBy("doc_id", "t1", "t2").agg(F.first("row").alias("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def _verify(docs: DataFrame, classes: DataFrame, groups: DataFrame, threshold: float, n: int, block: int,
            id_col: str, text_col: str) -> DataFrame:
    """Block pairs of every candidate group: a group of m classes is dealt by hash over m / ``block`` + 1 blocks, and
    each class goes to the pairs of its block with every block; a group within one block is read once. The text of a class is that of its
    first row; rows equal in id and text are one text."""
    sizes = groups.groupBy("root").agg((F.floor(F.count("*") / block) + 1).cast("int").alias("k"))
    member = groups.join(sizes, "root").withColumnRenamed("node", "id") \
        .withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.col("k")).cast("int")) \
        .join(classes.select("id", "size", "bands", "first"), "id")
    texts = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text")).groupBy("doc_id", "t1", "t2").agg(F.first("text").alias("text"))
    named = member.select("root", "id", "size", "bands", "own", "k", F.col("first.doc_id").alias("_d"), F.col("first.t1").alias("_t1"), F.col("first.t2").alias("_t2"))
    whole = named.join(texts, same_row("_d", "_t1", "_t2")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))) \
        .withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}) \
        .withColumn("side", F.when(F.col("own") == F.col("lo"), 0).otherwise(1))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("id")
        return pd.DataFrame(verify_block(rows, threshold, n, Grams(n)), columns=["kind", "a", "b", "c"])

    return whole.select("root", "lo", "hi", "side", "id", "size", "bands", "text").groupBy("root", "lo", "hi") \
        .applyInPandas(run, "kind int, a long, b long, c long")
