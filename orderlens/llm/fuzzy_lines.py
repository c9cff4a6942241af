"""Fuzzy line deduplication: windows of word hashes find candidates, edit similarity decides.

Equal lines collapse first (map-side), so a line that a third of all documents share is one row afterwards. Of the words of a
different line the eleven with the smallest hashes are its sketch, and every four neighbours in it are a key: a changed word spoils the
windows around it and, if the line is long, seldom lies in the sketch at all. Lines of at most ten different words also carry a key for the
line without each of its words. Pairs with a common key, like lengths and two fifths of their sketches, then of their different words, in common are
candidates; those whose edit similarity reaches the threshold are linked;
lines tied by links, directly or through others, form a group, and one occurrence per group is kept. Edit distances are counted in Python, with the
columns of the table as bits of one number; all else is built-in functions.

SimHash fingerprints stood in the place of the windows first; the README says what they found and cost.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import any_of, components, row_key, same_row, stage, stage_alone

#: Words of a sketch, and neighbours in it that make a key. One changed word leaves four neighbours together in any line of eleven words.
SKETCH_WORDS, WINDOW_WORDS = 11, 4
#: Share of their different words that candidates must have in common. Linked pairs that the blocks find have far more.
SHARED_WORDS = 0.4
#: Lines of a block, and letters on average: what is left of a bucket is compared block by block, so no task holds more than two blocks of it.
BLOCK_LINES, BLOCK_LETTERS = 1024, 4_000_000
#: The most rows of a small join side that are sent to all tasks.
BROADCAST_ROWS = 1_000_000


def normalised(line: Column) -> Column:
    """In lower case, with single spaces for white space; most lines have no other, which costs less to see than to replace."""
    other = any_of([line.contains(x) for x in ("  ", "\t", "\v", "\f", "\r", "\n")])
    return F.lower(F.trim(F.when(other, F.regexp_replace(line, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")).otherwise(line)))


def _worded(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _key(line: Column) -> list[Column]:
    """128 bits that stand for a normalised line."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2")]


def sketch(norm: Column, min_words: int) -> Column:
    """The smallest hashes of the words of a normalised line in ascending order; empty for a line of fewer than ``min_words`` words."""
    words = F.split(norm, " ")
    hashes = F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))
    return F.when(F.size(words) >= min_words, F.slice(hashes, 1, SKETCH_WORDS)).otherwise(F.array().cast("array<bigint>"))


def line_keys(lines: DataFrame) -> DataFrame:
    """``key, at, node``: the keys of lines by their sketches (columns ``id``, ``sketch``). ``at`` is the place of a key's window in the
    sketch, or -1 for the line without one of its words, whose key is the exclusive or of the other words' hashes."""
    windows = [F.when(F.size("sketch") >= k + WINDOW_WORDS, F.xxhash64(*[F.get("sketch", F.lit(k + i)) for i in range(WINDOW_WORDS)]))
               for k in range(SKETCH_WORDS - WINDOW_WORDS + 1)]
    long = lines.where(F.size("sketch") >= WINDOW_WORDS).select(F.posexplode(F.array(*windows)).alias("at", "key"), F.col("id").alias("node")) \
        .where(F.col("key").isNotNull()).select("key", "at", "node")
    line = F.aggregate("sketch", F.lit(0).cast("long"), lambda x, w: x.bitwiseXOR(w))
    short = lines.where((F.size("sketch") > 0) & (F.size("sketch") < SKETCH_WORDS)).withColumn("line", line)
    left_out = F.transform(F.concat(F.array(F.lit(0).cast("long")), "sketch"), lambda w: F.xxhash64(F.lit("left out"), w.bitwiseXOR(F.col("line"))))
    return long.unionByName(short.select(F.explode(F.array_distinct(left_out)).alias("key"), F.lit(-1).alias("at"), F.col("id").alias("node")))


def edits_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of two texts is at most ``most`` (Myers: the columns of the table as bits of one number)."""
    short, long = sorted((a, b), key=len)
    head, n = 0, len(short)
    while head < n and short[head] == long[head]:
        head += 1
    tail = 0
    while tail < n - head and short[-1 - tail] == long[-1 - tail]:
        tail += 1
    short, long = short[head:n - tail], long[head:len(long) - tail]
    if len(long) <= most or len(long) - len(short) > most:
        return len(long) <= most
    at: dict[str, int] = defaultdict(int)
    for i, c in enumerate(long):
        at[c] |= 1 << i
    full, top = (1 << len(long)) - 1, 1 << len(long) - 1
    more, less, edits, left = full, 0, len(long), len(short)
    for c in short:
        eq = at.get(c, 0)
        flat = (((eq & more) + more) ^ more) | eq | less
        up, down = less | (full & ~(flat | more)), more & flat
        edits += 1 if up & top else -1 if down & top else 0
        left -= 1
        if edits - left > most:
            return False
        up = up << 1 | 1
        eq |= less
        more, less = (down << 1 | ~(eq | up)) & full, up & eq & full
    return edits <= most


@F.pandas_udf(BooleanType())
def _edits_within(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b, most in batches:
        yield pd.Series([edits_within(*x) for x in zip(a, b, most)], dtype=bool)


def _small(df: DataFrame) -> DataFrame:
    """A staged table as the small side of a join: sent to all tasks when it has at most ``BROADCAST_ROWS`` rows, else joined by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def _line_texts(lines: DataFrame, docs: DataFrame, name: str, id_col: str, text_col: str) -> DataFrame:
    """``id, norm``: the normalised text of ``lines`` (columns ``id, doc_id, t1, t2, line_no``), read again from ``docs``."""
    wanted = lines.groupBy(F.col("doc_id").alias("_d"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2")) \
        .agg(F.collect_list(F.struct("id", "line_no")).alias("_lines"))
    rows = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text")).join(_small(stage(wanted, f"{name}-wanted")), same_row("_d", "_t1", "_t2"))
    texts = rows.select(F.split("text", "\n").alias("texts"), F.explode("_lines").alias("l")) \
        .select(F.col("l.id").alias("id"), normalised(F.get("texts", F.col("l.line_no"))).alias("norm"))
    return texts.groupBy("id").agg(F.first("norm").alias("norm"))


def line_words(lines: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, words, n_words, norm``: 32-bit hashes of the different words of each line, how many words they stand for, and the text."""
    words = F.array_distinct(F.split("norm", " "))
    return _line_texts(lines, docs, "line-words", id_col, text_col) \
        .select("id", F.array_distinct(F.transform(words, lambda w: F.hash(w))).alias("words"), F.size(words).alias("n_words"), "norm")


def _verified(pairs: DataFrame, lines: DataFrame, docs: DataFrame, similarity: float, name: str, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of line ids whose lengths fit, whose sketches and words have enough in common and whose texts reach the edit similarity. Texts
    are read again, by row and line number, for the lines of pairs with like lengths and sketches."""
    pairs = stage(pairs, f"{name}-pairs")
    near = stage(lines.join(_small(stage(_ends(pairs), f"{name}-ends")), "id", "left_semi"), f"{name}-near")

    def side(df: DataFrame, c: str, *columns: str) -> DataFrame:
        return df.select(F.col("id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in columns])

    most = F.floor(F.greatest("chars_a", "chars_b") * (1 - similarity) + 1e-9).cast("int").alias("most")
    sketched = pairs.join(side(near, "a", "sketch", "chars"), "a").join(side(near, "b", "sketch", "chars"), "b") \
        .where(F.abs(F.col("chars_a") - F.col("chars_b")) <= most)
    enough = F.size(F.array_intersect("sketch_a", "sketch_b")) >= SHARED_WORDS * F.greatest(F.size("sketch_a"), F.size("sketch_b"))
    close = stage(sketched.where(enough).select("a", "b", most), f"{name}-candidates")
    texts = stage(_line_texts(near.join(_ends(close), "id"), docs, name, id_col, text_col), f"{name}-texts", compression="zstd")
    words = [F.array_distinct(F.split(f"norm_{c}", " ")) for c in "ab"]
    # lines that share a window by chance (common words) share few others: they are no candidates
    alike = F.size(F.array_intersect(*words)) >= SHARED_WORDS * F.greatest(*[F.size(w) for w in words])
    both = close.join(side(texts, "a", "norm"), "a").join(side(texts, "b", "norm"), "b").where(alike)
    return both.where(_edits_within("norm_a", "norm_b", "most")).select("a", "b")


def _pairs_of_blocks(similarity: float, worded: bool, texts: bool) -> Callable[[pa.Table], pa.Table]:
    """The pairs of two blocks of a bucket (or of one with itself) for ``_open_pairs``."""

    def pairs(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chars"])
        own = rows[0]["x"] == rows[0]["y"]
        parent: dict[int, int] = {}

        def find(label: int) -> int:
            while (up := parent.get(label, label)) != label:
                parent[label] = label = parent.get(up, up)
            return label

        sketches: dict[int, list[int]] = defaultdict(list)                 # the rows before with a word hash in their sketch
        found = []
        for j, two in enumerate(rows):
            two["keys"] = set(two["keys"])
            if worded:
                two["words"] = set(two["words"])
            most = math.floor(two["chars"] * (1 - similarity) + 1e-9)
            common = Counter()
            for h in two["sketch"]:
                common.update(sketches[h])
                sketches[h].append(j)
            for i, shared in common.most_common():                         # the likeliest first: what they tie need not be compared
                one = rows[i]
                if two["chars"] - one["chars"] > most or not own and one["block"] == two["block"] \
                        or shared < SHARED_WORDS * max(len(one["sketch"]), len(two["sketch"])) or find(one["label"]) == find(two["label"]) \
                        or (both := sorted(one["keys"] & two["keys"]))[(one["id"] + two["id"]) % len(both)] != two["key"]:     # in one of its buckets alone
                    continue
                if worded:
                    # no pair is lost to words of equal hash: of the common words at most so many have one hash with another
                    unseen = min(x["n_words"] - len(x["words"]) for x in (one, two))
                    if len(one["words"] & two["words"]) + unseen < SHARED_WORDS * max(one["n_words"], two["n_words"]):
                        continue
                if texts:
                    if not edits_within(one["norm"], two["norm"], most):
                        continue
                    same = set(one["norm"].split(" ")) & set(two["norm"].split(" "))            # different words may have one hash
                    if len(same) < SHARED_WORDS * max(one["n_words"], two["n_words"]):
                        continue
                    parent[find(one["label"])] = find(two["label"])
                found.append((min(one["id"], two["id"]), max(one["id"], two["id"])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return pairs


def _open_pairs(members: DataFrame, groups: DataFrame, lines: DataFrame, similarity: float, words: DataFrame | None = None) -> DataFrame:
    """All pairs (a, b), a < b, of lines with a common key but not in one group, of like lengths and with enough of their sketches
    and, where ``words`` of ``line_words`` are given, of their words in common: what ``_verified`` asks of candidates. Where these
    have the texts (``norm``) too, the pairs are compared on the spot: of the pairs that reach the similarity those are returned that tie
    the groups which such pairs tie, at most one fewer than lines for two blocks.

    ``members`` has columns ``key, id``. The lines of a key are dealt over blocks, and each pair of blocks is a group of its own:
    the work of a large bucket is spread over tasks, each with two blocks at a time. Only the pairs found are written; those looked at
    still grow with the square of a bucket whose lines stay apart.
    """
    named = members.select("key", "id").distinct().join(groups.withColumnRenamed("node", "id"), "id", "left") \
        .join(lines.select("id", "chars"), "id").select("key", "id", "chars", F.coalesce("root", "id").alias("label"))
    named = stage(named, "line-relabelled")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_LINES, F.sum("chars") / BLOCK_LETTERS)).cast("int").alias("blocks")
    sizes = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), blocks).where("lo < hi").select("key", "blocks")
    known = lines.select("id", "chars", "sketch")
    if words is not None:
        known = known.join(words, "id")
    buckets = named.join(sizes, "key").groupBy("id", "label").agg(F.collect_list("key").alias("keys"), F.collect_list(F.struct("key", "blocks")).alias("buckets"))
    rows = stage(buckets.join(known, "id"), "line-blocks")
    rows = rows.select("*", F.explode("buckets").alias("bucket")).select("*", "bucket.key", F.pmod(F.xxhash64("id"), F.col("bucket.blocks")).cast("int").alias("block"),
                                                                        F.explode(F.sequence(F.lit(0), F.col("bucket.blocks") - 1)).alias("other")) \
        .withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("bucket", "buckets", "other")      # every two blocks meet once
    return rows.groupBy("key", "x", "y").applyInArrow(_pairs_of_blocks(similarity, "words" in known.columns, "norm" in known.columns), "a long, b long")


def line_groups(docs: DataFrame, similarity: float = 0.8, min_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per different normalised line with a word: ``id, h1, h2, doc_id, t1, t2, line_no, n, root``, the row and number
    of its first occurrence, the number of occurrences and the group.

    A bucket of lines with an equal key links every line to its smallest one, at most as many pairs as there are keys. That spares most
    comparisons, but ties lines to one centre alone: of the buckets that it leaves in different groups, the lines of different
    groups are compared with each other too (``_open_pairs``) until they are tied, so lines with a common key are never left apart unseen.
    """
    spark = docs.sparkSession
    found = docs.select(*row_key(id_col, text_col), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line_no", "line")) \
        .where(_worded(F.col("line"))).withColumn("norm", normalised(F.col("line"))).withColumns(dict(zip(("h1", "h2"), _key(F.col("norm")))))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "t2", "line_no", "chars", "sketch")).alias("f")
    lines = found.withColumns({"chars": F.length("norm"), "sketch": sketch(F.col("norm"), min_words)}).groupBy("h1", "h2").agg(first, F.count("*").alias("n"))
    lines = stage(lines.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "f.doc_id", "f.t1", "f.t2", "f.line_no", "n", "f.chars", "f.sketch"), "lines")
    buckets = line_keys(lines)
    shared = stage(buckets.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).where("lo < hi"), "line-buckets")
    crowded = stage(shared.where("n > 2").select("key", "lo"), "line-crowded")
    crowd = stage(buckets.join(_small(crowded), "key"), "line-crowds")
    star = shared.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")) \
        .unionByName(crowd.where("node > lo").select(F.col("lo").alias("a"), F.col("node").alias("b"))).distinct()

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        return stage_alone(spark, "line-edges", lambda: _verified(pairs, lines, docs, similarity, name, id_col, text_col))

    def grouped(links: DataFrame) -> DataFrame:
        return stage_alone(spark, "line-groups", lambda: components(links, "line-groups"))

    edges = verified(star, "line-star")
    groups = grouped(edges)
    label = F.coalesce("root", "id")
    members = stage(crowd.select("key", F.col("node").alias("id")).join(groups.withColumnRenamed("node", "id"), "id", "left")
                    .select("key", "id", label.alias("label")), "line-members")
    open_keys = members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    unsettled = stage(members.join(open_keys, "key"), "line-open")
    own = stage(unsettled.select("id").distinct(), "line-open-ids")

    def open_links() -> DataFrame:
        words = line_words(lines.join(_small(own), "id", "left_semi"), docs, id_col, text_col)
        return _verified(_open_pairs(unsettled, groups, lines, similarity, words), lines, docs, similarity, "line-last", id_col, text_col)

    def labels(links: DataFrame) -> DataFrame:
        for c in "ab":
            links = links.join(groups.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
        return links.select(*[F.coalesce(f"root_{c}", c).alias(c) for c in "ab"])

    last = stage_alone(spark, "line-edges", open_links)
    out = lines.drop("chars", "sketch").join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("root", label)
    if last.isEmpty():
        return out
    tied = grouped(labels(last)).select(F.col("node").alias("root"), F.col("root").alias("first"))      # the roots of tied groups
    return out.join(tied, "root", "left").withColumn("root", F.coalesce("first", "root")).drop("first")


def kept_lines(groups: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, lines): the numbers of the lines that are the one kept occurrence of their group: its first by
    document id (null last), text and line number."""
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "t2", "line_no")).alias("f"))
    return first.groupBy("f.doc_id", "f.t1", "f.t2").agg(F.sort_array(F.collect_list(F.col("f.line_no"))).alias("lines"))


def dedup_lines(docs: DataFrame, similarity: float = 0.8, min_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, dropped`` (line numbers from 0), and ``t1, t2``, 128 bits of its text.

    Lines are \\n-split; those of fewer than ``min_words`` words are joined by their
    normalised form alone, those without a word stay. Of every group of lines, over all
    documents, the first occurrence by (doc_id, null last, then text, line number) stays. Rows that share a doc_id but not the
    text are documents of their own. Of rows equal in id and text one keeps its lines, the others are repeats from end to end:
    all their lines with a word are dropped. Null and empty texts have one empty line, an empty table
    gives no rows, other columns are not read.
    """
    kept = stage_alone(docs.sparkSession, "line-kept", lambda: kept_lines(line_groups(docs, similarity, min_words, id_col, text_col))) \
        .withColumnsRenamed({"doc_id": "_d", "t1": "_t1", "t2": "_t2"})
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    rows = docs.select(*row_key(id_col, text_col), F.transform(split, lambda x: _worded(x)).alias("worded")) \
        .groupBy("doc_id", "t1", "t2", "worded").agg(F.count("*").alias("copies"))
    out = rows.join(kept, same_row("_d", "_t1", "_t2"), "left")
    numbers = F.filter(F.sequence(F.lit(0), F.size("worded") - 1), lambda i: F.get("worded", i))
    first = out.select("doc_id", "t1", "t2", F.size("worded").cast("long").alias("n_lines"), numbers.alias("all"), "copies",
                       F.array_except(numbers, F.coalesce("lines", F.array().cast("array<int>"))).alias("dropped"))
    runs = first.where("copies > 1").withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies") - 1, F.lit(10_000).cast("long")))) \
        .repartition("t1", "t2", "from")
    again = runs.withColumn("copy", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + 9_999, F.col("copies") - 1)))).withColumn("dropped", F.col("all"))
    columns = ("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped", "t1", "t2")
    return first.select(*columns).unionByName(again.select(*columns))


def without_dropped(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the dropped lines cut out of its texts; all its columns, a text without drops unchanged.

    Of rows equal in id and text one stays with its kept lines, and the others, which have none left, go.
    """
    dropped = stage(dropped, "line-drops")
    rows = docs.select(F.struct("*").alias("row"), *row_key(id_col, text_col))                     # no name of docs can clash
    copies = dropped.groupBy("doc_id", "t1", "t2").agg(F.count("*").alias("n"), F.min("n_dropped").alias("least")).where("n > 1")
    copies = copies.select(F.col("doc_id").alias("_c"), F.col("t1").alias("_c1"), F.col("t2").alias("_c2"))
    if not copies.isEmpty():
        repeated = rows.join(copies, same_row("_c", "_c1", "_c2"), "left_semi").groupBy("doc_id", "t1", "t2").agg(F.first("row").alias("row"))
        rows = rows.join(copies, same_row("_c", "_c1", "_c2"), "left_anti").select("row", "doc_id", "t1", "t2") \
            .unionByName(repeated.select("row", "doc_id", "t1", "t2"))
    cut = dropped.where("n_dropped > 0").groupBy(F.col("doc_id").alias("_d"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2")) \
        .agg(F.min_by("dropped", "n_dropped").alias("gone"))
    old = F.col("row")[text_col]
    new = F.array_join(F.filter(F.split(old, "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), old).otherwise(new)
    joined = rows.join(cut, same_row("_d", "_t1", "_t2"), "left")
    return joined.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
