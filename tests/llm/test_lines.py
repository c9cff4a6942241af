"""Line deduplication against all pairs of lines by edit similarity, whatever the candidate search."""

import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from orderlens.llm import fuzzy_lines
from orderlens.llm.common import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string"


def within(a, b, k):
    """Whether the edit distance is at most ``k`` (columns of the table as bits of one number)."""
    at = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    more, less, score = full, 0, len(a)
    for j, c in enumerate(b, 1):
        eq = at.get(c, 0)
        x, d = eq | less, (((eq & more) + more) ^ more) | eq
        up, down = less | ~(d | more) & full, more & d
        score += bool(up & top) - bool(down & top)
        if score - (len(b) - j) > k:
            return False
        up, down = (up << 1 | 1) & full, down << 1 & full
        more, less = down | ~(x | up) & full, up & x
    return score <= k


def near_pairs(lines, similarity=0.8):
    lines = sorted(lines, key=len)
    bags = [Counter(x[k:k + 2] for k in range(len(x) - 1)) for x in lines]
    out = []
    for i, x in enumerate(lines):
        for j in range(i + 1, len(lines)):
            k = int(len(lines[j]) * (1 - similarity) + 1e-9)
            if len(lines[j]) - len(x) > k:
                break
            # an edit changes at most two pairs of neighbouring letters
            if (bags[i] & bags[j]).total() >= len(lines[j]) - 1 - 2 * k and within(x, lines[j], k):
                out.append((x, lines[j]))
    return out


def groups_by_line(docs):
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")) \
        .select("doc_id", "line_no", fuzzy_lines.normalised(F.col("line")).alias("line"))
    return {r["line"]: r["root"] for r in fuzzy_lines.line_groups(docs).join(lines, ["doc_id", "line_no"]).collect()}


def test_recall_and_precision_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    root = groups_by_line(docs)
    pairs = near_pairs([x for x in root if len(x.split(" ")) >= 4])
    together = sum(root[a] == root[b] for a, b in pairs)
    assert len(pairs) >= 40 and together >= 0.9 * len(pairs)
    joined, size = {x for p in pairs for x in p}, Counter(root.values())
    assert all(x in joined for x, r in root.items() if size[r] > 1)


@pytest.mark.parametrize("words", [5, 7, 10, 11, 36])
def test_one_changed_word_is_found(spark, words):
    one = [f"{chr(97 + k % 26)}word{k}" for k in range(words)]
    rows = []
    for k in range(words):
        named = [f"{w}q{k}" for w in one]
        rows += [(2 * k, " ".join(named)), (2 * k + 1, " ".join([*named[:k], named[k][:-2] + "zz", *named[k + 1:]]))]
    got = {r["doc_id"]: r["n_dropped"] for r in fuzzy_lines.dedup_lines(spark.createDataFrame(rows, KIND)).collect()}
    assert sum(got.values()) >= 0.9 * words and not any(got[2 * k] for k in range(words))


def test_short_lines_are_joined_by_their_exact_form(spark):
    rows = [(1, "and so\nand so on"), (2, "And  so\n\n \t\n"), (3, "and sa\nand so"), (4, "\n\n"), (5, "and so on")]
    got = {r["doc_id"]: r["dropped"] for r in fuzzy_lines.dedup_lines(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {1: [], 2: [0], 3: [1], 4: [], 5: [0]}


def test_near_copies_of_a_very_long_line_are_found(spark):
    words = [f"w{k}" for k in range(17_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["new", *words[1:500], *words[501:]]))]
    got = {r["doc_id"]: r["dropped"] for r in fuzzy_lines.dedup_lines(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {1: [], 2: [0]}


def test_near_lines_in_one_crowded_bucket_are_all_found(spark):
    # words of small hashes in all lines, of large hashes in one pair alone: every line has the same sketch, so the same buckets
    vocabulary = spark.range(3000).select(F.concat(F.lit("w"), F.md5(F.col("id").cast("string"))).alias("w")).select(F.substring("w", 1, 14).alias("w"))
    words = [r["w"] for r in vocabulary.orderBy(F.xxhash64("w")).collect()]
    common, others = words[:fuzzy_lines.SKETCH_WORDS], words[100:]
    rows = []
    for k in range(20):
        own = others[40 * k:40 * k + 14]
        for j in range(2):
            rows.append((2 * k + j, " ".join([*common, *own, others[40 * k + 20 + j]])))
    got = {r["doc_id"]: r["dropped"] for r in fuzzy_lines.dedup_lines(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {i: [0] if i % 2 else [] for i in range(40)}


def test_pairs_of_a_bucket_do_not_depend_on_its_blocks(spark, monkeypatch):
    lines = spark.range(60).select("id", F.lit(100).alias("chars"), F.array([F.lit(k) for k in range(1, 12)]).cast("array<bigint>").alias("sketch"))
    members = lines.select(F.lit(7).cast("long").alias("key"), "id")
    groups = spark.createDataFrame([(5, 5), (9, 5)], "node long, root long")
    want = {(a, b) for a in range(60) for b in range(a + 1, 60)} - {(5, 9)}
    for size in (512, 7):
        monkeypatch.setattr(fuzzy_lines, "BLOCK_LINES", size)
        got = [(r["a"], r["b"]) for r in fuzzy_lines._open_pairs(members, groups, lines, 0.8).collect()]
        assert len(got) == len(want) and set(got) == want


def test_lines_that_share_common_words_alone_are_not_paired(spark, monkeypatch):
    # eleven words of small hashes in all lines, thirty of their own in each: one sketch and all its buckets, but two unlike lines each
    vocabulary = spark.range(6000).select(F.concat(F.lit("w"), F.md5(F.col("id").cast("string"))).alias("w")).select(F.substring("w", 1, 14).alias("w"))
    words = [r["w"] for r in vocabulary.orderBy(F.xxhash64("w")).collect()]
    common, others = words[:fuzzy_lines.SKETCH_WORDS], words[100:]
    rows = [(k, " ".join([*common, *others[30 * k:30 * k + 30]])) for k in range(40)]
    rows += [(100 + k, " ".join([*common, *others[30 * k:30 * k + 29], "another"])) for k in (3, 17)]
    asked, verified = {}, fuzzy_lines._verified

    def counted(pairs, lines, docs, similarity, name, *columns):
        pairs = fuzzy_lines.stage(pairs, "counted")
        asked[name] = pairs.count()
        return verified(pairs, lines, docs, similarity, name, *columns)

    monkeypatch.setattr(fuzzy_lines, "_verified", counted)
    got = {r["doc_id"]: r["n_dropped"] for r in fuzzy_lines.dedup_lines(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {k: int(k >= 100) for k, _ in rows} and asked["line-last"] <= 2


def test_words_of_one_hash_lose_no_pair(spark):
    # 4 of 10 words are common, two of them with one hash: 3 hashes are
    sketch = F.array([F.lit(k) for k in range(1, 12)]).cast("array<bigint>")
    lines = spark.range(2).select("id", F.lit(100).alias("chars"), sketch.alias("sketch"))
    members, groups = lines.select(F.lit(7).cast("long").alias("key"), "id"), spark.createDataFrame([], "node long, root long")
    for others, want in ((10, [(0, 1)]), (13, [])):
        words = spark.createDataFrame([(k, [1, 2, 3, *range(100 * k + 50, 100 * k + 46 + others)], others) for k in range(2)], "id long, words array<int>, n_words int")
        assert [tuple(r) for r in fuzzy_lines._open_pairs(members, groups, lines, 0.8, words).collect()] == want


def test_staged_tables_go_with_the_search(spark):
    root = Path(shared_dir(spark).removeprefix("file:")) / "llm"
    before = set(root.glob("*"))
    rows = [(k, f"one two three four five six seven eight nine line{k % 3} of{k}") for k in range(9)]
    out = fuzzy_lines.dedup_lines(spark.createDataFrame(rows, KIND))
    assert {x.name.rpartition("-")[0] for x in set(root.glob("*")) - before} == {"line-kept"} and out.count() == 9


def test_alike_lines_of_a_crowd_are_compared_without_writing_their_pairs(spark, monkeypatch):
    # 25 of 40 words are common to all lines: every pair has words enough in common and too many edits, but for two pairs
    vocabulary = spark.range(6000).select(F.concat(F.lit("w"), F.md5(F.col("id").cast("string"))).alias("w")).select(F.substring("w", 1, 14).alias("w"))
    words = [r["w"] for r in vocabulary.orderBy(F.xxhash64("w")).collect()]
    common, others = words[:25], words[100:]
    rows = [(k, " ".join([*common, *others[15 * k:15 * k + 15]])) for k in range(40)]
    rows += [(100 + k, " ".join([*common, *others[15 * k:15 * k + 14], "another"])) for k in (3, 17)]
    asked, verified = {}, fuzzy_lines._verified

    def counted(pairs, lines, docs, similarity, name, *columns):
        pairs = fuzzy_lines.stage(pairs, "counted")
        asked[name] = pairs.count()
        return verified(pairs, lines, docs, similarity, name, *columns)

    monkeypatch.setattr(fuzzy_lines, "_verified", counted)
    for size in (1024, 7):
        monkeypatch.setattr(fuzzy_lines, "BLOCK_LINES", size)
        got = {r["doc_id"]: r["n_dropped"] for r in fuzzy_lines.dedup_lines(spark.createDataFrame(rows, KIND)).collect()}
        assert got == {k: int(k >= 100) for k, _ in rows} and asked["line-last"] <= 2


def test_edits_within_counts_as_spark_does(spark):
    texts = ["", "a", "ab", "banana", "bandana", "a banana and a bandana", "the bandana and no banana", "über die brücke", "uber die bruecke", "🙂 is one letter", "x" * 70, "x" * 65 + "y"]
    rows = [(a, b, k) for a in texts for b in texts for k in (0, 1, 2, 5, 12, 70)]
    got = spark.createDataFrame(rows, "a string, b string, k int").select("a", "b", "k", F.expr("levenshtein(a, b)").alias("d")).collect()
    assert all(fuzzy_lines.edits_within(r["a"], r["b"], r["k"]) == (r["d"] <= r["k"]) for r in got)
