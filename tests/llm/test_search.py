"""Ranked search against a plain loop over all items and documents."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from orderlens.llm import search
from orderlens.llm.queries import op12_lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    counts = [(i, Counter(words(t))) for i, t in docs]
    total = sum(1 for _, c in counts if c)
    length = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            n = sum(c.values())
            m = 100 - 75 + (75 * n * total) // length if length else 0
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in words(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_plain_loop(spark):
    rnd = random.Random(3)
    vocabulary = ["the", "The", "of", "Größe", "größe", "naïve", "a1", "42", "日本", "x"] + [f"w{k}" for k in range(60)]
    docs = [(k, rnd.choice([" ", "-", "\n", "_"]).join(rnd.choices(vocabulary, k=rnd.randint(0, 40)))) for k in range(300)]
    docs += [(7, "the the of"), (7, "the the of"), (None, "the of w1"), (None, None), (301, ""), (302, "..."), (303, "w1 " * 40_000)]
    items = [(k, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 15)))) for k in range(40)]
    items += [(3, "the of the"), (None, "w1 w2"), (50, None), (51, "!!"), (52, "unseen"), (3, "the of the")]
    d = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("x") for c in ("n", "terms", "tf", "score", "item_id")})
    q = spark.createDataFrame(items, ITEMS).withColumns({c: F.lit("x") for c in ("doc_id", "rank", "item")})
    assert rows(search.search(d.repartition(6), q)) == plain(docs, items)
    assert rows(search.search(d, q.where("item_id = 3"), k=3)) == plain(docs, [i for i in items if i[0] == 3], 3)


def test_blocks_give_the_same_rows(spark, monkeypatch):
    docs = [(k, f"red w{k % 5} blue w{k % 3}") for k in range(50)]
    items = [(k, f"red w{k} w{k % 3} blue") for k in range(9)]
    d, q = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    monkeypatch.setattr(search, "BLOCK_ITEMS", 4)
    assert rows(search.search(d, q)) == plain(docs, items)
    monkeypatch.setattr(search, "BLOCK_PAIRS", 10)
    assert rows(search.search(d, q)) == plain(docs, items)


def test_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    assert rows(search.search(d.limit(0), q)) == [] and rows(search.search(d, q.limit(0))) == []


def test_shared_plan_scores_and_saves_sums():
    """Every item's root adds up exactly its terms with repeats, and sharing needs fewer additions than item by item."""
    rnd = random.Random(9)
    core = [[f"c{g}{k}".encode() for k in range(8)] for g in range(5)]
    items = [rnd.choice(core)[:rnd.randint(4, 8)] + rnd.choice(core)[:5] + [f"own{i}".encode()] for i in range(80)] + [[]]
    plan = search.share(items)
    value = np.array([rnd.randint(1, 10 ** 6) for _ in plan.vocabulary], np.int64)
    number = np.arange(len(plan.vocabulary))
    got = search.partial_scores(plan, number, np.zeros(len(number), int), value, 1)[:, 0]
    assert got.tolist() == [sum(int(value[plan.vocabulary[w]]) for w in item) for item in items]
    assert len(plan.sums) < sum(max(0, len(set(item)) - 1) for item in items) / 2


def test_query_on_the_tables(spark):
    path = "/root/testdata/sf0.01/"
    docs = [tuple(r) for r in spark.read.parquet(path + "documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(path + "benchmark.parquet").select("item_id", "text").collect()]
    assert rows(op12_lexical_search(spark, path)) == plain(docs, items)
