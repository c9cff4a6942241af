"""Ids that are missing, shared or too long for a double, and operators against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm import fuzzy_lines, gru, language, lattice, ngram_join, packing, quality, secrets, toxicity

BIG = 2 ** 53 + 1
KIND = "doc_id long, text string, lang string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "seven wise owls watch from an old oak tree near the river bank while the quick brown fox jumps over one lazy dog again and again today"


@pytest.fixture(scope="module")
def odd(spark):
    """Long, missing and shared ids in one partition, so in one batch."""
    rows = [(BIG, LONG, "en"), (None, LONG.replace("today", "now"), "en"), (5, "first of all " + LONG, "en"), (5, "nothing like it at all, really", "en"),
            (BIG + 2, "", None), (None, None, None), (BIG + 4, "password = hunter2hunter2", "en"), (None, "nothing like it at all, really", "en")]
    return spark.createDataFrame(rows, KIND).coalesce(1), [i for i, _, _ in rows]


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda i: (i is None, i or 0))


def test_ids_come_back_as_they_are(odd):
    docs, want = odd
    want = sorted(want, key=lambda i: (i is None, i or 0))
    labels = docs.select("doc_id", F.lit(0).alias("toxic"))
    for got in (ngram_join.ngram_join(docs), language.language_id(docs), lattice.lattice_scores(docs), fuzzy_lines.dedup_lines(docs),
                quality.quality_rules(docs), toxicity.toxicity(docs, labels), secrets.secret_spans(docs), packing.best_fit_packing(docs)):
        assert ids(got) == want


def test_links_go_by_text_not_by_id(odd):
    docs, _ = odd
    got = ngram_join.ngram_join(docs, threshold=0.7).select("doc_id", "class_key", "class_id", "n_links", "n_copies", "t1") \
        .join(docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t1")), "t1").collect()
    by = defaultdict(set)
    for r in got:
        by[r["class_key"]].add(r["text"] or "")
    near = {LONG, LONG.replace("today", "now"), "first of all " + LONG}
    assert near in by.values() and {"nothing like it at all, really"} in by.values()
    links = {r["text"]: r["n_links"] for r in got if r["text"]}
    assert links[LONG] == 2 and links["nothing like it at all, really"] == 1 and links["password = hunter2hunter2"] == 0
    assert {r["class_id"] for r in got if r["text"] in near} == {5}
    kept = ngram_join.one_of_each_class(docs, ngram_join.ngram_join(docs, threshold=0.7)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(5, "first of all " + LONG), (5, "nothing like it at all, really"), (BIG + 2, ""), (None, None),
                                                                       (BIG + 4, "password = hunter2hunter2")])


def test_links_and_classes_against_all_pairs(spark):
    """A chain of near copies, copies of one of them, and texts that only share a passage."""
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[:k] + [f"new{k}"] + words[k + 1:]) for k in range(0, 60, 6)] + [" ".join(words)] * 40
    texts += [" ".join(words[:20] + [f"x{j}-{k}" for k in range(40)]) for j in range(5)] + ["short one", "short one", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    grams = {}
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        n = min(5, len(w))
        grams[i] = frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if w else frozenset()
    linked = {i: [j for j in grams if j != i and grams[i] and grams[j] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])] for i in grams}
    root = {}
    for i in grams:
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root[i] = min(seen)
    for block in (4, 128):
        for r in ngram_join.ngram_join(docs, block=block).collect():
            i = r["doc_id"]
            assert (r["class_id"], r["n_links"]) == (root[i], len(linked[i]))
            assert r["n_classes"] == len({grams[j] for j in linked[i]} - {grams[i]})
            assert r["n_copies"] == (sum(g == grams[i] for g in grams.values()) if grams[i] else 1)


def test_shared_ids_in_line_dedup(spark):
    line = "one line that occurs in many a document of this table"
    rows = [(1, line + "\nown line of the first one here"), (5, "x y z 1\n" + line), (5, line + "\nsomething else that stands alone here"), (None, line), (7, "a b c d e\n" + line),
            (7, "a b c d e\n" + line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lines", F.lit("x"))
    left = Counter((r["doc_id"], r["text"]) for r in fuzzy_lines.without_dropped(docs, fuzzy_lines.dedup_lines(docs)).collect())
    assert left == Counter([(1, rows[0][1]), (5, "x y z 1"), (5, "something else that stands alone here"), (None, ""), (7, "a b c d e")])
    got = Counter((r["doc_id"], tuple(r["dropped"])) for r in fuzzy_lines.dedup_lines(docs).collect())
    assert got == Counter([(1, ()), (5, (1,)), (5, (0,)), (None, (0,)), (7, (1,)), (7, (0, 1))])


def test_packed_ids_with_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b c", "<|endoftext|>", LONG * 60, "", None, "x " * 5000, "\n<|endoftext|>\n"] + [f"text number {k % 7}" for k in range(500)]
    docs = spark.createDataFrame([(BIG + k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    rows = packing.pack(packing.pieces(docs, "byte_bpe_50k.json"), shard_rows=50).collect()
    parts = defaultdict(list)
    for r in rows:
        parts[r["doc_id"]].append(r)
    for k, t in enumerate(texts):
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(parts[BIG + k], key=lambda r: r["piece"]):
            assert r["start"] == at and zlib.crc32(np.array(want[at:at + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in bins.values():
        ends = np.cumsum([n for _, n in sorted(spans)])
        assert [a for a, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(bins) <= 1.05 * sum(r["length"] for r in rows) / 1024 + 2


def test_secrets_equal_plain_regular_expressions(spark):
    rules = {"assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
             "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20), "hex": (re.compile(r"[0-9a-f]+"), 0, 24)}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, None), (-2, "AKIA" * 9 + " " + "ab12" * 9 + " SECRET:'aaaaaa'"), (-3, "token=" + "x" * 200_000)], "doc_id long, text string")
    docs = docs.unionByName(more)
    got = {r["doc_id"]: r for r in secrets.span_digests(secrets.secret_spans(docs)).collect()}
    for r in docs.collect():
        spans = []
        for k, (kind, (regex, group, least)) in enumerate(rules.items()):
            spans += [(m.start(), k, kind, m.end()) for m in regex.finditer(r["text"] or "") if m.end(group) - m.start(group) >= least]
        spans.sort()
        count = Counter(s[2] for s in spans)
        text = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        out = got[r["doc_id"]]
        assert (out["n_assign"], out["n_access"], out["n_hex"]) == (count["assign"], count["access"], count["hex"])
        assert out["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def plain_base(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_counts_equal_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:7] for r in quality.quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert got == {r["doc_id"]: plain_base(r["text"]) for r in docs.select("doc_id", "text").collect()}


def test_jensen_shannon_distance(spark):
    p, q = [0.5, 0.25, 0.25, 0.0], [0.1, 0.2, 0.3, 0.4]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    want = math.sqrt(sum((a * math.log2(a / c) if a else 0) + (b * math.log2(b / c) if b else 0) for a, b, c in zip(p, q, m)) / 2)
    got = spark.range(1).select(quality._distance(F.array(*[F.lit(x) for x in p]), q)).first()[0]
    assert got == pytest.approx(want, abs=1e-12)


def test_recurrent_gradients_against_differences():
    rng = np.random.default_rng(1)
    gx, u, weight = rng.standard_normal((6, 3, 12)), rng.standard_normal((4, 12)), rng.standard_normal((6, 3, 4))
    for reverse in (False, True):
        states, saved = gru.forward(gx, u, reverse, keep=True)
        dgx, du = gru.backward(weight, saved, u)
        for array, grad in ((gx, dgx), (u, du)):
            for _ in range(12):
                at = tuple(rng.integers(0, n) for n in array.shape)
                old, eps = array[at], 1e-6
                array[at] = old + eps
                up = (gru.forward(gx, u, reverse) * weight).sum()
                array[at] = old - eps
                down = (gru.forward(gx, u, reverse) * weight).sum()
                array[at] = old
                assert grad[at] == pytest.approx((up - down) / (2 * eps), rel=1e-5, abs=1e-7)
    assert states.shape == (6, 3, 4)


def test_pooled_probabilities_are_means_over_positions():
    model = language.ByteTagger(["a", "b", "c"])
    texts = [b"some bytes of a text", b"x", b"", bytes(range(97, 123)) * 3]
    got = model.pooled(texts, window=1000, lanes=2)
    for t, mean in zip(texts, got):
        if t:
            one = model.positions(np.frombuffer(t, np.uint8).astype(np.int64)[:, None])[:, 0]
            assert mean == pytest.approx(one.mean(axis=0), abs=1e-5)
        else:
            assert not mean.any()


def test_lattice_sums_over_all_segmentations():
    rng = np.random.default_rng(2)
    pieces = ["", "▁", "▁a", "a", "b", "ab", "ba", "▁ab", "aba", "c"]
    bytes_at = np.zeros(256, np.int64)
    logp = np.log(rng.dirichlet(np.ones(len(pieces))))
    prob = {p: math.exp(x) for p, x in zip(pieces, logp) if p}

    def total(word):
        return sum(prob[word[:n]] * (total(word[n:]) if n < len(word) else 1) for n in range(1, len(word) + 1) if word[:n] in prob)

    words = ["a", "b", "ab", "aba", "ababab", "abcba", "ba"]
    got = lattice.Lattice(pieces, bytes_at, logp).forward(words)
    assert got == pytest.approx([math.log(total("▁" + w)) for w in words], abs=1e-9)


def test_base_scores_equal_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], [*lattice.tokens(r["text"]), None]) for r in docs.collect()]
    count = Counter(w for i, ws in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in lattice.lattice_scores(docs).collect()}
    for i, ws in rows:
        want = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)
        assert got[i]["base_score"] == pytest.approx(want, rel=1e-9) and got[i]["n_known"] == sum(count[w] > 0 for w in ws)
        assert got[i]["train_tokens"] == n and got[i]["n_tokens"] == len(ws) and got[i]["score"] < 0


def test_toxicity_learns_a_planted_word(spark):
    rng = np.random.default_rng(3)
    plain = [f"word{k}" for k in range(200)]
    rows = []
    for k in range(600):
        w = list(rng.choice(plain, 40))
        if k % 3 == 0:
            w[rng.integers(0, 40)] = "vilestuff"
        rows.append((k, " ".join(w), int(k % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = [(r["predicted"], rows[r["doc_id"]][2]) for r in toxicity.toxicity(docs, labels).where("held_out").collect()]
    assert len(got) > 100 and sum(p == y for p, y in got) >= 0.95 * len(got)
