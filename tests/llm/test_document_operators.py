"""Document operators on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orderlens.llm import dedup_stream, fuzzy_lines, language, lattice, mixing, ngram_join, packing, quality, secrets, toxicity

BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bank"
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, "123 456", None, "b"),
    (6, BASE.replace("owls", "cats") + "\n" + BASE, "en", None), (7, "password = hunter2hunter2\nAKIA" + "A1B2" * 5, "en", "b"),
    (8, " ".join(f"mot{k % 97}" for k in range(6000)), "fr", "c"), (9, BASE, "en", "c"), (9, BASE, "en", "c"),
    (10, "deadbeef" * 4 + " le chat noir", "fr", "a"),
]
KIND = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, KIND)
    for c in ("size", "node", "key", "id", "root", "kept", "length", "row"):       # names that operators use inside
        d = d.withColumn(c, F.lit("x"))
    return d


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_ngram_join(docs, empty):
    got = {r["doc_id"]: r for r in ngram_join.ngram_join(docs).collect()}
    assert {got[i]["class_id"] for i in (1, 2, 9)} == {1} and got[1]["n_copies"] == 4 and got[1]["n_links"] == 3
    assert got[3]["n_links"] == got[4]["n_links"] == 0 and got[3]["class_id"] == 3
    assert ngram_join.ngram_join(empty).count() == 0


def test_choose_bands():
    bands, rows = ngram_join.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.999 and 1 - (1 - 0.1 ** rows) ** bands <= 1e-4


def test_mixing(docs, empty):
    got = mixing.mix(docs, block=2, shard_words=50).collect()
    assert len(got) == len(ROWS) and sum(r["size"] for r in got) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in ROWS)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.05 * own[0]["target"] + 8
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5), block=2, shard_words=50).collect()))
    assert mixing.mix(empty).count() == 0


def test_stream_dedup(spark, docs, tmp_path):
    path = str(tmp_path / "documents.parquet")
    docs.repartition(4).write.parquet(path)
    for digest in (dedup_stream.sha256, lambda t: F.length(t).cast("string")):          # the second one clashes
        got = dedup_stream.exact_dedup(spark, path, digest=digest, files_per_batch=1).collect()
        groups = Counter(t or "" for _, t, _, _ in ROWS)
        last = {t: max(i for i, u, _, _ in ROWS if (u or "") == t) for t in groups}
        texts = {i: t or "" for i, t, _, _ in ROWS}
        assert len(got) == len(ROWS) and sum(r["kept"] for r in got) == len(groups)
        for r in got:
            t = texts[r["doc_id"]]
            assert (r["group_size"], r["keep_id"], r["text_sha256"]) == (groups[t], last[t], hashlib.sha256(t.encode()).hexdigest())


def test_lattice(docs, empty):
    got = {r["doc_id"]: r for r in lattice.lattice_scores(docs).collect()}
    assert got[3]["n_tokens"] == 1 and got[3]["score"] == got[4]["score"] and all(r["score"] <= 0 for r in got.values())
    train = Counter(w for i, t, _, _ in ROWS if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*lattice.tokens(t), None])
    assert got[1]["train_tokens"] == sum(train.values())
    assert got[8]["n_known"] == sum(train[w] > 0 for w in [*lattice.tokens(ROWS[7][1]), None])
    assert lattice.lattice_scores(empty).count() == 0


def test_line_dedup(docs, empty):
    got = {r["doc_id"]: r for r in fuzzy_lines.dedup_lines(docs).collect()}
    assert got[1]["dropped"] == [] and got[2]["dropped"] == [0] and 1 in got[6]["dropped"] and got[3]["n_lines"] == 1
    assert fuzzy_lines.dedup_lines(empty).count() == 0


def test_quality(docs, empty):
    got = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    assert got[3]["n_words"] == 0 and got[3]["base_failed"] and not got[3]["kept"] and got[1]["n_repeat_words"] == 0
    assert got[8]["n_repeat_words"] == 6000 and got[8]["base_failed"]
    assert quality.quality_rules(empty).count() == 0


def test_packing(docs, empty):
    got = packing.best_fit_packing(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r["doc_id"] == 3 for r in got) == 1 and packing.best_fit_packing(empty).count() == 0


def test_chunked_ids_equal_whole_ids():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, mine = Tokenizer.from_file(path), packing.WordEncoder(path)
    for t in ["x<|endoftext|>", "<|endoftext|><|endoftext|>\n y", "a <|endoftext|> b\nc", "<|endoftext", "a  b", " x", "x ", "a\nb", "a \n b", "\n\n", "l'été 12,5%", "a b c", "<|endoftext|> x", "it's\tok", BASE, "日本 語"]:
        ids = memoryview(mine.encode(t)).cast("I").tolist()
        assert ids == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_secrets(docs, empty):
    got = {r["doc_id"]: r for r in secrets.span_digests(secrets.secret_spans(docs)).collect()}
    assert (got[7]["n_assign"], got[7]["n_access"], got[10]["n_hex"], got[3]["spans"]) == (1, 1, 1, "")
    assert secrets.secret_spans(empty).count() == 0
    assert secrets.trigram_query("[0-9a-f]+") is True and secrets.trigram_query("AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))


def test_models_without_labels(docs, empty):
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.language_id(none).collect()} == {"und"}
    assert language.language_id(empty).count() == 0
    labels = docs.select("doc_id", F.lit(0).alias("toxic"))
    assert {r["score"] for r in toxicity.toxicity(docs, labels).collect()} == {0.0}


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.language_id(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_common_words_in_one_pass(spark):
    from orderlens.llm import quality
    known = ["a.b", "\\E|x", "the", "und"]
    df = spark.createDataFrame([("The (the) other the, und\tUND! a.b axb --\\E|x the the",), ("",)], "text string")
    got = [r[0] for r in df.select(quality.common_words(F.col("text"), known)).collect()]
    want = [w for w in ["the", "the", "other", "the", "und", "und", "a.b", "axb", "\\e|x", "the the"] if w in known]
    assert got == [want, []]


def test_common_words_equal_the_plain_pattern(spark):
    known = ["the", "to", "of", "de", "a.b", "\\e", "x\\Ey", "l'a", "t"]
    texts = ["the. ..the a.b .a.b. «de» ‘le’la ..of..", "a\n.of.\tthe to-the-of- - the—of", "x\\Ey \\e l'a t, .T to.the (to)", "...", "", None]
    edge, end = r"(?<![^\x20\x09-\x0D])", r"(?![^\x20\x09-\x0D])"
    bare = F.lower(F.regexp_replace("text", rf"{edge}\p{{P}}+|\p{{P}}+{end}", ""))
    plain = F.filter(F.split(bare, r"[\x20\x09-\x0D]+"), lambda w: w.isin(known))
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(quality.common_words(F.col("text"), known).alias("got"), plain.alias("want")).collect()
    assert all(r["got"] == r["want"] for r in rows) and sum(len(r["got"] or []) for r in rows) >= 12
