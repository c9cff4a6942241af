"""The fitted lattice model against plain Python: whole words as pieces, the discount, scores of whole texts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm import lattice
from orderlens.llm.common import crc_mod


def plain_word(word, prob, byte_prob):
    """Marginal over the vocabulary's segmentations; a character that is no piece is spelled in bytes."""
    text = "▁" + word
    alpha = [1.0] + [0.0] * len(text)
    for i in range(len(text)):
        for n in range(1, len(text) - i + 1):
            piece = text[i:i + n]
            p = prob.get(piece)
            if p is None and n == 1:
                p = math.prod(byte_prob[b] for b in piece.encode())
            alpha[i + n] += alpha[i] * (p or 0.0)
    return alpha[-1]


def test_scores_equal_plain_python(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(
        ["the old owl sat in the oak", "The owl saw a fox, the fox saw the owl", "zqx über 東京 the", "", None, "fox fox fox oak tree near the river"] * 3
        + ["the lonely rivers"])], "doc_id long, text string")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (crc_mod("doc_id", 7) == 2).alias("held_out"))
    ends = rows.where("not held_out").count()
    vocab = lattice.vocabulary("piece_bpe_32k.model")
    model = lattice.fit(lattice.word_counts(rows), ends, vocab)
    pieces, bytes_at, _ = vocab
    prob = {p: math.exp(x) for p, x in zip(pieces, model.logp) if p}
    byte_prob = [math.exp(model.logp[bytes_at[b]]) for b in range(256)]
    train = Counter(w.decode() for r in rows.where("not held_out").collect() for w in lattice.tokens(r["text"]))
    n1, n2 = (sum(c == k for c in train.values()) for k in (1, 2))
    assert model.discount == pytest.approx(n1 / (n1 + 2 * n2) if n1 else 0.0)
    # probabilities of all pieces, whole words and the end are one distribution
    whole = {w: (c - model.discount) / model.total for w, c in train.items()}
    assert math.fsum(np.exp(model.logp)) + sum(whole.values()) + math.exp(model.end) == pytest.approx(1.0, abs=1e-6)
    got = {r["doc_id"]: r["score"] for r in lattice.lattice_scores(docs).collect()}
    for r in rows.collect():
        want = sum(math.log10(plain_word(w.decode(), prob, byte_prob) + whole.get(w.decode(), 0.0)) for w in lattice.tokens(r["text"]))
        assert got[r["doc_id"]] == pytest.approx(want + model.end / math.log(10), rel=1e-8)


def test_model_grows_with_the_corpus(spark):
    """A made-up word that the vocabulary spells in many pieces is cheap once the training rows hold it often."""
    def score(times):
        rows = [(k, "plain words of a text" + (" xqvzkwjy" if k < times else "")) for k in range(60)] + [(1000, "xqvzkwjy")]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        return {r["doc_id"]: r["score"] for r in lattice.lattice_scores(docs).collect()}[1000]
    assert score(40) > score(0) + 2


def test_no_training_rows(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    docs = spark.createDataFrame([(i, "one word") for i in held], "doc_id long, text string")
    got = lattice.lattice_scores(docs).collect()
    assert len(got) == 2 and all(math.isfinite(r["score"]) and r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)
