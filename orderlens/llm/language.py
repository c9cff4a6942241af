"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte position of a whole text; a document's probabilities are the mean over its positions.
Training is numpy backpropagation through time on a bounded sample of snippets of labelled training rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import gru
from .common import crc_mod

PAD = 256
UNKNOWN = "und"


class ByteTagger:
    """Parameters: a table of input projections per byte and direction, recurrent weights, output weights."""

    def __init__(self, labels: list[str], units: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.labels, self.units = labels, units
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = 0.5 * rng.standard_normal((PAD + 1, 3 * units)).astype(np.float32)
            self.p[f"u{d}"] = gru.init(rng, units, 3 * units)
            self.p[f"v{d}"] = gru.init(rng, units, len(labels))
        self.p["c"] = np.zeros(len(labels), np.float32)
        self._pad()

    def _pad(self) -> None:
        for d in "fb":
            self.p[f"x{d}"][PAD] = 0
            self.p[f"x{d}"][PAD, self.units:2 * self.units] = gru.HOLD

    def _logits(self, x: np.ndarray, keep: bool = False):
        out, kept = self.p["c"], {}
        for d in "fb":
            got = gru.forward(self.p[f"x{d}"][x], self.p[f"u{d}"], d == "b", keep)
            states, kept[d] = got if keep else (got, None)
            out = out + states @ self.p[f"v{d}"]
            kept[d + "s"] = states
        return out, kept

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 200, batch: int = 256, seed: int = 4) -> None:
        """``x`` (time, snippets) byte numbers, ``y`` the label number of each snippet: cross entropy at every position."""
        rng, adam = np.random.default_rng(seed), gru.Adam(self.p, 0.03)
        for step in range(steps):
            pick = rng.integers(0, x.shape[1], min(batch, x.shape[1]))
            xb, yb = x[:, pick], y[pick]
            z, kept = self._logits(xb, keep=True)
            dz = self._softmax(z)
            dz[:, np.arange(len(yb)), yb] -= 1
            dz *= (xb != PAD)[:, :, None] / np.float32(max(1, (xb != PAD).sum()))
            grads = {"c": dz.sum(axis=(0, 1))}
            for d in "fb":
                grads[f"v{d}"] = np.einsum("tnk,tnc->kc", kept[d + "s"], dz)
                dgx, grads[f"u{d}"] = gru.backward(dz @ self.p[f"v{d}"].T, kept[d], self.p[f"u{d}"])
                table = np.zeros_like(self.p[f"x{d}"])
                np.add.at(table, xb.ravel(), dgx.reshape(-1, dgx.shape[2]))
                grads[f"x{d}"] = table
            adam.step(grads, scale=0.5 * (1 + np.cos(np.pi * step / steps)))
            self._pad()

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the labels at every position of windows ``x`` (time, windows)."""
        return self._softmax(self._logits(x)[0])

    def pooled(self, texts: list[bytes], window: int = 96, lanes: int = 1536) -> np.ndarray:
        """Mean probabilities per text over all its bytes. Texts are cut into windows, which run as parallel lanes."""
        sizes = np.array([len(t) for t in texts], np.int64)
        out = np.zeros((len(texts), len(self.labels)))
        flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16)         # PAD is no byte
        starts = np.cumsum(sizes) - sizes
        many = -(-sizes // window)
        owner = np.repeat(np.arange(len(texts)), many)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        begin = starts[owner] + nth * window
        length = np.minimum(window, sizes[owner] - nth * window)
        for a in range(0, len(owner), lanes):
            b, n = begin[a:a + lanes], length[a:a + lanes]
            steps = int(n.max())
            at = b[None, :] + np.arange(steps)[:, None]
            inside = np.arange(steps)[:, None] < n[None, :]
            x = np.where(inside, flat[np.minimum(at, len(flat) - 1)], PAD)
            z = np.empty((steps, len(self.labels), x.shape[1]), np.float32)
            z[:] = self.p["c"][:, None]
            for d in "fb":
                v = np.ascontiguousarray(self.p[f"v{d}"].T)
                for t, h in gru.scan(self.p[f"x{d}"], x, self.p[f"u{d}"], d == "b"):
                    z[t] += v @ h
            np.exp(z, out=z)                     # no overflow: states lie in (-1, 1)
            z *= (inside / z.sum(axis=1))[:, None, :]
            np.add.at(out, owner[a:a + lanes], z.sum(axis=0, dtype=np.float64).T)
        return out / np.maximum(sizes, 1)[:, None]


def snippets(docs: DataFrame, per_label: int = 400, cuts: int = 4, chars: int = 64,
             id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """(lang, snippet) of at most ``per_label`` training documents of every label, by hash order; a document gives
    ``cuts`` snippets of ``chars`` characters at hashed places. Training rows have a label and crc32 mod 4 other than 2."""
    d = docs.select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")) \
        .where(F.col("lang").isNotNull() & (F.length("text") > 0) & (crc_mod("i", 4) != 2))
    h = lambda k: F.xxhash64(F.col("i").cast("string"), F.lit(k))
    place = [F.pmod(h(k), F.greatest(F.length("text") - chars, F.lit(1))).cast("int") + 1 for k in range(cuts)]
    d = d.select("lang", h(99).alias("h"), F.array(*[F.substring("text", p, F.lit(chars)) for p in place]).alias("s"))
    d = d.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "s"))).where(F.col("r") <= per_label)
    return [(r["lang"], s) for r in sorted(d.collect(), key=lambda r: (r["lang"], r["r"])) for s in r["s"]]


def train(samples: list[tuple[str, str]], units: int = 8, chars: int = 64, **fit) -> ByteTagger | None:
    """A tagger from (label, snippet) pairs; None without any."""
    labels = sorted({a for a, _ in samples})
    if not labels:
        return None
    x = np.full((chars, len(samples)), PAD, np.int64)
    for k, (_, s) in enumerate(samples):
        b = np.frombuffer(s.encode("utf-8", "replace")[:chars], np.uint8)
        x[:len(b), k] = b
    model = ByteTagger(labels, units)
    model.fit(x, np.array([labels.index(a) for a, _ in samples]), **fit)
    return model


def identify(docs: DataFrame, model: ByteTagger | None, id_col: str = "doc_id", text_col: str = "text",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id, lang_pred, score`` and the columns named in ``keep`` as they are.

    ``lang_pred`` is the most probable label of the pooled probabilities over the whole text and ``score`` that
    probability; ``und`` with score 0 if the text is null or has no letter, or nothing was learned.
    Repeated rows get equal results, an empty table gives no rows.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col).alias("_text"))
    schema = d.drop("_text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:       # Arrow, not pandas: a null would turn a batch's integers into doubles
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            letters = [any(map(str.isalpha, t)) for t in texts]
            raw = [t.encode("utf-8", "replace") if ok else b"" for t, ok in zip(texts, letters)]
            if model is None or not any(letters):
                lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                p = model.pooled(raw)
                best = p.argmax(axis=1)
                lang = [model.labels[k] if ok else UNKNOWN for k, ok in zip(best, letters)]
                score = np.where(letters, p.max(axis=1), 0.0).clip(0, 1)
            kept = [batch.column(c) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=names)

    return d.mapInArrow(run, schema)


def language_id(docs: DataFrame, units: int = 8, per_label: int = 400, id_col: str = "doc_id", text_col: str = "text",
                lang_col: str = "lang") -> DataFrame:
    """Train on the training rows of ``docs`` and label all rows: ``doc_id, held_out, lang_pred, score``."""
    model = train(snippets(docs, per_label, id_col=id_col, text_col=text_col, lang_col=lang_col), units)
    return identify(docs, model, id_col, text_col) \
        .select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
