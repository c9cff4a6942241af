"""Toxicity by a bidirectional gated recurrent network with attention pooling over words and their characters.

Each position takes a word embedding and the mean embedding of the word's character n-grams (so unseen words
still have inputs). The network scores all overlapping windows of a text; the text's score is the
highest. Training is numpy backpropagation through time on a bounded sample of labelled training rows; since only
texts are labelled, the windows that carry a toxic text are chosen from the scores, in two rounds.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import crc_mod, long_ids, text_ids

DIM = 8
_EDGES = bytes(b for b in range(128) if not chr(b).isalnum())


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, ASCII letters in lower case, without ASCII punctuation at their ends."""
    return [w.strip(_EDGES) for w in text.encode("utf-8", "replace").lower().split()]


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word; the hashes of its character n-grams (3 to 5 bytes, word ends marked), word after word; and
    how many n-grams each has."""
    marked = [b"^" + (w or b"-") + b"$" for w in words]
    size = np.array([len(m) for m in marked], np.int64)
    flat = np.frombuffer(b"".join(marked) + bytes(5), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(words)), size)
    end = np.cumsum(size)[owner]
    rows, owners = [], []
    for n in (3, 4, 5):
        at = np.flatnonzero(np.arange(len(owner)) + n <= end)
        h = np.full(len(at), n, np.uint32)
        for k in range(n):
            h = (h ^ flat[at + k]) * np.uint32(16777619)
        rows.append((h ^ (h >> np.uint32(15))) * np.uint32(2654435761))
        owners.append(owner[at])
    rows, owners = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.array([zlib.crc32(w) for w in words], np.uint32), rows[order], np.bincount(owners, minlength=len(words))


def lookup(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Table row of every hash: its place in the sorted ``keys`` plus 1; row 0 is for all others."""
    if not len(keys):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, at + 1, 0)


class Vocabulary:
    """Numbers words from 1 on as they come; 0 stands for padding."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.words: list[bytes] = []

    def of(self, words: list[bytes]) -> list[int]:
        known = self.number
        try:
            return [known[w] for w in words]
        except KeyError:
            for w in words:
                if w not in known:
                    self.words.append(w)
                    known[w] = len(self.words)
            return [known[w] for w in words]


class WindowScorer:
    """Parameters and the passes of the network; ``window`` words a window, a new one every ``stride`` words. Only the
    words and n-grams of the given sorted hashes have embeddings, all others share a row of zeros."""

    def __init__(self, words: np.ndarray, grams: np.ndarray, units: int = 8, window: int = 32, stride: int = 16, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.units, self.window, self.stride, self.keys = units, window, stride, {"words": words, "grams": grams}
        p = {k: 0.1 * rng.standard_normal((len(v) + 1, DIM)).astype(np.float32) for k, v in self.keys.items()}
        for k in self.keys:
            p[k][0] = 0
        for d in "fb":
            p[f"w{d}"], p[f"i{d}"] = gru.init(rng, 2 * DIM, 3 * units), np.zeros(3 * units, np.float32)
            p[f"u{d}"] = gru.init(rng, units, 3 * units)
        p |= {"a": gru.init(rng, 2 * units, units), "v": gru.init(rng, units), "o": gru.init(rng, 2 * units), "c": np.full(1, -2, np.float32)}
        self.p, self.scale, self.shift = p, 1.0, 0.0

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """(words, 2 x DIM): the word embedding and the mean n-gram embedding."""
        if not words:
            return np.zeros((0, 2 * DIM), np.float32)
        word, grams, count = features(words)
        gram = self.p["grams"][lookup(self.keys["grams"], grams)]
        mean = np.add.reduceat(gram, np.cumsum(count) - count, axis=0) / count[:, None].astype(np.float32)
        return np.concatenate([self.p["words"][lookup(self.keys["words"], word)], mean], axis=1)

    def projections(self, x: np.ndarray, d: str) -> np.ndarray:
        """Input projections of padding, then of every input row."""
        pad = np.zeros((1, 3 * self.units), np.float32)
        pad[0, self.units:2 * self.units] = gru.HOLD
        return np.concatenate([pad, x @ self.p[f"w{d}"] + self.p[f"i{d}"]])

    def spans(self, n: int) -> list[tuple[int, int]]:
        return [(a, min(a + self.window, n)) for a in range(0, max(1, n - self.window + self.stride), self.stride)] if n else []

    def layout(self, texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """All windows of numbered texts: (window, windows) word numbers, 0 where a text ends, and their owners."""
        size = np.array([len(t) for t in texts], np.int64)
        many = np.where(size > 0, np.maximum(1, -(-(size - self.window) // self.stride) + 1), 0)
        owner = np.repeat(np.arange(len(texts)), many)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        flat = np.array([x for t in texts for x in t] + [0], np.int64)
        at = (np.cumsum(size) - size)[owner] + nth * self.stride
        end = np.cumsum(size)[owner]
        place = at[None, :] + np.arange(self.window)[:, None]
        return np.where(place < end[None, :], flat[np.minimum(place, len(flat) - 1)], 0), owner

    def score(self, x: np.ndarray, tables: dict[str, np.ndarray], lanes: int = 2048) -> np.ndarray:
        """Probabilities of windows (time, windows) of word numbers."""
        out = np.empty(x.shape[1])
        k = self.units
        for a in range(0, x.shape[1], lanes):
            w = x[:, a:a + lanes]
            h = np.empty((self.window, 2 * k, w.shape[1]), np.float32)
            for d, at in (("f", 0), ("b", k)):
                for t, state in gru.scan(tables[d], w, self.p[f"u{d}"], d == "b"):
                    h[t, at:at + k] = state
            at, vt = np.ascontiguousarray(self.p["a"].T), self.p["v"]
            top, bottom = np.zeros(w.shape[1], np.float32), np.full(w.shape[1], 1e-9, np.float32)
            for t in range(self.window):
                e = np.exp(vt @ np.tanh(at @ h[t])) * (w[t] > 0)
                bottom += e
                top += e * (self.p["o"] @ h[t])
            logit = top / bottom + self.p["c"]
            out[a:a + lanes] = gru.sigmoid(logit)
        return out

    def logits(self, texts: list[str], vocab: Vocabulary | None = None, inp: np.ndarray | None = None) -> np.ndarray:
        """The highest window logit of every text, -inf without words."""
        vocab = Vocabulary() if vocab is None else vocab
        x, owner = self.layout([vocab.of(tokens(t)) for t in texts])
        inp = self.inputs(vocab.words) if inp is None else np.concatenate([inp, self.inputs(vocab.words[len(inp):])])
        out = np.full(len(texts), -np.inf)
        if len(owner):
            p = self.score(x, {d: self.projections(inp, d) for d in "fb"}).clip(1e-7, 1 - 1e-7)
            np.maximum.at(out, owner, np.log(p / (1 - p)))
        return out

    def calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression of labels on logits, its scale kept near 1 by a penalty."""
        z, y = z[np.isfinite(z)], y[np.isfinite(z)]
        for _ in range(2000):
            error = gru.sigmoid(self.scale * z + self.shift) - y
            self.scale = max(0.05, self.scale - 0.02 * ((error * z).mean() + 0.02 * (self.scale - 1)))
            self.shift -= 0.2 * error.mean()

    def fit(self, x: np.ndarray, y: np.ndarray, vocab: Vocabulary, steps: int, batch: int = 256, seed: int = 1,
            left_out: float = 0.0, decay: float = 1e-4) -> None:
        """Cross entropy of windows ``x`` (time, windows) against ``y``; a quarter of each batch is positive, and words
        are left out at random."""
        rng, adam, p, k = np.random.default_rng(seed), gru.Adam(self.p, 0.03), self.p, self.units
        pos, neg = np.flatnonzero(y > 0.5), np.flatnonzero(y < 0.5)
        word, gram, many = features(vocab.words)
        word, gram = lookup(self.keys["words"], word), lookup(self.keys["grams"], gram)
        begin = np.cumsum(many) - many
        for step in range(steps):
            pick = np.concatenate([rng.choice(pos, batch // 4), rng.choice(neg, batch - batch // 4)])
            xb = np.where(rng.random((x.shape[0], len(pick))) < left_out, 0, x[:, pick])
            xb[0] = np.where(xb.any(axis=0), xb[0], x[0, pick])
            used, xb = np.unique(xb, return_inverse=True)
            xb = xb.reshape(x.shape[0], len(pick))
            if used[0] != 0:
                used, xb = np.concatenate([[0], used]), xb + 1
            yb, real = y[pick].astype(np.float32), used[1:] - 1
            count = many[real]
            first = np.cumsum(count) - count
            which = gram[np.repeat(begin[real] - first, count) + np.arange(count.sum())]
            inp = np.concatenate([p["words"][word[real]], np.add.reduceat(p["grams"][which], first, axis=0) / count[:, None].astype(np.float32)], axis=1)
            hs, kept = [], {}
            for d in "fb":
                s, kept[d] = gru.forward(self.projections(inp, d)[xb], p[f"u{d}"], d == "b", keep=True)
                hs.append(s)
            h = np.concatenate(hs, axis=2)
            q = np.tanh(h @ p["a"])
            e = np.where(xb > 0, q @ p["v"], -1e9)
            alpha = np.exp(e - e.max(axis=0))
            alpha /= alpha.sum(axis=0)
            pooled = (alpha[:, :, None] * h).sum(axis=0)
            dl = (gru.sigmoid(pooled @ p["o"] + p["c"]) - yb) / len(yb)
            g = {"o": pooled.T @ dl, "c": np.array([dl.sum()], np.float32)}
            dpool = dl[:, None] * p["o"]
            dalpha = (h * dpool).sum(axis=2)
            de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
            g["v"] = np.einsum("tn,tnk->k", de, q)
            dq = de[:, :, None] * p["v"] * (1 - q * q)
            g["a"] = np.einsum("tnj,tnk->jk", h, dq)
            dh = alpha[:, :, None] * dpool + dq @ p["a"].T
            dinp = np.zeros_like(inp)
            for d, at in (("f", 0), ("b", k)):
                dgx, g[f"u{d}"] = gru.backward(np.ascontiguousarray(dh[:, :, at:at + k]), kept[d], p[f"u{d}"])
                rows = np.zeros((len(used), 3 * k), np.float32)
                np.add.at(rows, xb.ravel(), dgx.reshape(-1, 3 * k))
                rows = rows[1:]
                g[f"w{d}"], g[f"i{d}"] = inp.T @ rows, rows.sum(axis=0)
                dinp += rows @ p[f"w{d}"].T
            g["words"], g["grams"] = np.zeros_like(p["words"]), np.zeros_like(p["grams"])
            np.add.at(g["words"], word[real], dinp[:, :DIM])
            np.add.at(g["grams"], which, np.repeat(dinp[:, DIM:] / count[:, None].astype(np.float32), count, axis=0))
            for name in self.keys:
                g[name] += decay * p[name]
                g[name][0] = 0
            adam.step(g, scale=0.5 * (1 + np.cos(np.pi * step / steps)))


def sample(docs: DataFrame, labels: DataFrame, positive: int = 600, negative: int = 1200, max_chars: int = 20_000,
           id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple[str, int]]:
    """(text, label) of at most ``positive`` and ``negative`` labelled training rows (crc32 mod 4 other than 2) of up to
    ``max_chars`` characters, by hash order. A document labelled more than once counts as toxic if any label says so."""
    y = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")) \
        .where(F.col("y").isNotNull() & (crc_mod("i", 4) != 2)).groupBy("i").agg(F.max("y").alias("y"))
    y = y.withColumn("h", F.xxhash64("i", F.lit(21)))
    # twice as many as wanted, as some are too long or not in the table; a top-k per label, so no label is sorted in one task
    y = y.where("y = 1").orderBy("h", "i").limit(2 * positive).union(y.where("y = 0").orderBy("h", "i").limit(2 * negative))
    d = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("text")).where(F.length("text").between(1, max_chars))
    rows = d.join(F.broadcast(y), "i").dropDuplicates(["i"]).collect()     # y has 2 x (positive + negative) rows at most
    out, left = [], {1: positive, 0: negative}
    for r in sorted(rows, key=lambda r: (r["y"], r["h"], r["i"])):
        if left[r["y"]]:
            left[r["y"]] -= 1
            out.append((r["text"], r["y"]))
    return out


def train(rows: list[tuple[str, int]], steps: tuple[int, ...] = (120, 80), least_z: float = 5.0, seed: int = 2, **shape) -> WindowScorer | None:
    """A scorer from labelled texts; None without texts of both labels. Four fifths of the texts of each label train
    the network, the others fit the scale and shift that turn a text's highest window logit into its probability."""
    parts = {y: [r for r in rows if r[1] == y] for y in (0, 1)}
    if not parts[0] or not parts[1]:
        return None
    held = {y: part[4::5] for y, part in parts.items()}
    model = _train([r for part in parts.values() for k, r in enumerate(part) if k % 5 != 4], steps, least_z, seed, **shape)
    if held[0] and held[1]:
        texts = [t for y in (0, 1) for t, _ in held[y]]
        model.calibrate(model.logits(texts), np.repeat([0, 1], [len(held[0]), len(held[1])]))
    return model


def _train(rows: list[tuple[str, int]], steps: tuple[int, ...], least_z: float, seed: int, **shape) -> WindowScorer:
    """The first round takes each toxic text's window by the log odds of its words, later rounds by the network's
    scores, which also pick the hardest clean windows."""
    vocab, rng = Vocabulary(), np.random.default_rng(seed)
    words = [tokens(t) for t, _ in rows]
    labels = np.array([y for _, y in rows])
    seen = {y: Counter(w for ws, z in zip(words, labels) if z == y for w in set(ws)) for y in (0, 1)}
    many = {y: (labels == y).sum() for y in (0, 1)}
    odds = {w: np.log((seen[1][w] + 0.1) / (many[1] + 0.2)) - np.log((seen[0][w] + 0.1) / (many[0] + 0.2)) if seen[1][w] + seen[0][w] > 2 else 0.0
            for w in seen[0] | seen[1]}
    numbers = [vocab.of(w) for w in words]
    weight = np.zeros(len(vocab.words) + 1)
    for w, k in vocab.number.items():
        weight[k] = max(0.0, odds[w])
    word, gram, many_grams = features(vocab.words)
    with_word = [np.bincount(np.concatenate([np.unique(n) for n, z in zip(numbers, labels) if n and z == y] + [[0]]).astype(np.int64),
                             minlength=len(weight))[1:] for y in (0, 1)]

    def telling(hashes: np.ndarray, of_word: np.ndarray) -> np.ndarray:
        """Hashes whose share of the toxic texts differs from that of the clean ones by ``least_z`` standard errors:
        the others could only be learned by heart."""
        keys, at = np.unique(hashes, return_inverse=True)
        a, b = (np.minimum(np.bincount(at, t[of_word]), many[y]) for y, t in enumerate(with_word))
        share = (a + b) / (many[0] + many[1])
        error = np.sqrt(share * (1 - share) * (1 / many[0] + 1 / many[1])) + 1e-9
        return keys[(np.abs(b / many[1] - a / many[0]) >= least_z * error) & (a + b >= 3)]

    each = np.arange(len(word))
    model = WindowScorer(telling(word, each), telling(gram, np.repeat(each, many_grams)), **shape)
    x, owner = model.layout(numbers)
    scores = weight[x].max(axis=0)
    for count in steps:
        order = np.lexsort((-scores, owner))
        rank = np.empty(len(owner), np.int64)
        first = np.searchsorted(owner, owner, "left")       # owners ascend
        rank[order] = np.arange(len(owner))
        rank -= first
        chosen = np.where(labels[owner] == 1, rank < 1, (rank < 2) | (rng.random(len(owner)) < 0.4))
        at = np.flatnonzero(chosen)
        model.fit(x[:, at], labels[owner[at]], vocab, count, seed=seed + count)
        inp = model.inputs(vocab.words)
        scores = model.score(x, {d: model.projections(inp, d) for d in "fb"})
    return model


def score_texts(docs: DataFrame, model: WindowScorer | None, chunk: int = 3_000_000, known_words: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the highest probability over all windows of the whole text; 0 for texts without words
    (null, empty), and for all when nothing was learned."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, inp = Vocabulary(), np.zeros((0, 2 * DIM), np.float32)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"].array]
            out = np.zeros(len(texts))
            a, size = 0, 0
            for b in range(len(texts) + 1):
                if model is not None and b > a and (b == len(texts) or size + len(texts[b]) > chunk):
                    if len(vocab.words) > known_words:
                        vocab, inp = Vocabulary(), inp[:0]
                    z = model.logits(texts[a:b], vocab, inp)
                    inp = np.concatenate([inp, model.inputs(vocab.words[len(inp):])])
                    out[a:b] = np.where(np.isfinite(z), gru.sigmoid(model.scale * np.maximum(z, -50) + model.shift), 0.0)
                    a, size = b, 0
                if b < len(texts):
                    size += len(texts[b])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": out.clip(0, 1)})

    return long_ids(text_ids(docs, id_col, text_col).mapInPandas(run, "doc_id string, score double"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``. Repeated rows get equal scores, an empty table
    gives no rows; labels are read from the training rows alone."""
    model = train(sample(docs, labels, id_col=id_col, text_col=text_col))
    return score_texts(docs, model, id_col=id_col, text_col=text_col) \
        .select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
