"""Language-model scores by a subword lattice: every segmentation of a text into vocabulary pieces counts.

Pieces never cross white space, so a text's marginal probability is the product over its words (and the end of the
text) of the words' marginals: log-space forward recursion over the lattice of a word's pieces. Every word of the
training rows is a piece too, one that only stands for the whole word, so what is gathered grows with the corpus.
Its weight is its count less a discount (the leaving-one-out estimate from the words seen once and twice); what is
discounted goes to the word's other segmentations, whose piece weights start from the scores of a public vocabulary
and are fitted by expectation maximisation over the table of all different words. That table is distributed, and the
weights of whole words stay in it; only statistics per piece of the vocabulary and a bounded number of the most
frequent words reach the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, long_ids, stage

_P = np.uint64(0x9E3779B97F4A7C15)
_START = "▁"


def vocabulary(name: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pieces of a public vocabulary file, the number of each byte's piece, and prior probabilities of the pieces: its
    scores fall by one with each rank, and ranks are given weights by Zipf's law."""
    import public_tokenizers
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    pieces, scores, bytes_at = [], [], np.zeros(256, np.int64)
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            continue
        if sp.is_byte(i):
            bytes_at[int(sp.id_to_piece(i)[1:-1], 16)] = len(pieces)
        pieces.append("" if sp.is_byte(i) else sp.id_to_piece(i))
        scores.append(-1e9 if sp.is_byte(i) else sp.get_score(i))
    rank = np.empty(len(pieces))
    rank[np.argsort(-np.array(scores), kind="stable")] = np.arange(len(pieces))
    prior = 1 / (rank + 20)
    return pieces, bytes_at, prior / prior.sum()


def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    h = (h ^ code) * _P
    return h ^ (h >> np.uint64(29))


class Lattice:
    """Forward and backward recursions over batches of words; ``logp`` holds natural logarithms per piece."""

    BITS = 22

    def __init__(self, pieces: list[str], bytes_at: np.ndarray, logp: np.ndarray):
        self.bytes_at, self.logp, self.none = bytes_at, logp, len(pieces)
        # nodes: every prefix of a piece, by hash; a node that is a whole piece knows its number
        nodes: dict[str, int] = {}
        for i, piece in enumerate(pieces):
            for n in range(1, len(piece) + 1):
                nodes.setdefault(piece[:n], -1)
            if piece:
                nodes[piece] = i
        self.hashes, self.piece = np.zeros(len(nodes) + 1, np.uint64), np.full(len(nodes) + 1, -1, np.int64)
        number = {}
        for k, (prefix, i) in enumerate(nodes.items()):       # a prefix is listed before what extends it
            before = self.hashes[number[prefix[:-1]]] if len(prefix) > 1 else np.uint64(0)
            self.hashes[k] = _step(np.array([before]), np.array([ord(prefix[-1])], np.uint64))[0]
            self.piece[k], number[prefix] = i, k
        self.tables, left = [], np.arange(len(nodes))
        while len(left):                                      # nodes that share a slot go to one more table
            slots = (self.hashes[left] >> np.uint64(64 - self.BITS)).astype(np.int64)
            _, first = np.unique(slots, return_index=True)
            table = np.full(1 << self.BITS, len(nodes), np.int32)
            table[slots[first]] = left[first]
            self.tables.append(table)
            left = np.delete(left, first)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Node of every hash, -1 for none."""
        slots = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        node = self.tables[0][slots]
        out = np.where(self.hashes[node] == h, node, -1)
        for table in self.tables[1:]:
            todo = np.flatnonzero((out < 0) & (node < len(self.hashes) - 1))      # other nodes may share the slot
            more = table[slots[todo]]
            good = self.hashes[more] == h[todo]
            out[todo[good]] = more[good]
        return out

    def _arcs(self, words: list[str]):
        """Lengths, and per start the arcs as (size, words that have one, piece numbers). Single characters outside the
        vocabulary get numbers of their own behind the pieces, made of byte pieces."""
        size = np.array([len(w) + 1 for w in words])
        width = int(size.max())
        text = "".join(_START + w + "\0" * (width - 1 - len(w)) for w in words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), width).astype(np.uint64).T
        codes = np.ascontiguousarray(codes)
        extra: dict[int, int] = {}
        arcs = []
        for i in range(width):
            live, row, n = np.flatnonzero(size > i), [], 0
            h = np.zeros(len(live), np.uint64)
            while len(live):
                h = _step(h, codes[i + n, live])
                n += 1
                node = self._find(h)
                piece = self.piece[node]            # node -1: the last entry, which is no piece
                if n == 1:
                    for k in np.flatnonzero(piece < 0):
                        piece[k] = self.none + extra.setdefault(int(codes[i, live[k]]), len(extra))
                has = piece >= 0
                row.append((n, live[has], piece[has]))
                on = (node >= 0) & (size[live] > i + n)
                live, h = live[on], h[on]
            arcs.append(row)
        spelled = [self.bytes_at[np.frombuffer(chr(c).encode("utf-8", "replace"), np.uint8)] for c in extra]
        logp = np.concatenate([self.logp, [self.logp[s].sum() for s in spelled]]) if spelled else self.logp
        return size, width, arcs, logp, spelled

    def forward(self, words: list[str]) -> np.ndarray:
        """Natural log of every word's marginal probability."""
        return self._forward(*self._arcs(words)[:4])[1]

    @staticmethod
    def _forward(size, width, arcs, logp):
        alpha = np.full((width + 1, len(size)), -np.inf)
        alpha[0] = 0
        for i in range(width):
            for n, at, piece in arcs[i]:
                alpha[i + n, at] = np.logaddexp(alpha[i + n, at], alpha[i, at] + logp[piece])
        return alpha, alpha[size, np.arange(len(size))]

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of every piece in ``counts`` copies of the words."""
        size, width, arcs, logp, spelled = self._arcs(words)
        alpha, total = self._forward(size, width, arcs, logp)
        beta = np.full((width + 1, len(size)), -np.inf)
        beta[size, np.arange(len(size))] = 0
        use = np.zeros(len(logp))
        for i in range(width - 1, -1, -1):
            for n, at, piece in arcs[i]:
                arc = logp[piece] + beta[i + n, at]
                beta[i, at] = np.logaddexp(beta[i, at], arc)
                np.add.at(use, piece, np.exp(alpha[i, at] + arc - total[at]) * counts[at])
        out = use[:self.none].copy()
        for k, s in enumerate(spelled):
            np.add.at(out, s, use[self.none + k])
        return out


def _batches(words: list[str], most: int = 4000, cells: int = 1_000_000) -> Iterator[np.ndarray]:
    """Places of words in batches of similar length, small enough for arrays of bounded size."""
    size = np.array([len(w) + 1 for w in words])
    order = np.argsort(size, kind="stable")
    a = 0
    while a < len(order):
        b = min(a + most, len(order))
        while b > a + 1 and (b - a) * size[order[b - 1]] * 8 > cells:
            b = a + max(1, (b - a) // 2)
        yield order[a:b]
        a = b


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def word_counts(rows: DataFrame, keep: int = 200_000) -> DataFrame:
    """(word, c, c_all): occurrences in training rows and in all rows, of every different word. Each task sums in a
    dictionary that it empties when it holds ``keep`` words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, other = Counter(), Counter()

        def flush():
            words = list(known.keys() | other.keys())
            out = pd.DataFrame({"word": [w.decode() for w in words], "c": [known[w] for w in words],
                                "c_all": [known[w] + other[w] for w in words]})
            known.clear()
            other.clear()
            return out

        for batch in batches:
            for text, held in zip(batch["text"].array, batch["held_out"].array):
                (other if held else known).update(tokens(text))
                if len(known) + len(other) > keep:
                    yield flush()
        if known or other:                    # a frame without rows would have columns of the wrong types
            yield flush()

    return rows.select("text", "held_out").mapInPandas(run, "word string, c long, c_all long") \
        .groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"))


class Fitted(NamedTuple):
    """Natural logs of the probabilities of the vocabulary's pieces and of the end of a text; a training word with count
    ``c`` is a piece of its own with probability (``c`` - ``discount``) / ``total``."""
    logp: np.ndarray
    end: float
    discount: float
    total: float

    def word_logs(self, lattice: Lattice, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Natural log of every word's marginal over all its segmentations, the whole word as one piece among them."""
        whole = np.maximum(np.where(counts > 0, counts - self.discount, 0.0), 0.0) / self.total
        with np.errstate(divide="ignore"):
            return np.logaddexp(lattice.forward(words), np.log(whole))


def fit(words: DataFrame, ends: int, vocab: tuple, rounds: int = 3, prior_count: float = 3200.0) -> Fitted:
    """Weights of all pieces. Each training word leaves ``discount`` uses, the share n1 / (n1 + 2 n2) by the numbers of
    words seen once and twice, to its segmentations by the vocabulary; these are fitted by ``rounds`` of expectation
    maximisation, in which the prior counts as ``prior_count`` uses."""
    pieces, bytes_at, prior = vocab
    logp, total = np.log(prior), 0.0
    known = words.where("c > 0").select("word", "c")
    t = known.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
    discount = t["n1"] / (t["n1"] + 2 * t["n2"]) if t["n1"] else 0.0
    whole = (t["n"] or 0) - discount * t["v"]
    for _ in range(rounds):
        def run(batches: Iterator[pd.DataFrame], logp=logp) -> Iterator[pd.DataFrame]:
            lattice, use = Lattice(pieces, bytes_at, logp), np.zeros(len(pieces))
            for batch in batches:
                w = batch["word"].tolist()
                for at in _batches(w):
                    use += lattice.expected([w[k] for k in at], np.full(len(at), discount))
            at = np.flatnonzero(use)
            yield pd.DataFrame({"piece": at, "uses": use[at]})

        use = np.zeros(len(pieces))
        # one row per piece of the vocabulary at most; sums in fixed point, so reruns agree
        for r in known.select("word").mapInPandas(run, "piece long, uses double").groupBy("piece") \
                .agg(F.sum(F.round("uses", 4).cast("decimal(30,4)")).cast("double").alias("uses")).collect():
            use[r["piece"]] = r["uses"]
        total = use.sum() + whole + ends + 1 + prior_count
        logp = np.log((use + prior_count * prior) / total)
    return Fitted(logp, float(np.log((ends + 1) / total)), discount, float(total))


def lattice_scores(docs: DataFrame, vocabulary_file: str = "piece_bpe_32k.model", heavy_words: int = 150_000, rounds: int = 3,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Training rows are those with crc32 of the id modulo 7 other than 2. Tokens: words between ASCII white space, ASCII
    letters in lower case, and the end of the text. ``base_score`` is the add-one unigram log10 probability, ``score``
    the lattice's marginal log10 probability of the whole text with its end, over segmentations into pieces of the
    vocabulary and whole training words. Words frequent enough to be among the
    ``heavy_words`` most frequent are looked up in the tasks (so bounded), all others by a shuffle on the word, which
    has no hot key. Null and empty texts are the end alone; repeated rows are scored one by one; an empty table
    gives no rows; columns other than the two named are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       (crc_mod(id_col, 7) == 2).alias("held_out"))
    words = stage(word_counts(rows), "lm-words")
    ends = rows.where("not held_out").count()
    t = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = (t["n"] or 0) + ends, (t["v"] or 0) + (ends > 0)
    vocab = vocabulary(vocabulary_file)
    fitted = fit(words, ends, vocab, rounds)
    pieces, bytes_at, _ = vocab

    def word_logs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(pieces, bytes_at, fitted.logp)
        for batch in batches:
            w, c, out = batch["word"].tolist(), batch["c"].to_numpy(float), np.empty(len(batch))
            for at in _batches(w):
                out[at] = fitted.word_logs(lattice, [w[k] for k in at], c[at])
            yield batch.assign(log_count=np.log10(batch["c"] + 1.0), log_word=out / np.log(10))

    table = stage(words.mapInPandas(word_logs, "word string, c long, c_all long, log_count double, log_word double"), "lm-scored")
    # the count from which on at most heavy_words words occur: from a histogram over steps of the logarithm
    step = F.floor(F.log2("c_all") * 16).cast("int").alias("step")
    room, least = heavy_words, None
    for r in table.groupBy(step).count().orderBy(F.desc("step")).collect():
        if r["count"] > room:
            break
        room, least = room - r["count"], r["step"]
    is_heavy = step >= least if least is not None else F.lit(False)
    heavy = table.where(is_heavy).orderBy("word").toPandas()
    heavy = {"words": heavy["word"].tolist(), "values": np.stack([heavy["log_count"], heavy["log_word"], (heavy["c"] > 0).astype(float)])}
    rest = np.log10(n + v + 1)

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {w.encode(): k for k, w in enumerate(heavy["words"])}
        values = np.concatenate([heavy["values"], np.zeros((3, 1))], axis=1)
        for batch in batches:
            main, rare = [], []
            for key, i, held, text in zip(batch["key"], batch["doc_id"].array, batch["held_out"], batch["text"].array):
                w = tokens(text)
                at = [place.get(x, -1) for x in w]
                sums = values[:, at].sum(axis=1) if at else np.zeros(3)
                main.append((key, i, held, None, len(w) + 1, *sums))
                if -1 in at:
                    rare += [(key, i, held, x.decode(), m, 0.0, 0.0, 0.0) for x, m in Counter(x for x, k in zip(w, at) if k < 0).items()]
            yield pd.DataFrame(main + rare, columns=names)

    names = ["key", "doc_id", "held_out", "word", "m", "log_count", "log_word", "known"]
    kind = "key long, doc_id string, held_out boolean, word string, m long, log_count double, log_word double, known double"
    parts = stage(rows.withColumns({"key": F.monotonically_increasing_id(), "doc_id": F.col("doc_id").cast("string")}).mapInPandas(look_up, kind), "lm-parts")
    found = parts.where("word is not null").select("key", "word", "m").join(
        table.where(~is_heavy).select("word", "c", "log_count", "log_word"), "word")
    more = found.groupBy("key").agg(F.sum(F.col("m") * F.col("log_count")).alias("x"), F.sum(F.col("m") * F.col("log_word")).alias("y"),
                                    F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("z"))
    out = parts.where("word is null").join(more, "key", "left")
    base = F.col("log_count") + F.coalesce("x", F.lit(0.0)) + F.lit(float(np.log10(ends + 1))) - F.col("m") * F.lit(float(rest))
    return long_ids(out).select("doc_id", "held_out", F.col("m").alias("n_tokens"),
                      (F.col("known").cast("long") + F.coalesce("z", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
                      F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"),
                      (F.col("log_word") + F.coalesce("y", F.lit(0.0)) + F.lit(fitted.end / float(np.log(10)))).alias("score"))
