"""Best-fit packing of tokenised documents into fixed-length sequences (large-item matching).

Documents become pieces of at most ``capacity`` tokens (one end id appended). A full piece is a sequence
of its own. All other pieces are packed by length: only the histogram of lengths (at most ``capacity`` - 1
rows, whatever the input) reaches the driver, the plan made from it says which ranks of each length go to
which sequences at which offset, and every piece finds its place by its rank within its length.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import long_ids, stage, text_ids

PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Byte-level BPE ids of whole texts through a bounded cache of space-separated chunks.

    The vocabulary's split rule always starts a new token at a space that precedes a visible character and
    at a line feed between two visible characters, so the ids of a text are the ids of those chunks in
    order. Texts with any other white space go through the encoder as a whole. The vocabulary's added tokens
    (such as an end-of-text mark) are found in the text first; what stands between them is encoded by itself.
    """

    def __init__(self, path: str, cache_entries: int = 400_000):
        import tiktoken
        content = json.load(open(path, encoding="utf-8"))
        model, added = content["model"], content.get("added_tokens", [])
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take in white space or parts of words are not supported")
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        self.marks = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in visible}
        back |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(visible))}
        ranks = {bytes(back[c] for c in piece): i for piece, i in model["vocab"].items()
                 if all(c in back for c in piece) and piece not in self.added}
        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding("chunks", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        self.bare, self.spaced, self.limit = {}, {}, cache_entries
        self.line_feed = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        out, at = [], 0
        for mark in self.marks.finditer(text):
            out += [self._between(text[at:mark.start()]), self.added[mark.group()]]
            at = mark.end()
        return b"".join(out) + self._between(text[at:]) if out else self._between(text)

    def _between(self, text: str) -> bytes:
        if not text:
            return b""
        try:
            text.encode()
        except UnicodeEncodeError:
            text = text.encode("utf-8", "replace").decode()
        lines = text.split("\n")
        out, bare, spaced = [], self.bare, self.spaced
        for k, line in enumerate(lines):
            words = line.split(" ")
            if len(lines) > 1 and (not words[0] or not words[-1]) or "" in words or len(line.split()) != len(words):
                return self._whole(text)
            if k:
                out.append(self.line_feed)
            first = words[0]
            if first not in bare:
                bare[first] = self._whole(first)
            out.append(bare[first])
            try:
                out += [spaced[w] for w in words[1:]]
            except KeyError:
                for w in words[1:]:
                    if w not in spaced:
                        spaced[w] = self._whole(" " + w)
                out += [spaced[w] for w in words[1:]]
        if len(spaced) > self.limit:
            spaced.clear()
        if len(bare) > self.limit:
            bare.clear()
        return b"".join(out)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every whole text; the first piece of a cut document is the shorter one.

    ``tokenizer`` is the name of a public vocabulary file, looked up on each executor.
    Null and empty texts give one piece that holds the end id alone.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers
        enc = WordEncoder(public_tokenizers.path(tokenizer))
        for batch in batches:
            rows = []
            for i, text in zip(batch["doc_id"].array, batch["text"].array):
                ids = (enc.encode(text) if isinstance(text, str) and text else b"") + end
                n = len(ids) // 4
                head = n % capacity or capacity
                a = 0
                for k in range(-(-n // capacity)):
                    b = head if k == 0 else a + capacity
                    rows.append((i, k, a, b - a, zlib.crc32(ids[4 * a:4 * b])))
                    a = b
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return long_ids(text_ids(docs, id_col, text_col).mapInPandas(cut, PIECES))


def plan(counts: dict[int, int], capacity: int = 1024) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places for all pieces of a length histogram: ``(length, rank_lo, rank_hi, first_sequence, offset)`` rows,
    rank r of that length going to sequence ``first_sequence + r - rank_lo``; and the number of sequences.

    Large pieces (over a third of the capacity) are matched first, two at most in a sequence: the longest
    left takes the longest left that still fits beside it. Then every smaller length, longest first, goes to
    the sequences with the least room that still holds it (best fit), and opens new ones when none does.
    Equal sequences are handled as one group, so the work depends on the number of lengths, not of pieces.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}     # room -> [(first sequence, how many)]
    total = 0

    def place(length: int, first: int, many: int, offset: int) -> None:
        rows.append((length, used[length], used[length] + many, first, offset))
        used[length] += many
        left[length] -= many

    def keep(room: int, first: int, many: int) -> None:
        if room and many:
            groups.setdefault(room, []).append((first, many))

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        x = large[-1]
        at = bisect.bisect_right(large, capacity - x) - 1
        if at < 0:
            many = left[x]
            place(x, total, many, 0)
            keep(capacity - x, total, many)
        else:
            y = large[at]
            many = left[x] // 2 if x == y else min(left[x], left[y])
            if many == 0:                                # one piece of this length is left and y is x
                if at:
                    y = large[at - 1]
                    many = 1
                    place(x, total, 1, 0)
                    place(y, total, 1, x)
                    keep(capacity - x - y, total, 1)
                else:
                    many = 1
                    place(x, total, 1, 0)
                    keep(capacity - x, total, 1)
            else:
                place(x, total, many, 0)
                place(y, total, many, x)
                keep(capacity - x - y, total, many)
        total += many
        large = [k for k in large if left[k]]
    for x in sorted((k for k in left if 3 * k <= capacity and left[k]), reverse=True):
        while left[x]:
            fits = [r for r in groups if r >= x]
            room = min(fits, default=capacity)
            first, many = groups[room].pop() if fits else (total, -(-left[x] // (capacity // x)))
            if fits and not groups[room]:
                del groups[room]
            if not fits:
                total += many
            take = min(left[x], many)
            place(x, first, take, capacity - room)
            keep(room - x, first, take)
            keep(room, first + take, many - take)
    return rows, total


def pack(rows: DataFrame, capacity: int = 1024, shard_rows: int = 100_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the rows of ``pieces`` (with its ``length`` column).

    A full piece is a sequence of its own and needs no rank: its sequence gets a number of its own beyond the planned ones. Other
    pieces are ranked within their length: the rows of a length are dealt by hash over so many shards that each has about
    ``shard_rows``, ranked there, and shifted by the shards before, whose counts are a table that stays in Spark. The driver sees one
    count per length.
    """
    rows = stage(rows, "pieces")
    part = rows.where(F.col("length") < capacity)
    counts = dict(part.groupBy("length").count().collect())              # at most capacity - 1 rows
    places, total = plan(counts, capacity)
    shards = max(1, -(-max(counts.values(), default=0) // shard_rows))
    keyed = part.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    before = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    shifts = keyed.groupBy("length", "_shard").count().withColumn("_shift", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = Window.partitionBy("length", "_shard").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("_rank", F.row_number().over(own) - 1).join(shifts, ["length", "_shard"]) \
        .withColumn("_rank", F.col("_rank") + F.col("_shift"))
    # bounded by the plan: about two rows for each pair of lengths that meet, whatever the number of pieces
    spots = rows.sparkSession.createDataFrame(places, "length long, _lo long, _hi long, _first long, offset long")
    out = ranked.join(F.broadcast(spots), "length").where("_rank >= _lo and _rank < _hi") \
        .select(*rows.columns, (F.col("_first") + F.col("_rank") - F.col("_lo")).alias("sequence_id"), "offset")
    full = rows.where(F.col("length") == capacity) \
        .select(*rows.columns, (F.monotonically_increasing_id() + total).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return out.unionByName(full)


def best_fit_packing(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 1024, end_id: int = 2,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document in sequences of at most ``capacity`` tokens: one row per piece with its place.

    Only documents longer than the capacity are cut. Repeated rows are packed as often as they occur, a
    null or empty text as its end id; an empty table gives no rows. Columns other than the two named are
    not read.
    """
    return pack(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), capacity)
