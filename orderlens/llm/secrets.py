"""Secret scans by a trigram index: Boolean trigram queries derived from each regular expression.

Each Arrow batch is a block of texts. Its index holds, for every trigram that some rule asks for, the texts
that contain it (postings). A rule's query intersects and unites postings; only the texts left are matched
with the rule itself. A rule without a mandatory trigram scans all texts of the block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre  # names of parsed nodes
from re import _parser as parser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_ids, text_ids


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    base: bool = False
    min_length: int = 0      # of the group below
    group: int = 0
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


# The three base rules, then the added ones.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         True, 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", True, 20),
    Rule("hex", r"[0-9a-f]+", True, 24),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"Bearer [A-Za-z0-9._~+/-]{20,}"),
)

#: A query is True (no restriction), a trigram, or ("and" | "or", queries).
MAX_STRINGS = 64


def _both(op: str, parts: list):
    parts = [p for p in dict.fromkeys(parts) if not (op == "and" and p is True)]
    if op == "or" and any(p is True for p in parts):
        return True
    if not parts:
        return True
    return parts[0] if len(parts) == 1 else (op, tuple(parts))


def _strings_query(strings: frozenset[str]):
    """Some string of the set occurs: the trigrams of one of them all occur."""
    return _both("or", [_both("and", [s[i:i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _alternatives(node, ignore_case: bool) -> frozenset[str] | None:
    """All strings that a parsed node can match, lower-cased; None if too many or without end."""
    op, arg = node
    if op is sre.LITERAL:
        return frozenset({chr(arg).lower()})
    if op is sre.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                out.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < 8:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return frozenset(out) if len(out) <= 8 else None
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1], ignore_case)
    if op is sre.BRANCH:
        parts = [_sequence(b, ignore_case) for b in arg[1]]
        if any(p is None for p in parts):
            return None
        return frozenset().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = arg
        one = _sequence(body, ignore_case)
        if one is None or high is sre.MAXREPEAT or int(high) > 2:
            return None
        out, now = set(), frozenset({""})
        for k in range(int(high) + 1):
            if k >= low:
                out |= now
            now = frozenset(a + b for a in now for b in one)
        return frozenset(out) if len(out) <= MAX_STRINGS else None
    return None


def _sequence(nodes, ignore_case: bool) -> frozenset[str] | None:
    out = frozenset({""})
    for node in nodes:
        one = _alternatives(node, ignore_case)
        if one is None:
            return None
        out = frozenset(a + b for a in out for b in one)
        if len(out) > MAX_STRINGS:
            return None
    return out


def _query(nodes, ignore_case: bool):
    """Condition that any text with a match satisfies: runs of nodes with few strings give trigrams."""
    parts, run = [], frozenset({""})
    for node in nodes:
        one = _alternatives(node, ignore_case)
        if one is not None and len(run) * len(one) <= MAX_STRINGS:
            run = frozenset(a + b for a in run for b in one)
            continue
        parts.append(_strings_query(run))
        run = frozenset({""}) if one is None else one
        if one is None:
            op, arg = node
            if op is sre.SUBPATTERN:
                parts.append(_query(arg[-1], ignore_case))
            elif op is sre.BRANCH:
                parts.append(_both("or", [_query(b, ignore_case) for b in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                parts.append(_query(arg[2], ignore_case))
    parts.append(_strings_query(run))
    return _both("and", parts)


def trigram_query(pattern: str, ignore_case: bool = False):
    """Boolean query over lower-case ASCII trigrams that every text matching ``pattern`` satisfies; True when the
    pattern has no mandatory trigram."""
    q = _query(parser.parse(pattern), ignore_case)
    return q if all(t.isascii() for t in trigrams(q)) else True


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


class BlockIndex:
    """Postings of the wanted trigrams over a block of texts."""

    def __init__(self, texts: list[str], wanted: dict[str, int], table: np.ndarray):
        self.wanted, self.everything = wanted, np.arange(len(texts))
        parts = [t.encode("utf-8", "replace").lower() for t in texts]     # lower-cases ASCII letters only
        ends = np.cumsum([len(p) + 3 for p in parts])
        flat = np.frombuffer(b"\0\0\0".join(parts) + b"\0\0\0", np.uint8)
        owners, codes = [], []
        for a in range(0, len(flat) - 2, 1 << 20):        # slices keep the work arrays small
            b = flat[a:a + (1 << 20) + 2].astype(np.uint32)
            found = table[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]]
            at = np.flatnonzero(found)
            codes.append(found[at])
            owners.append(np.searchsorted(ends, at + a, "right"))
        codes, owners = np.concatenate(codes or [[]]), np.concatenate(owners or [[]]).astype(np.int64)
        self.postings = {code: np.unique(owners[codes == code]) for code in wanted.values()}

    def search(self, query) -> np.ndarray:
        if query is True:
            return self.everything
        if isinstance(query, str):
            return self.postings[self.wanted[query]]
        found = [self.search(q) for q in query[1]]
        out = found[0]
        for more in found[1:]:
            out = np.intersect1d(out, more, assume_unique=True) if query[0] == "and" else np.union1d(out, more)
        return out


def _number_trigrams(queries: list) -> tuple[dict[str, int], np.ndarray]:
    wanted = {t: k + 1 for k, t in enumerate(sorted(set().union(*map(trigrams, queries))))}
    table = np.zeros(1 << 24, np.uint16)
    for t, k in wanted.items():
        a, b, c = t.encode()
        table[(a << 16) | (b << 8) | c] = k
    return wanted, table


def _matcher(rule: Rule) -> re.Pattern:
    """The rule's pattern; a rule that is one repeated class takes its length into the pattern, which
    finds the same matches (they are maximal runs) and skips short runs faster."""
    if rule.min_length and not rule.group and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
        return re.compile(f"{rule.pattern[:-1]}{{{rule.min_length},}}", re.ASCII | (re.IGNORECASE if rule.ignore_case else 0))
    return rule.compiled()


def scan_block(texts: list[str], rules: tuple[Rule, ...], queries: list, matchers: list[re.Pattern], wanted, table) -> list[list[tuple]]:
    """Per text its spans ``(start, kind number, end)``, sorted."""
    index = BlockIndex(texts, wanted, table)
    spans: list[list[tuple]] = [[] for _ in texts]
    for k, (rule, query, regex) in enumerate(zip(rules, queries, matchers)):
        for i in index.search(query):
            for m in regex.finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.min_length:
                    spans[i].append((m.start(), k, m.end()))
    for s in spans:
        s.sort()
    return spans


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, block_chars: int = 4_000_000,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and ``spans`` array of (kind, start, end, base), by start then rule order.

    Matches are leftmost and non-overlapping per rule, over whole texts; offsets count code points, end
    exclusive. Null and empty texts have no spans. Repeated rows are scanned as often as they occur.
    """
    schema = "doc_id string, spans array<struct<kind:string,start:long,end:long,base:boolean>>"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = [trigram_query(r.pattern, r.ignore_case) for r in rules]
        matchers = [_matcher(r) for r in rules]
        wanted, table = _number_trigrams(queries)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"].array]
            found, a, size = [], 0, 0
            for b, t in enumerate(texts + [""]):
                if b == len(texts) or size and size + len(t) > block_chars:
                    found += scan_block(texts[a:b], rules, queries, matchers, wanted, table)
                    a, size = b, 0
                size += len(t)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": [
                [(rules[k].kind, s, e, rules[k].base) for s, k, e in one] for one in found]})

    return long_ids(text_ids(docs, id_col, text_col).mapInPandas(scan, schema))


def span_digests(spans: DataFrame) -> DataFrame:
    """Counts and digests per document from ``secret_spans``."""
    def text(keep):
        return F.array_join(F.transform(keep, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])
    many = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spans.select("doc_id", many("assign").alias("n_assign"), many("access").alias("n_access"), many("hex").alias("n_hex"),
                        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))

