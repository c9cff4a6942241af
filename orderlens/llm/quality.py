"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared with references per language
(Jensen-Shannon distance, base 2, so 0 to 1). The references come from the whole corpus. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: The character classes, each taken from what the ones before leave; the rest is one more class.
CLASSES = (("lower", r"\p{Ll}+"), ("space", r"[\x20\x09-\x0D]+"), ("upper", r"\p{Lu}+"), ("digit", r"\p{Nd}+"),
           ("punct", r"\p{P}+"), ("symbol", r"\p{S}+"))
SYMBOLS = r"[#*$%&|<>]+"


def _texts(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def class_counts(df: DataFrame) -> DataFrame:
    """Adds ``n_<class>`` for every character class, ``word_chars`` and ``n_symbols`` of ``text``."""
    d, left = df, "text"
    for name, pattern in CLASSES:
        d = d.withColumn(f"_no_{name}", F.regexp_replace(left, pattern, ""))
        d = d.withColumn(f"n_{name}", (F.length(left) - F.length(f"_no_{name}")).cast("long"))
        if name == "lower":
            d = d.withColumn("n_symbols", (F.length(f"_no_{name}") - F.length(F.regexp_replace(f"_no_{name}", SYMBOLS, ""))).cast("long"))
        left = f"_no_{name}"
    d = d.withColumns({"n_other": F.length(left).cast("long"), "word_chars": (F.length("text") - F.col("n_space")).cast("long")})
    return d.drop(*[f"_no_{name}" for name, _ in CLASSES])


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _bare(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"^\p{P}+|\p{P}+$", ""))


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def common_words(text: Column, known: list[str]) -> Column:
    """The words of ``text``, bare as above, that are among ``known``, found in one pass over the whole text.

    Both patterns look at the next character first and the known words are told apart by it: most places are left at once.
    """
    edge, end = r"(?<![^\x20\x09-\x0D])", r"(?![^\x20\x09-\x0D])"
    bare = F.lower(F.regexp_replace(text, rf"(?=\p{{P}})(?:{edge}\p{{P}}+|\p{{P}}++{end})", ""))
    rests: dict[str, list[str]] = {}
    for w in known:
        rests.setdefault(w[:1], []).append(_quoted(w[1:]))
    words = "|".join(f"{_quoted(first)}(?:{'|'.join(rest)})" for first, rest in rests.items())
    return F.regexp_extract_all(bare, F.lit(f"{edge}(?:{words}){end}"), F.lit(0))


def _mark(k: int) -> str:
    return chr(0x100 + k)


def marks(found: Column, known: list[str]) -> Column:
    """A text with one character per found word, that of its place in ``known``: each word is looked up once, and
    counting a character is far cheaper than going through the words again."""
    pairs = [x for k, w in enumerate(known) for x in (F.lit(w), F.lit(_mark(k)))]
    place = F.create_map(*pairs)
    return F.array_join(F.transform(found, lambda w: F.element_at(place, w)), "")


CLASS_COLUMNS = [f"n_{name}" for name, _ in CLASSES] + ["n_other"]


def references(docs: DataFrame, k: int = 12, text_col: str = "text", lang_col: str = "lang") -> list[dict]:
    """Per language of the whole table: its share of every character class and of its ``k`` most frequent words.

    Counts go over all rows with a language; what reaches the driver is ``k`` words and the classes per language.
    Ties between words go by code point.
    """
    d = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null")
    chars = class_counts(d).groupBy("lang").agg(*[F.sum(c).alias(c) for c in CLASS_COLUMNS])
    # staged, as totals and top words both read it; one row per distinct word of a language
    counts = stage(d.select("lang", F.explode(words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")) \
        .groupBy("lang", _bare(F.col("word")).alias("word")).agg(F.sum("n").alias("n")), "quality-words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n_words"))
    top = counts.where("word <> ''").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))) \
        .where(F.col("r") <= k).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "word", "n"))).alias("top"))
    out = []
    for r in chars.join(totals, "lang").join(top, "lang").orderBy("lang").collect():
        n = sum(r[c] for c in CLASS_COLUMNS)
        freq = [x["n"] / r["n_words"] for x in r["top"]]
        out.append({"lang": r["lang"], "classes": [r[c] / n for c in CLASS_COLUMNS], "words": [x["word"] for x in r["top"]],
                    "word_shares": [*freq, max(0.0, 1 - sum(freq))]})
    return out


def _distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance (root of the divergence, base 2) of an array column of shares and given shares."""
    ref = F.array(*[F.lit(float(x)) for x in q])
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(p, ref, lambda a, b: term(a, (a + b) / 2) + term(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def repeat_words(d: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` from ``words``: words inside 3-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash; sorting (hash, position) pairs puts equal ones side by side.
    """
    hashes = F.slice(F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))),
                     F.lit(1), F.greatest(F.size("words") - 2, F.lit(0)))
    d = d.withColumn("_h", hashes)
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"),
                                  F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, i, k: F.coalesce(F.get("_s", i + k)["h"] == x["h"], F.lit(False))
    d = d.withColumn("_at", F.filter("_s", lambda x, i: same(x, i, -1) | same(x, i, 1)))
    covered = F.array_distinct(F.flatten(F.transform("_at", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return d.withColumn("n_repeat_words", F.when(F.col("_s").isNull(), 0).otherwise(F.size(covered)).cast("long")).drop("_h", "_s", "_at")


def quality_rules(docs: DataFrame, refs: list[dict] | None = None, max_distance: float = 0.2, min_words: int = 50,
                  id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: base counts, its distance to the nearest language reference and the verdict.

    ``distance`` is the mean of the distances of the character classes and of the common words, the least over all
    languages (``nearest``); it is null below ``min_words`` words, which fail the base rules anyway, and when no row
    has a language (the verdict is then that of the base rules). A null text counts as empty and fails, repeated
    rows are judged one by one, an empty table gives no rows. Columns other than the three named are not read.
    """
    refs = references(docs, text_col=text_col, lang_col=lang_col) if refs is None else refs
    d = class_counts(_texts(docs, id_col, text_col))
    d = d.withColumns({"words": words(F.col("text")), "_lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    d = d.withColumns({"n_words": F.size("words").cast("long"),
                       "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")})
    d = repeat_words(d)
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    if refs:
        known = sorted({w for r in refs for w in r["words"]})
        d = d.withColumn("_common", common_words(F.col("text"), known))
        d = d.withColumn("_marks", marks(F.col("_common"), known))
        d = d.withColumn("_counts", F.array(*[F.length("_marks") - F.length(F.replace("_marks", F.lit(_mark(k)))) for k in range(len(known))]))
        place = {w: k for k, w in enumerate(known)}
        shares = F.array(*[F.col(c) / F.greatest(F.length("text"), F.lit(1)) for c in CLASS_COLUMNS])
        d = d.withColumn("_classes", shares)
        found = []
        for r in refs:
            own = [F.get("_counts", F.lit(place[w])) for w in r["words"]]
            rest = F.col("n_words") - sum(own[1:], own[0])
            p = F.transform(F.array(*own, rest), lambda x: x / F.greatest(F.col("n_words"), F.lit(1)))
            mean = (_distance(F.col("_classes"), r["classes"]) + _distance(p, r["word_shares"])) / 2
            found.append(F.struct(mean.alias("distance"), F.lit(r["lang"]).alias("lang")))
        d = d.withColumn("_near", F.when(F.col("n_words") >= min_words, F.array_min(F.array(*found))))
    else:
        d = d.withColumn("_near", F.lit(None).cast("struct<distance:double,lang:string>"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("_near.distance") <= max_distance, F.lit(True))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"),
                    F.col("_near.distance").alias("distance"), F.col("_near.lang").alias("nearest"))
