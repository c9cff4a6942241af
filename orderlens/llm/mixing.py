"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

Blocks go to sources, and each source's blocks to its shards, by highest quotients (votes over 1, 3, 5, ...),
which gives integer quotas. A shard's quota takes every block so many whole times, and the rest as one more
copy of blocks picked by a seeded permutation. Everything is built-in functions on the DataFrame path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage

#: Primes for the steps of the seeded permutations.
_PRIMES = "2654435761L, 2246822519L, 3266489917L, 668265263L, 374761393L, 1000003L, 1000033L, 7L, 5L, 3L, 2L"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to a table of (source, source_size).

    Sources in code-point order (null last) weigh ``weights`` in turn and split ``share`` of all sizes. A target
    stops at ``most`` times its source's size and the excess goes to the others by weight until none is above:
    in order of cap over weight, a source stays at its cap as long as the level that the rest would get, (total
    - caps so far) / (weights left), reaches its own. One row per source, so its windows run over that alone.
    """
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (n % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * most
    up = Window.orderBy("_fill", "_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy("_one").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = sizes.withColumns({"_n": n, "_w": w, "_one": F.lit(1)}).withColumns({"_cap": cap, "_fill": cap / F.col("_w")})
    t = t.withColumns({"_caps": F.sum("_cap").over(up), "_ws": F.sum("_w").over(up), "_all": F.sum("_w").over(every),
                       "_total": F.sum("source_size").over(every) * F.lit(share)})
    before = (F.col("_total") - (F.col("_caps") - F.col("_cap"))) / (F.col("_all") - (F.col("_ws") - F.col("_w")))
    t = t.withColumn("_full", F.col("_fill") <= before)
    caps = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(every), F.lit(0.0))
    free = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(every)
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * (F.col("_total") - caps) / free)
    return t.withColumn("target", F.least(target, F.col("_cap")).cast("double")) \
        .select("source", "source_size", "target")


def sainte_lague(votes: DataFrame, group: list[str], order: list[str], seats: str, out: str, most: str | None = None) -> DataFrame:
    """Adds integer ``out``: ``seats`` (the same on all rows of a group) apportioned by ``votes`` within each group.

    Rounding votes at the quota gives a start that is off by at most half the number of rows; only the
    quotients that can change hands are then listed and ranked, a number of rows in proportion to the
    parties. Ties go to the first in ``order``. ``most`` names a column that no party's seats may exceed.
    """
    key = [F.col(c) for c in group] or [F.lit(1)]
    ordered = [F.col(c).asc_nulls_last() for c in order]
    by = Window.partitionBy(*key).orderBy(*ordered).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = votes.withColumns({"_sum": F.sum("votes").over(by), "_parties": F.count("*").over(by)})
    share = F.when(F.col("_sum") > 0, F.col("votes") / F.col("_sum")).otherwise(F.lit(0.0))
    t = t.withColumn("_start", F.floor(share * F.col(seats) + 0.5).cast("long")) \
        .withColumn("_slack", (F.ceil(share * F.col("_parties") / 2) + 1).cast("long")) \
        .withColumn("_sure", F.greatest(F.col("_start") - F.col("_slack"), F.lit(0).cast("long"))) \
        .withColumn("_open", F.col(seats) - F.sum("_sure").over(by))
    k = F.explode(F.sequence(F.col("_sure"), F.col("_start") + F.col("_slack"))).alias("_k")
    lists = t.where("votes > 0").select(*group, *order, "votes", "_open", k) \
        .withColumn("_quotient", F.col("votes") / (2 * F.col("_k") + 1))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_quotient"), *ordered, "_k"))
    won = lists.withColumn("_rank", rank).where("_rank <= _open").groupBy(*group, *order).agg(F.count("*").alias("_won"))
    won = won.select("_won", *[F.col(c).alias(f"_won_{c}") for c in [*group, *order]])
    t = t.join(won, [F.col(c).eqNullSafe(F.col(f"_won_{c}")) for c in [*group, *order]], "left")
    got = F.col("_sure") + F.coalesce(F.col("_won"), F.lit(0).cast("long"))
    got = F.least(got, F.col(most)) if most else got
    return t.withColumn(out, got.cast("long")).drop(*[f"_won_{c}" for c in [*group, *order]], "_sum", "_parties", "_start", "_slack", "_sure", "_open", "_won")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
        block: int = 16, shard_words: int = 1 << 23, seed: int = 17,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, shard, copies, extra, taken``.

    ``taken`` counts the words that the mix takes of a document, repeats included: the whole document ``copies``
    times, and the word ranges ``extra`` once more. A source of n words is dealt by seeded hash over n /
    ``shard_words`` + 1 shards, so a hot source's documents are ordered in many tasks. A shard's words, in
    seeded order of its documents, are cut into blocks of ``block`` words (the lengths differ by one at most).
    The same table gives the same result in every run, whatever its partitioning. Null and empty texts have
    size 0 and are taken 0 times, a null source is a source of its own, repeated rows count as often as they
    occur, an empty table gives no rows. Other columns are not read.
    """
    d = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                          word_count(text_col).alias("size")), "mix-sizes")
    sources = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    total = F.sum("target").over(Window.orderBy(F.col("source").asc_nulls_last())
                                 .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sources = sources.withColumns({"votes": F.col("target"), "_seats": F.round(total / block).cast("long")})
    sources = sainte_lague(sources, [], ["source"], "_seats", "_blocks") \
        .withColumn("_shards", F.floor(F.col("source_size") / shard_words) + 1) \
        .select("source", "source_size", "target", "_blocks", "_shards")
    sources = stage(sources, "mix-sources")
    shard = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("_shards")).cast("int")
    d = d.join(sources, d["source"].eqNullSafe(sources["source"])) \
        .select("doc_id", d["source"], "size", "source_size", "target", "_blocks", shard.alias("shard"))
    shards = d.groupBy("source", "shard", "_blocks").agg(F.sum("size").alias("_words")) \
        .withColumn("votes", F.col("_words").cast("double")) \
        .withColumn("_n", F.greatest(F.round(F.col("_words") / block), F.lit(1)).cast("long")) \
        .withColumn("_most", (F.when(F.col("_words") > 0, F.col("_n")).otherwise(0) * int(most)).cast("long"))
    shards = sainte_lague(shards, ["source"], ["shard"], "_blocks", "_quota", "_most") \
        .select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "_words", "_n", "_quota")
    d = d.join(shards, d["source"].eqNullSafe(F.col("_s")) & (d["shard"] == F.col("_h"))).drop("_s", "_h", "_blocks")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size")
    d = d.withColumn("_to", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # block j of the shard is [ceil(j * words / n), ceil((j + 1) * words / n)); it gets one more copy if its place in
    # the seeded permutation j -> j * step + shift (mod n) is under quota mod n. step and n share no divisor.
    d = d.withColumns({"_from": F.col("_to") - F.col("size"), "_base": F.floor(F.col("_quota") / F.col("_n")),
                       "_more": F.col("_quota") % F.col("_n"),
                       "_shift": F.pmod(F.xxhash64("source", "shard", F.lit(seed + 2)), F.col("_n")),
                       "_try": F.pmod(F.xxhash64("source", "shard", F.lit(seed + 3)), F.col("_n"))})
    d = d.withColumn("_steps", F.expr(f"filter(array({_PRIMES}), p -> _n % p <> 0)")) \
        .withColumn("_step", F.expr("coalesce(get(_steps, cast(_try % 3 as int)), 1L)"))
    d = d.withColumn("extra", F.expr("""if(size = 0 or _more = 0, cast(array() as array<struct<start:bigint,stop:bigint>>), transform(
            filter(sequence(_from * _n div _words, (_to - 1) * _n div _words), j -> (j * _step + _shift) % _n < _more),
            j -> struct(greatest(_from, (j * _words + _n - 1) div _n) - _from as start,
                        least(_to, ((j + 1) * _words + _n - 1) div _n) - _from as stop)))"""))
    taken = F.col("_base") * F.col("size") + F.aggregate("extra", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return d.select("doc_id", "source", "size", "source_size", "target", "shard", F.col("_base").cast("long").alias("copies"), "extra",
                    taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents as the mix takes them: ``copies`` whole rows, and one more row with the words of the extra blocks
    (joined by spaces) if there are any; a document that is not taken has no row. Ids must be unique; all columns of
    ``docs`` are kept."""
    m = mixed.select(F.col("doc_id").alias("mix_id"), "copies", "extra").where("copies > 0 or size(extra) > 0")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.struct("*").alias("row"))     # no name of docs can clash
    old = F.col("row")[text_col]
    d = rows.join(m, F.col("id").eqNullSafe(F.col("mix_id"))) \
        .withColumn("words", F.when(F.size("extra") > 0, F.regexp_extract_all(old, F.lit(WORD), F.lit(0))))
    part = F.array_join(F.flatten(F.transform("extra", lambda x: F.slice("words", x["start"].cast("int") + 1, (x["stop"] - x["start"]).cast("int")))), " ")
    whole = F.array_repeat(old, F.col("copies").cast("int"))
    both = F.when(F.size("extra") == 0, whole).otherwise(F.concat(whole, F.array(part)))
    return d.select("row", F.explode(both).alias("text")) \
        .select(*[(F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
