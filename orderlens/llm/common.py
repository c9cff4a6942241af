"""Shared helpers of the document operators: inputs, staged tables, links and connected groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.session import _note, dropping_staged

#: Java regular expression of a word: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_local_root: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in a local session that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="llm-stage-"))
    return _local_root[0]


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps never recompute it,
    and losing an executor costs only a new read."""
    spark, path = df.sparkSession, stage_path(df.sparkSession, name)
    _note(path)                                              # dropped with the block it is in, if any
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_alone(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make()`` returns, staged; the tables that were staged on the way to it are dropped then."""
    path = stage_path(spark, name)
    _note(path)
    with dropping_staged(spark):
        df = make()
        df.write.parquet(path)
        schema = df.schema
    return spark.read.schema(schema).parquet(path)


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``; a null id counts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def text_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text`` with the id as text: pandas would turn a column of whole numbers with a null into doubles."""
    return docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text"))


def long_ids(rows: DataFrame) -> DataFrame:
    """Ids of ``text_ids`` as numbers again."""
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """``doc_id, t1, t2``: the key of a row, its id and 128 bits of its text. Rows equal in all three are copies of each other."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2")]


def same_row(doc_id: str, t1: str, t2: str) -> Column:
    """Whether ``doc_id, t1, t2`` and the named columns are the same key; a null id matches a null id."""
    return F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.col("t1") == F.col(t1)) & (F.col("t2") == F.col(t2))


def star_edges(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) that tie all ``node`` values of one ``key`` to the key's smallest node, and the keys with more than
    two rows.

    ``rows`` has columns ``key`` and ``node``. Per key one aggregated row (map-side combined, so a hot
    key collapses before the shuffle); the members of keys with more than two nodes are looked up again.
    The number of edges is at most the number of rows: no pairs within a key are made.
    """
    groups = stage(rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"),
                                           F.count("*").alias("n")).where("lo < hi"), name)
    pairs = groups.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    big = rows.join(groups.where("n > 2").select("key", "lo"), "key") \
        .where("node > lo").select(F.col("lo").alias("a"), F.col("node").alias("b"))
    return pairs.unionByName(big).distinct(), groups.where("n > 2").select("key")


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Connected groups of an undirected graph: (node, root), root the smallest node of the group.

    Alternating large-star and small-star rounds over the edge table (each round ties every node's
    neighbours to the smallest of them, larger ones first, then smaller ones), staged each round, until
    the edges no longer change. The rounds needed grow with the logarithm of the group's size.
    Nodes without edges have no row.
    """
    cur = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                f"{name}-edges")
    before = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                             F.col("m").alias("v")).where("u <> v").distinct()
        cur = stage(small, f"{name}-edges")
        now = cur.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected groups did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
