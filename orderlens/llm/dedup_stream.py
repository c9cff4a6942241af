"""Exact deduplication as a stateful stream.

A file stream aggregates by digest without a watermark, so state never expires. The state lives in the
RocksDB state store (disk-backed, snapshots in the stream's checkpoint folder) and retains per digest a
counter, the stable identifier of the row to keep and that row's content locator (file and row number).
On hits, rows whose digest occurs more than once, the full bytes are fetched by locator and compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stage, stage_path

#: Disk-backed state; without space reserved in advance for the logs of each of many small stores.
_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
          "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _glob(path: str) -> str:
    """The path as a pattern that only it matches: a file stream also takes a single file that way."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def _located(df: DataFrame, digest: Callable[[Column], Column], id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), digest(text).alias("digest"),
                     F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def run_home(spark: SparkSession, run: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """The folder of a named run; another path or other columns are another stream, whatever its name."""
    which = hashlib.sha256("\0".join((path.rstrip("/"), id_col, text_col)).encode()).hexdigest()[:16]
    return f"{shared_dir(spark)}/llm/dedup-stream-{run}-{which}"


def stream_state(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256,
                 id_col: str = "doc_id", text_col: str = "text", files_per_batch: int = 4000, run: str | None = None) -> DataFrame:
    """Run the stream over all files now under ``path``; (digest, n, keep_id, file, row) per digest.

    ``run`` names the stream: a later call with the same name and path, after a failure or when files have been added, takes up
    from its checkpoint and reads new files alone; a micro-batch that is run again overwrites the folder of its number. Files must
    not be changed or removed in between. Without a name every call starts afresh.
    """
    home = run_home(spark, run, path, id_col, text_col) if run else stage_path(spark, "dedup-stream")
    schema = spark.read.parquet(path).schema
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(_glob(path))
        state = _located(rows, digest, id_col, text_col).groupBy("digest").agg(
            F.count("*").alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("keep"))
        query = (state.writeStream.outputMode("update").trigger(availableNow=True)
                 .option("checkpointLocation", f"{home}/checkpoint")
                 .foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{home}/updates/batch={k}"))
                 .start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kind = "digest string, n long, keep struct<doc_id:long,file:string,row:long>, batch long"
    try:
        updates = spark.read.schema(kind).parquet(f"{home}/updates")
    except Exception as e:                                    # no micro-batch ran: the table has no files
        if "PATH_NOT_FOUND" not in str(e):
            raise
        updates = spark.createDataFrame([], kind)
    last = updates.groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("s"))      # n only grows
    return last.select("digest", F.col("s.n").alias("n"), F.col("s.keep.doc_id").alias("keep_id"),
                       F.col("s.keep.file").alias("file"), F.col("s.keep.row").alias("row"))


def exact_dedup(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256,
                id_col: str = "doc_id", text_col: str = "text", files_per_batch: int = 4000, run: str | None = None) -> DataFrame:
    """One row per document of the Parquet table at ``path``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts (identical, null as empty) the row with the largest id stays; of rows that also share the
    id, the last by file and row number. ``digest`` may be any function of the text: texts that only share a
    digest are told apart by their bytes. ``run`` names a stream that is to be taken up again. Other columns are not read; an empty table gives no rows.
    """
    state = stage(stream_state(spark, path, digest, id_col, text_col, files_per_batch, run), "dedup-state")
    table = _located(spark.read.parquet(path), digest, id_col, text_col)
    rows = table.select("doc_id", "digest", "file", "row", sha256(F.col("text")).alias("text_sha256"))
    rows = stage(rows, "dedup-rows")
    # full bytes of hits, by locator; equal rows collapse before the shuffle
    hits = rows.join(state.where("n > 1").select("digest"), "digest").select("digest", "doc_id", "file", "row")
    located = table.select("file", "row", "text")
    texts = hits.join(located, ["file", "row"]).groupBy("digest", "text") \
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    classes = stage(texts, "dedup-hits")
    clashes = stage(classes.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "dedup-clashes")
    plain = rows.join(state.select("digest", "n", F.struct("keep_id", "file", "row").alias("keep")), "digest")
    kept = (F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row"))
    out = plain.select("doc_id", F.col("keep.keep_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"),
                       "text_sha256", "digest")
    if not clashes.isEmpty():
        own = hits.join(clashes, "digest").join(located, ["file", "row"]).join(classes, ["digest", "text"])
        first = F.row_number().over(Window.partitionBy("digest", "text", "doc_id").orderBy(F.desc("file"), F.desc("row"))) == 1
        own = own.select("doc_id", "keep_id", F.col("n").alias("group_size"),
                         (F.col("doc_id").eqNullSafe(F.col("keep_id")) & first).alias("kept"), sha256(F.col("text")).alias("text_sha256"), "digest")
        out = out.join(clashes, "digest", "left_anti").unionByName(own)
    return out.drop("digest")
