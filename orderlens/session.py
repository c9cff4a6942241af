"""Session helpers: building a session for tests/bench, and lineage cuts.

Library code never invents storage locations. Materialised intermediates go
under the directory the cluster names in ``spark.checkpoint.dir``; only tests
and the bench (which own their session) fill that setting in when it is unset.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  checkpoint_dir: str | None = None,
                  app_name: str = "orderlens", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench. Production code receives its session.

    ``checkpoint_dir`` is a fallback used only when the session's
    configuration names no ``spark.checkpoint.dir``.
    """
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if checkpoint_dir:
        # only where the cluster names no folder (spark.checkpoint.dir)
        ensure_checkpoint_dir(spark, checkpoint_dir)
    return spark


def checkpoint_root(spark: SparkSession, required: bool = True) -> str | None:
    """The shared folder named by the cluster for lineage cuts."""
    try:
        root = spark.sparkContext.getCheckpointDir()
    except Exception:  # noqa: BLE001 - no SparkContext (Connect session): conf only
        root = None
    if not root:
        root = spark.conf.get(_CHECKPOINT_KEY, None)
    if not root and required:
        raise RuntimeError(
            "spark.checkpoint.dir is not set; the cluster must name a shared "
            "folder for materialised intermediates")
    return root


def ensure_checkpoint_dir(spark: SparkSession, fallback: str) -> str:
    """Use the session's checkpoint dir; set ``fallback`` only when unset (tests)."""
    root = checkpoint_root(spark, required=False)
    if not root:
        spark.sparkContext.setCheckpointDir(fallback)
        root = spark.sparkContext.getCheckpointDir()
    return root


_local_root: list[str] = []


def work_root(spark: SparkSession) -> str:
    """Folder for job outputs that must outlive a task (stream state, sinks).

    The cluster's checkpoint folder; a local-mode session without one gets a
    temporary folder (never on a cluster). The session itself stays as it is.
    """
    root = checkpoint_root(spark, required=False)
    if root:
        return root
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="orderlens-work-"))
    return _local_root[0]


_scope: ContextVar[list | None] = ContextVar("orderlens_staged", default=None)


@contextmanager
def dropping_staged(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, the tables that were staged inside, and release persisted ones.

    What is made inside reads its staged tables when it runs, so results that are still wanted afterwards must be written or
    collected before the end. Nested blocks drop their own tables. Other folders of the checkpoint folder are left alone.
    """
    made: list = []
    token = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(token)
        for x in made:
            if isinstance(x, DataFrame):
                x.unpersist()
            else:
                path = spark._jvm.org.apache.hadoop.fs.Path(x)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _note(staged: DataFrame | str) -> None:
    made = _scope.get()
    if made is not None:
        made.append(staged)


def materialize(df: DataFrame, name: str, rebalance: bool = True) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    Cuts the lineage so downstream stages (many model fits, several metrics)
    read a fixed table instead of recomputing the feature joins, and a lost
    executor only costs a re-read of files on shared storage.

    With ``rebalance`` the write is rebalanced: AQE sizes its partitions to the advisory
    partition size, so a small table becomes one file (one task per model
    iteration later) and a large one many evenly sized files.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/orderlens/{name}-{uuid.uuid4().hex}"
    _note(path)                                              # before the write: a part of a failed one goes too
    (df.hint("rebalance") if rebalance else df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def stage(df: DataFrame, name: str, rebalance: bool = True) -> DataFrame:
    """Compute ``df`` once before it is read many times (fits, metrics).

    With a shared checkpoint folder the table is written there and read
    back, which also cuts the lineage: a lost executor costs a re-read, not a
    recomputation of the joins. A session that names no folder gets a
    persisted copy instead (recomputed from lineage if lost).
    """
    if checkpoint_root(df.sparkSession, required=False):
        return materialize(df, name, rebalance)
    out = (df.hint("rebalance") if rebalance else df).persist(StorageLevel.MEMORY_AND_DISK)
    _note(out)
    out.count()
    return out
