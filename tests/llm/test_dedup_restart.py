"""The deduplication stream takes up where a run of the same name ended."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from orderlens.llm import dedup_stream

KIND = "doc_id long, text string"


def add(spark, path, rows):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(path)


def states(df):
    return {r["digest"]: (r["n"], r["keep_id"]) for r in df.collect()}


def digests_of_batches(spark, run, path):
    folder = f"{dedup_stream.run_home(spark, run, path)}/updates"
    return {d: {r["digest"] for r in spark.read.parquet(f"{folder}/{d}").collect()} for d in os.listdir(folder.removeprefix("file:")) if d.startswith("batch=")}


def test_added_files_are_read_alone(spark, tmp_path):
    path, run = str(tmp_path / "documents"), uuid.uuid4().hex
    add(spark, path, [(1, "a"), (2, "b"), (3, "a"), (4, None)])
    first = states(dedup_stream.stream_state(spark, path, run=run))
    assert sorted(first.values()) == [(1, 2), (1, 4), (2, 3)]
    add(spark, path, [(9, "a"), (5, "c"), (6, "")])
    got = states(dedup_stream.stream_state(spark, path, run=run))
    assert got == states(dedup_stream.stream_state(spark, path)) and sorted(got.values()) == [(1, 2), (1, 5), (2, 6), (3, 9)]
    batches = digests_of_batches(spark, run, path)
    b = spark.range(1).select(dedup_stream.sha256(F.lit("b"))).first()[0]
    assert [b in batches[k] for k in sorted(batches)[:2]] == [True, False]       # the text of the first file was not read again
    again = states(dedup_stream.stream_state(spark, path, run=run))              # nothing new
    assert again == got
    rows = {r["doc_id"]: r for r in dedup_stream.exact_dedup(spark, path, run=run).collect()}
    assert {i: r["keep_id"] for i, r in rows.items()} == {1: 9, 2: 2, 3: 9, 4: 6, 5: 5, 6: 6, 9: 9}
    assert {i for i, r in rows.items() if r["kept"]} == {2, 5, 6, 9}


def test_a_failed_run_goes_on(spark, tmp_path):
    path, run = str(tmp_path / "documents"), uuid.uuid4().hex
    for k, rows in enumerate([[(1, "a"), (2, "b")], [(3, "a"), (4, "poison")], [(5, "b"), (6, "a")]]):
        add(spark, path, rows)
        for name in os.listdir(path):                       # files come in order of their time
            if os.stat(f"{path}/{name}").st_mtime > 1e9 + 1e6:
                os.utime(f"{path}/{name}", (1e9 + k, 1e9 + k))

    def breaks(text):
        return F.when(text == "poison", F.raise_error(F.lit("lost executor"))).otherwise(dedup_stream.sha256(text))

    with pytest.raises(Exception, match="lost executor"):
        dedup_stream.stream_state(spark, path, breaks, files_per_batch=1, run=run)
    done = spark.read.parquet(f"{dedup_stream.run_home(spark, run, path)}/updates/batch=0")
    assert sorted(r["keep"]["doc_id"] for r in done.collect()) == [1, 2]         # the first file was done, the second not
    got = states(dedup_stream.stream_state(spark, path, files_per_batch=1, run=run))
    assert got == states(dedup_stream.stream_state(spark, path)) and sorted(got.values()) == [(1, 4), (2, 5), (3, 6)]
