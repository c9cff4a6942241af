"""Running totals and quantiles of many groups, ROC corners, sketches, samples and factor ranks against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from orderlens.ml import evaluation as ev
from orderlens.ml.extras import cap_outliers_by, class_weights, draw, fit_caps_by, stratified_sample
from orderlens.operators.cumulative import running_totals
from orderlens.operators.quantile import exact_quantiles, grouped_quantiles
from orderlens.operators.sketch import QuantileSketch, rank_check
from orderlens.plans.insights import rank_factors


def disc(values, p):
    values = sorted(values)
    return values[min(max(math.ceil(p * len(values)), 1), len(values)) - 1]


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("rows_per_range", [2, 1000])
def test_group_totals_and_neighbours(spark, descending, rows_per_range):
    rnd = random.Random(4)
    rows = [(g, v, rnd.randint(0, 3)) for g in ("hot", "b", None, "c") for v in rnd.sample(range(1000), 300 if g == "hot" else 5)] + [("b", None, 7)]
    df = spark.createDataFrame(rows, "g string, v int, n int")
    got = {(r["g"], r["v"]): (r["cum_n"], r["total_n"], r["next_n"])
           for r in running_totals(df, "v", ["n"], descending, rows_per_range, groups=["g"], following=["n"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0), reverse=descending)
        total = 0
        for k, r in enumerate(own):
            total += r[2]
            want[g, r[1]] = (total, sum(x[2] for x in own), own[k + 1][2] if k + 1 < len(own) else None)
    assert got == want


def test_grouped_quantiles_with_hot_and_null_groups(spark):
    rnd = random.Random(5)
    rows = [("hot", float(rnd.randint(0, 500))) for _ in range(3000)] + [(None, float(k)) for k in range(7)] + [("one", 2.0), ("none", None)]
    rows += [(f"g{k}", rnd.random()) for k in range(40) for _ in range(rnd.randint(1, 9))]
    ps = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {r["g"]: tuple(r)[1:] for r in grouped_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", ps, rows_per_range=50).collect()}
    by = defaultdict(list)
    for g, x in rows:
        if x is not None:
            by[g].append(x)
    assert got == {g: tuple(disc(v, p) for p in ps) for g, v in by.items()}


def test_exact_quantiles_need_no_writes(spark, tmp_path):
    rnd = random.Random(6)
    values = [rnd.choice([rnd.random(), 0.25, float("inf"), -1e300, 5e-324]) for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    ps = [0.0, 0.001, 0.2, 0.4, 0.6, 0.999, 1.0]
    for most in (10, 1_000_000):
        assert exact_quantiles(df, "x", ps, rows_per_range=most) == [disc(values, p) for p in ps]


def test_caps_by_group(spark):
    rows = [(k, "a" if k % 3 else None, float(k)) for k in range(100)] + [(100, "new", 5.0), (101, "a", None)]
    df = spark.createDataFrame(rows, "k int, g string, x double")
    caps = fit_caps_by(df.where("k < 100"), "g", "x", 0.1, 0.9)
    got = {r["k"]: r["x"] for r in cap_outliers_by(df, caps, "g", "x").collect()}
    for k, g, x in rows:
        own = [float(j) for j in range(100) if ("a" if j % 3 else None) == g]
        assert got[k] == (x if x is None or not own else min(max(x, disc(own, 0.1)), disc(own, 0.9)))


def corners(points):
    """Points (pos, neg) in score order: first, last, and where the next step differs."""
    keep, tp, fp = [(0, 0)] if points else [], 0, 0
    for k, (pos, neg) in enumerate(points):
        tp, fp = tp + pos, fp + neg
        if k in (0, len(points) - 1) or points[k + 1] != (pos, neg):
            keep.append((tp, fp))
    return keep


@pytest.mark.parametrize("rows_per_range", [1, 7, 10_000])
def test_roc_corners(spark, rows_per_range):
    rnd = random.Random(7)
    rows = [(float(rnd.choice([0, 0, 1])), float(rnd.randint(0, 150))) for _ in range(400)] + [(0.0, 1000.0 + k) for k in range(60)] + [(1.0, -5.0)]
    df = spark.createDataFrame(rows, "label double, score double")
    counts = defaultdict(Counter)
    for label, score in rows:
        counts[score][label] += 1
    want = corners([(counts[s][1.0], counts[s][0.0]) for s in sorted(counts, reverse=True)])
    got = sorted((r["tp"], r["fp"]) for r in ev.roc_corners(df, rows_per_range=rows_per_range).collect())
    assert got == sorted(want) and len(got) < len(counts) - 50
    assert sorted((r["tp"], r["fp"]) for r in ev.roc_corners(counts=ev.score_counts(df)).collect()) == got
    assert ev.roc_corners(df.limit(0)).count() == 0


def test_corners_draw_the_same_curve(spark):
    df = spark.createDataFrame([(float(k % 5 == 0), float(k // 3)) for k in range(300)], "label double, score double")
    points = sorted((r["fpr"], r["tpr"]) for r in ev.roc_corners(df).collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert area == pytest.approx(ev.auc(df).first()[0], abs=1e-12)


def test_sketch_grows_batch_by_batch(spark):
    rnd = random.Random(8)
    values = [rnd.gauss(0, 1) ** 3 for _ in range(30_000)] + [7.0] * 3000
    rnd.shuffle(values)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double")
    state = QuantileSketch()
    for lo in range(0, 33_000, 11_000):
        state = state.add(df.where(F.col("k").between(lo, lo + 10_999)), "x")
    assert state.n == len(values) and len(state.data) < 40_000
    answers = {p: state.quantile(spark, p) for p in (0.01, 0.25, 0.5, 0.9)}
    assert all(r["within_bound"] for r in rank_check(df, "x", answers, error=0.02).collect())
    assert not rank_check(df, "x", {0.5: 1e9}).first()["within_bound"]
    odd = spark.createDataFrame([(None,), (float("nan"),), (3.0,)], "x double")
    assert QuantileSketch.of(odd, "x").n == 1 and QuantileSketch.of(odd, "x").quantile(spark, 0.5) == 3.0
    with pytest.raises(ValueError):
        QuantileSketch.of(odd.limit(0), "x").quantile(spark, 0.5)


def test_stratified_sample(spark):
    rows = [(k, "a" if k % 4 else "b" if k % 8 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, y string")
    by_draw = sorted(df.select("k", "y", draw("k", 42).alias("h")).collect(), key=lambda r: r["h"])
    want = {y: {r["k"] for r in [r for r in by_draw if r["y"] == y][:50]} for y in ("a", "b", None)}
    got = defaultdict(set)
    for r in stratified_sample(df.repartition(5), "y", "k").collect():
        got[r["y"]].add(r["k"])
    assert dict(got) == want
    sizes = Counter(r["y"] for r in stratified_sample(df, "y", "k", {"a": 7, None: 1000}).collect())
    assert sizes == {"a": 7, None: 50}
    assert stratified_sample(df.limit(0), "y", "k").count() == 0


def test_sample_of_repeated_keys(spark):
    """A third of the rows is one row again and again: still exactly as many as wanted, as copies of it."""
    rows = [(1, "a", 5)] * 30_000 + [(1, "a", 6)] * 10 + [(k, "a", 0) for k in range(2, 60)] + [(k, "b", 0) for k in range(100)]
    df = spark.createDataFrame(rows, "k long, y string, z int").repartition(4)
    smaller = sum(r["h"] < df.where("k = 1").select(draw("k", 42)).first()[0] for r in df.where("k > 1 and y = 'a'").select(draw("k", 42).alias("h")).collect())
    for size in (100, 25_000, 30_064):
        got = stratified_sample(df, "y", "k", {"a": size}).groupBy("k", "z").count().collect()
        assert sum(r["count"] for r in got) == size
        assert sum(r["count"] for r in got if r["k"] == 1) == min(size - smaller, 30_010)


def test_class_weights_has_no_forced_broadcast(spark):
    df = spark.range(10).withColumn("y", F.col("id") % 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in class_weights(df, "y")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rank_factors(spark):
    rnd = random.Random(9)
    rows = []
    for k in range(500):
        y = k % 2
        rows.append((k, y, rnd.random() + y, rnd.randint(0, 3), rnd.choice(["u", "v", None]), "same", float(y)))
    df = spark.createDataFrame(rows, "k int, y int, near double, noise int, word string, constant string, exact double")
    got = {r["factor"]: r for r in rank_factors(df, "y", ("k",)).collect()}

    def entropy(labels):
        p = sum(labels) / len(labels)
        return 0.0 if p in (0, 1) else -p * math.log2(p) - (1 - p) * math.log2(1 - p)

    for place, name in ((2, "near"), (3, "noise"), (4, "word"), (5, "constant"), (6, "exact")):
        column = [r[place] for r in rows]
        if name in ("near", "noise", "exact"):
            edges = {disc(column, k / 10) for k in range(1, 10)}
            column = [sum(x > e for e in edges) for x in column]
        cells = defaultdict(list)
        for r, level in zip(rows, column):
            cells[level].append(r[1])
        gain = entropy([r[1] for r in rows]) - sum(len(c) * entropy(c) for c in cells.values()) / len(rows)
        assert got[name]["information_gain"] == pytest.approx(gain, abs=2e-9) and got[name]["levels"] == len(cells) and got[name]["orders"] == 500
    assert got["exact"]["rank"] == 1 and got["constant"]["information_gain"] == 0 and got["constant"]["rank"] == 5
