"""Property tests with random inputs (few examples: each runs Spark jobs)."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from orderlens.ml import evaluation as ev
from orderlens.operators.cumulative import running_totals
from orderlens.operators.quantile import exact_quantile

SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])

values = st.lists(st.integers(min_value=-50, max_value=50).map(float), min_size=1, max_size=300)


@SETTINGS
@given(vals=values, p=st.floats(min_value=0.0, max_value=1.0))
def test_quantile_is_percentile_disc(spark, vals, p):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    s = sorted(vals)
    want = s[min(len(s), max(1, math.ceil(p * len(s)))) - 1]
    assert exact_quantile(df, "x", p, rows_per_range=7) == want


@SETTINGS
@given(rows=st.dictionaries(st.integers(min_value=0, max_value=10_000).map(float),
                            st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=200),
       descending=st.booleans())
def test_running_totals_match_cumsum(spark, rows, descending):
    data = [(k, a, b) for k, (a, b) in rows.items()]
    df = spark.createDataFrame(data, "v double, a long, b long")
    out = {r["v"]: (r["cum_a"], r["cum_b"]) for r in
           running_totals(df, "v", ["a", "b"], descending=descending, rows_per_range=13).collect()}
    acc_a = acc_b = 0
    for v, a, b in sorted(data, key=lambda r: -r[0] if descending else r[0]):
        acc_a, acc_b = acc_a + a, acc_b + b
        assert out[v] == (acc_a, acc_b)


@SETTINGS
@given(pairs=st.lists(st.tuples(st.booleans(), st.integers(0, 20)), min_size=2, max_size=150))
def test_auc_is_mann_whitney(spark, pairs):
    pos = [s for lab, s in pairs if lab]
    neg = [s for lab, s in pairs if not lab]
    if not pos or not neg:
        return
    want = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame([(float(lab), float(s)) for lab, s in pairs], "label double, score double")
    got = ev.auc(df).first()["auc"]
    assert abs(got - want) < 1e-12
    flipped = spark.createDataFrame([(float(lab), -float(s)) for lab, s in pairs], "label double, score double")
    assert abs(got + ev.auc(flipped).first()["auc"] - 1.0) < 1e-12
