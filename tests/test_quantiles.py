"""Cut points by histograms, splits by hash digits and normalisation by hot joins give what the direct ways give."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from timbrel.operators import normalize, sft

VALUE = st.one_of(st.floats(allow_nan=True, allow_infinity=True, width=64), st.sampled_from([0.0, 1.0, 1.0, 5e-324, 1.7e308, -1.7e308]))


def same(a, b):
    return a == b or math.isnan(a) and math.isnan(b) or abs(a - b) <= 1e-12 * max(abs(a), abs(b))


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(VALUE, st.none())), max_size=40))
def test_histograms_close_in_on_exact_places(spark, rows):
    df = spark.createDataFrame(rows, "feature string, value double")
    want = {r.feature: r.cuts for r in normalize.quantile_cuts(df).collect()}
    got = {r.feature: r.cuts for r in normalize.quantile_cuts(df, max_held=0).collect()}
    assert set(got) == set(want)
    finite = [v for _, v in rows if v is not None and math.isfinite(v)]
    if not finite or max(map(abs, finite)) < 1e300:  # beyond, a difference of two values overflows
        assert all(same(x, y) for f in want for x, y in zip(got[f], want[f]) if not (math.isinf(x) or math.isinf(y) or math.isnan(x) or math.isnan(y)))


def test_many_values_and_ties(spark):
    rng = random.Random(3)
    rows = [("n", rng.gauss(0, 1)) for _ in range(3000)] + [("t", float(rng.randrange(3))) for _ in range(1000)] + [("c", 2.5)] * 7 + [("e", math.exp(rng.uniform(-300, 300))) for _ in range(2000)] + [("n", None), ("i", math.inf), ("i", 1.0), ("i", -math.inf), ("i", 2.0), ("i", 3.0), ("i", math.nan)]
    df = spark.createDataFrame(rows, "feature string, value double").cache()
    want = {r.feature: r.cuts for r in normalize.quantile_cuts(df).collect()}
    got = {r.feature: r.cuts for r in normalize.quantile_cuts(df, max_held=5).collect()}
    assert set(got) == set(want) and all(same(x, y) for f in want for x, y in zip(got[f], want[f]))
    assert normalize.quantile_cuts(df.limit(0)).count() == 0


@pytest.mark.parametrize("ratio", [0.1, 0.5, 0.999])
def test_split_sizes_and_order_do_not_depend_on_how_many_are_sorted(spark, ratio):
    df = spark.range(5000).selectExpr("id % 4990 as id", "'x' as is_validation")
    few = sft.with_split(df, "id", ratio, 7, max_sorted=1)
    many = sft.with_split(df, "id", ratio, 7, max_sorted=10**9)
    assert few.where("is_val").count() == int(5000 * ratio) == many.where("is_val").count()
    assert few.where("is_val").select("id").distinct().exceptAll(many.where("is_val").select("id").distinct()).count() == 0


def test_statistics_that_are_too_many_to_broadcast(spark, monkeypatch):
    rows = [(i, f"s{i % 3}", "f", float(i)) for i in range(30)] + [(99, "new", "f", 7.0), (98, None, "f", 1.0)]
    df = spark.createDataFrame(rows, "id int, speaker string, feature string, value double")
    stats = normalize.speaker_stats(df.where("speaker <> 'new'"))
    want = sorted((r.id, r.z) for r in normalize.znorm(df, stats).collect())
    monkeypatch.setattr(normalize, "MAX_BROADCAST", 1)
    assert sorted((r.id, r.z) for r in normalize.znorm(df, stats).collect()) == want and dict(want)[99] == 7.0 and dict(want)[98] == 1.0
