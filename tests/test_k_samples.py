"""k_average and k_best over keys of every number of samples, against exact arithmetic."""

import math
from fractions import Fraction

import pytest

from timbrel.plans import rubric_queries as R

COUNTS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 13)


def half_even(x, places):
    y = x * 10**places
    whole = math.floor(y)
    return whole + (y - whole > Fraction(1, 2) or (y - whole == Fraction(1, 2) and whole % 2 == 1))


def root_half_even(x, places):
    whole = math.isqrt(math.floor(x * 100**places))
    middle = Fraction(2 * whole + 1, 2) ** 2 / 100**places
    return whole + (x > middle or (x == middle and whole % 2 == 1))


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """The folder of a table of order lines, and the lines by order."""
    lines = {n: [(n, i, 7 * n + 5 * i * i, 3 * n + 4 * i, float(1 + (11 * i + n) % 50)) for i in range(1, n + 1)] for n in COUNTS}
    folder = str(tmp_path_factory.mktemp("orders"))
    rows = [x for v in lines.values() for x in v]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    return folder, lines


def scores(line):
    return [1 + Fraction(int(x) % 9, 2) for x in (line[4], line[2], line[3])]


def mean(lines):
    return [sum(x) / len(lines) for x in zip(*map(scores, lines))]


def test_every_order_is_averaged(spark, orders):
    folder, lines = orders
    got = {r.l_orderkey: r for r in R.k_average(spark, folder).collect()}
    assert set(got) == set(COUNTS)
    for key, own in lines.items():
        assert got[key].k_samples == len(own)
        for name, m, column in zip(R._S, mean(own), zip(*map(scores, own))):
            spread = sum((x - m) ** 2 for x in column) / len(own)
            assert round(got[key][name] * 100, 6) == half_even(m, 2)
            assert round(got[key][f"{name}_std"] * 1000, 6) == root_half_even(spread, 3)


def test_every_order_has_a_best_line(spark, orders):
    folder, lines = orders
    got = {r.l_orderkey: (r.line, r.part) for r in R.k_best(spark, folder).collect()}
    want = {}
    for key, own in lines.items():
        target = [Fraction(half_even(m, 2), 100) for m in mean(own)]
        best = min(own, key=lambda x: (sum((a - b) ** 2 for a, b in zip(scores(x), target)), x[1:4]))
        want[key] = best[1:3]
    assert got == want
