"""The rows of the pN_found queries come from the method: with it stubbed they are others."""

import os

import pytest
from pyspark.sql import functions as F

from timbrel.llm import consensus, conversations, defects, leakage, overlaps, queries, sampling, spans, splitting

SF_DIR = os.environ.get("TEST_SF_DIR_METHODS", "/root/testdata/sf0.01")


def one(links, src="src", dst="dst"):
    return links.select(F.col(src).alias("node")).union(links.select(dst)).distinct().withColumn("component", F.lit(1).cast("long"))


def echo(links, src="src", dst="dst"):
    return links.select(F.col(src).alias("node"), F.col(dst).alias("component"))


def alone(links, src="src", dst="dst"):
    return one(links, src, dst).select("node", F.col("node").alias("component"))


def no_product(r, keys, x=None):
    df = r.select("person", "v", "a", F.lit(1.0).alias("x"), F.lit(0.0).alias("ov"), F.lit(0.0).alias("oa"))
    return df, df


STUBS = [
    ("p1_found", conversations, "star_components", one), ("p1_found", conversations, "star_components", echo), ("p1_found", conversations, "star_components", alone),
    ("p2_found", sampling, "allocate", lambda available, target, floor, total, seed=0: dict.fromkeys(target, 0)),
    ("p3_found", overlaps, "similar_classes", lambda classes: classes.sparkSession.createDataFrame([], "cls_a long, cls_b long, edits int, in_b double, in_a double")),
    ("p4_found", defects, "field_defects", lambda *a: set()),
    ("p5_found", splitting, "frontier_components", one), ("p5_found", splitting, "frontier_components", echo), ("p5_found", splitting, "frontier_components", alone),
    ("p7_found", consensus, "others", no_product),
    ("p9_found", leakage, "size_class", lambda n: 0), ("p9_found", leakage, "_near", lambda *a: False),
    ("p10_found", spans, "chains", lambda codes, starts: (spans.np.zeros(0, spans._U), spans.np.zeros(0, int), spans.np.zeros(0, int))),
]
_rows = {}


@pytest.mark.parametrize("name, module, attribute, stub", STUBS, ids=[f"{n}-{a}-{i}" for i, (n, _, a, _) in enumerate(STUBS)])
def test_rows_come_from_the_method(spark, monkeypatch, name, module, attribute, stub):
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    query = queries.queries()[name]
    rows = lambda: sorted(map(tuple, query(spark, SF_DIR).collect()))
    if name not in _rows:
        _rows[name] = rows()
    monkeypatch.setattr(module, attribute, stub)
    assert rows() != _rows[name]
