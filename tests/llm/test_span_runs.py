import random

import numpy as np

from timbrel.llm import spans


def keys(text):
    return set(spans.chains(*spans._codes([text]))[0].tolist())


def test_spans_of_long_runs_share_a_chain():
    assert keys("a" * 207 + "b" * 205) & keys("a" * 230 + "b" * 219)
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(1, 400)
        left, right = rng.choice("ab"), rng.choice("cd")
        one, two = (left * (n + rng.randrange(0, 60)) + right * (400 - n + rng.randrange(0, 60)) for _ in "12")
        assert keys("x y " + one + " z") & keys("q " + two + " r s")


def test_pair_of_long_runs_is_found(spark):
    docs = spark.createDataFrame([(1, "a" * 207 + "b" * 205), (2, "a" * 230 + "b" * 219), (3, "a" * 150 + "c" * 300)], "doc_id long, text string")
    assert {tuple(r) for r in spans.document_pairs(docs).collect()} == {(1, 2)}
