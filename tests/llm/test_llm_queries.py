import pytest

from timbrel.llm import queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL.get(name))


def test_every_problem_has_its_query():
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 7, 9, 10)} | {"p8_ids"} <= set(QUERIES) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("rows", ["none", "nulls"])
def test_queries_on_empty_and_null_tables(spark, tmp_path_factory, rows):
    import os

    from pyspark.sql import functions as F

    SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    d = str(tmp_path_factory.mktemp(rows))
    for n in ("meld_utterances", "emotion_samples", "vad_annotations", "cot_samples", "inference_results", "documents", "eval_items", "target_shares", "split_targets"):
        df = spark.read.parquet(f"{SF_DIR}/{n}.parquet")
        nulls = df.limit(2).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema))
        (df.limit(0) if rows == "none" else nulls).write.parquet(f"{d}/{n}.parquet")
    for q in QUERIES.values():
        q(spark, d).collect()
