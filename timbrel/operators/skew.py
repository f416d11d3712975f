"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all rows is hot; so there are at most 1 / HOT_SHARE hot keys, a few MB to broadcast,
#: and a cold key of 10^12 rows has 10^7 at most.
HOT_SHARE = 0.00001
#: A key with fewer rows than this is never hot.
HOT_LEAST = 50_000


def hot_join(big: DataFrame, small: DataFrame, keys: list[str], rows: str = "rows", share: float = HOT_SHARE, least: int = HOT_LEAST) -> DataFrame:
    """Inner join of ``big`` with ``small``, which has one row per key and, in ``rows``, its rows in ``big``.

    Rows of hot keys stay where they are: the hot part of ``small`` has at most
    ``1 / share`` rows and is broadcast. All other keys meet by a shuffle in which none
    is large. Both inputs are read more than once, so they should be stored tables.
    """
    top = small.agg(F.max(rows).alias("m"), F.sum(rows).alias("s")).first()
    limit = max(least, int(share * (top.s or 0)))
    if (top.m or 0) <= limit:
        return big.join(small, keys)
    hot = F.broadcast(small.where(F.col(rows) > limit))
    cold = big.join(F.broadcast(small.where(F.col(rows) > limit).select(*keys)), keys, "left_anti")
    return big.join(hot, keys).unionByName(cold.join(small.where(F.col(rows) <= limit), keys))


def salted_join(big: DataFrame, many: DataFrame, counts: DataFrame, keys: list[str], salts: int = 64, share: float = HOT_SHARE, least: int = HOT_LEAST) -> DataFrame:
    """Inner join of ``big`` with ``many``, which may have several rows per key; ``counts`` holds the ``rows`` of each key in ``big``.

    Rows of hot keys are spread over ``salts`` parts and meet as many copies of the other side's
    rows of those keys. All inputs are read more than once, so they should be stored tables.
    """
    top = counts.agg(F.max("rows").alias("m"), F.sum("rows").alias("s")).first()
    limit = max(least, int(share * (top.s or 0)))
    if (top.m or 0) <= limit:
        return big.join(many, keys)
    hot = F.broadcast(counts.where(F.col("rows") > limit).select(*keys))
    cold = big.join(hot, keys, "left_anti").join(many.join(hot, keys, "left_anti"), keys)
    spread = big.join(hot, keys, "left_semi").withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)))
    copies = many.join(hot, keys, "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return cold.unionByName(spread.join(copies, [*keys, "_salt"]).drop("_salt"))
