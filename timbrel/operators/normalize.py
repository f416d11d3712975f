"""Per-speaker normalisation and quantile bins, over long feature tables ``(key.., speaker, feature, value)``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.operators.skew import hot_join
from timbrel.session import is_small, written
from timbrel.taxonomy import BINS

EPSILON = 1e-8
#: Statistics of at most so many speakers and features are broadcast.
MAX_BROADCAST = 500_000
#: Buckets of a pass of the quantile search, and the rows of a feature up to which one task may hold its values.
BUCKETS = 1024
MAX_HELD = 1_000_000


def long_features(df: DataFrame, keys: list[str], array: str, names: tuple[str, ...]) -> DataFrame:
    """One row per feature of an array column, the first ``len(names)`` of them."""
    named = F.array(*(F.lit(n) for n in names))
    at = F.posexplode(F.slice(array, 1, len(names))).alias("_i", "value")
    return df.select(*keys, at).select(*keys, F.element_at(named, F.col("_i") + 1).alias("feature"), F.col("value").cast("double").alias("value"))


def speaker_stats(long: DataFrame, speaker: str = "speaker") -> DataFrame:
    """Mean and population spread of each speaker's features, and the rows they come from."""
    return long.groupBy(speaker, "feature").agg(F.avg("value").alias("mean"), (F.stddev_pop("value") + EPSILON).alias("std"), F.count("*").alias("rows"))


def znorm(long: DataFrame, stats: DataFrame, speaker: str = "speaker") -> DataFrame:
    """Adds ``z``; the value itself for a speaker or feature without statistics.

    The statistics are stored and broadcast up to ``MAX_BROADCAST`` rows. More of them meet by a
    shuffle that leaves the rows of hot speakers where they are.
    """
    keys, stats = [speaker, "feature"], written(stats, "stats")
    if is_small(stats, MAX_BROADCAST):
        out = long.join(F.broadcast(stats), keys, "left")
    else:
        out = hot_join(long, stats, keys).unionByName(long.join(stats.select(*keys), keys, "left_anti"), allowMissingColumns=True)
    return out.withColumn("z", F.coalesce((F.col("value") - F.col("mean")) / F.col("std"), F.col("value"))).drop("mean", "std", "rows")


def quantile_cuts(long: DataFrame, value: str = "value", bins: int = 5, max_held: int = MAX_HELD) -> DataFrame:
    """Exact linear-interpolated cut points of each feature; nulls are no values, NaN is the largest.

    A feature of up to ``max_held`` rows is one aggregate, which holds its distinct values. The
    places sought in a larger one are closed in on by histograms: each pass counts the rows in
    ``BUCKETS`` parts of the range in which a place lies, with the least and largest value of each part, until
    these are one value. Parts are few, so the passes leave nothing large to any task. ``long`` is
    read once a pass, so it should be a stored table.
    """
    shares = [i / bins for i in range(1, bins)]
    rows = long.where(F.col(value).isNotNull())
    sizes = {r.feature: r.n for r in rows.groupBy("feature").agg(F.count("*").alias("n")).collect()}  # one row per feature
    large = {f: n for f, n in sizes.items() if n > max_held}
    held = rows if not large else rows.where(~F.coalesce(F.col("feature").isin([f for f in large if f is not None]), F.lit(None in large)))
    cuts = held.groupBy("feature").agg(F.percentile(value, F.array(*map(F.lit, shares))).alias("cuts"))
    if not large:
        return cuts
    at = {f: [q * (n - 1) for q in shares] for f, n in large.items()}
    found = _at_places(rows, value, {f: {int(p) for x in places for p in (math.floor(x), math.ceil(x))} for f, places in at.items()})

    def between(f, x):
        low, high = math.floor(x), math.ceil(x)
        return found[f, low] if low == high else (high - x) * found[f, low] + (x - low) * found[f, high]

    spark = long.sparkSession
    return cuts.union(spark.createDataFrame([(f, [between(f, x) for x in places]) for f, places in at.items()], cuts.schema))


def _at_places(rows: DataFrame, value: str, places: dict[str, set[int]]) -> dict[tuple, float]:
    """The value at each place of a feature's values in order, from 0."""
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != math.inf)
    per = rows.groupBy("feature").agg(
        F.count_if(v == -math.inf).alias("low"), F.count_if(finite).alias("n"), F.count_if(v == math.inf).alias("high"), F.min(F.when(finite, v)).alias("lo"), F.max(F.when(finite, v)).alias("hi")
    )
    found, ranges = {}, []
    for r in per.collect():  # one row per feature
        inside = set()
        for p in places.get(r.feature, ()):
            if p < r.low:
                found[r.feature, p] = -math.inf
            elif p < r.low + r.n:
                inside.add(p)
            else:
                found[r.feature, p] = math.inf if p < r.low + r.n + r.high else math.nan
        if inside:
            ranges.append((r.feature, r.lo, r.hi, r.low, inside))
    spark = rows.sparkSession
    while ranges:
        open_ = []
        for f, lo, hi, below, inside in ranges:
            if lo == hi:
                found |= {(f, p): lo for p in inside}
            else:
                open_.append((f, lo, hi, below, inside))
        if not open_:
            break
        table = spark.createDataFrame([(i, f, lo, hi) for i, (f, lo, hi, _, _) in enumerate(open_)], "i int, f string, lo double, hi double")
        # halves keep the width of the whole range of doubles finite; the part grows with the value
        part = F.least(F.floor((v / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BUCKETS), F.lit(BUCKETS - 1))
        part = F.when(v == F.col("hi"), BUCKETS - 1).when(v == F.col("lo"), 0).otherwise(F.coalesce(part, F.lit(0)))
        met = rows.join(F.broadcast(table), rows["feature"].eqNullSafe(F.col("f")) & v.between(F.col("lo"), F.col("hi")) & finite)  # a few rows per feature
        counts: dict[int, list] = {}
        for r in met.groupBy("i", part.alias("b")).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).collect():  # at most BUCKETS a range
            counts.setdefault(r.i, []).append((r.b, r.n, r.lo, r.hi))
        ranges = []
        for i, (f, _, _, below, inside) in enumerate(open_):
            for _, n, lo, hi in sorted(counts[i]):
                here = {p for p in inside if below <= p < below + n}
                # the ends of a part are known
                found |= {(f, p): lo if p == below else hi for p in here if p in (below, below + n - 1)}
                here -= {below, below + n - 1}
                if here:
                    ranges.append((f, lo, hi, below, here))
                below += n
    return found


def discretize(long: DataFrame, cuts: DataFrame, value: str = "z", labels: tuple[str, ...] = BINS) -> DataFrame:
    """Adds ``bin``: the label by how many cut points lie below the value; ``medium`` without cut points.

    One row per feature is broadcast. Whether cut points come from raw or from
    normalised values is the caller's choice of what they are fitted on.
    """
    held = F.size(F.filter("cuts", lambda c: c < F.col(value)))
    label = F.element_at(F.array(*(F.lit(x) for x in labels)), F.least(held, F.lit(len(labels) - 1)) + 1)
    return long.join(F.broadcast(cuts), "feature", "left").withColumn("bin", F.when(F.col("cuts").isNull(), F.lit("medium")).otherwise(label)).drop("cuts")
