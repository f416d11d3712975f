"""Problem 5: splits that keep related records together.

Records that share an entity are related, and relation is transitive. Entities are the
nodes of a graph: a speaker as a corpus spells it, the speaker meant, and on request the audio
file. A record that holds several entities links them, so each distinct link is one edge
however many records stand behind it, and a record belongs to the component of its first
entity. Components come from the frontier search of
:func:`timbrel.llm.graph.frontier_components`. Those that hold records of several present
splits are torn. Components go to new splits by hash order: the few that hold a noticeable
share of all rows are placed one by one where most is missing, the others by where their
hash falls in a histogram cut at the targets.

Defined cases: an id counts once; a record without any entity key is a component of its
own; a record without a known present split counts nowhere; a null share counts as 0;
empty tables give empty results; a component is never split, so a tolerance can be
missed if one component is larger than its split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbrel.llm import fields
from timbrel.llm.graph import frontier_components
from timbrel.llm.overlaps import file_key
from timbrel.operators.skew import hot_join
from timbrel.session import discard, finished, written

SEED = 7
BUCKETS = 4096
#: A component with more than this share of all rows is placed by itself; so there are at most 1 / LARGE.
LARGE = 0.002


def _entity(kind: str, *cols: Column) -> Column:
    return F.when(reduce(lambda a, b: a & b, (c.isNotNull() for c in cols)), F.xxhash64(F.lit(kind), *cols))


def records(samples: DataFrame) -> DataFrame:
    """``(sample_id, dataset_name, speaker_id, present, spelling, speaker, file)``; the last three are entity keys."""
    corpus, speaker = fields.corpus(), fields.speaker()
    s = samples.select(
        F.col("sample_id").cast("long").alias("sample_id"), corpus.alias("dataset_name"), speaker.alias("speaker_id"), fields.split().alias("present"),
        F.when(speaker.isNotNull(), _entity("spelling", F.col("dataset_name"), F.col("speaker_id"))).alias("spelling"), _entity("speaker", corpus, speaker).alias("speaker"), _entity("file", corpus, file_key()).alias("file"),
    )
    return s.where("sample_id is not null and present is not null").distinct()


def _linked(rec: DataFrame, keys: list[str]) -> DataFrame:
    """``(node, component)`` of the entities ``keys`` of records, linked by the records that hold two of them."""
    first = F.coalesce(*keys)
    links = reduce(DataFrame.union, (rec.where(f"{k} is not null").select(first.alias("src"), F.col(k).alias("dst")) for k in keys)).where("src <> dst")
    return frontier_components(links.distinct())


def components(rec: DataFrame, keys: list[str]) -> DataFrame:
    """``rec`` with its ``component``: the component of its entities, or of the record alone if it has none.

    ``rec`` is read several times, so it should be a stored table.
    """
    alone = rec.where(reduce(lambda a, b: a & b, (F.col(k).isNull() for k in keys))).withColumn("component", F.xxhash64(F.lit("record"), "sample_id"))
    held = rec.withColumn("entity", F.coalesce(*keys)).where("entity is not null")
    size = held.groupBy("entity").agg(F.count("*").alias("rows"))
    found = size.join(_linked(rec, keys).withColumnRenamed("node", "entity"), "entity", "left").select("entity", F.coalesce("component", "entity").alias("component"), "rows")
    return hot_join(held, written(found, "entities"), ["entity"]).drop("entity", "rows").unionByName(alone)


def torn_speakers(samples: DataFrame) -> DataFrame:
    """``(dataset_name, speaker_id, splits)`` of speakers that the present splits tear apart.

    Records are pre-aggregated to one node for all of a spelling and present split, which
    holds its spelling, which means its speaker. Nodes are named in full, not hashed, so a
    component is one speaker; it is torn if it holds several splits.
    """
    corpus, speaker, present = fields.corpus(), fields.speaker(), fields.split()
    named = lambda kind, a, b: F.concat(F.lit(kind), F.length(a).cast("string"), F.lit(":"), a, b)
    own = samples.where(F.col("sample_id").isNotNull()).select(
        corpus.alias("dataset_name"), speaker.alias("speaker_id"), present.alias("present"), named("spelling ", F.col("dataset_name"), F.col("speaker_id")).alias("spelling"), named("speaker ", corpus, speaker).alias("speaker")
    )
    own = own.where("speaker is not null and present is not null").groupBy(*own.columns).agg(F.count("*").alias("n_records"))
    own = written(own.withColumn("held", F.concat("present", F.lit(" of "), "spelling")), "held")
    found = frontier_components(own.select(F.col("held").alias("src"), F.col("spelling").alias("dst")).union(own.select("spelling", "speaker").distinct()))
    torn = own.join(found, F.col("held") == F.col("node")).groupBy("component").agg(F.max(F.struct("dataset_name", "speaker_id")).alias("name"), F.array_sort(F.collect_set("present")).alias("splits"))  # at most one entry a split
    return finished(torn.where("size(splits) > 1").select("name.dataset_name", "name.speaker_id", "splits"), "torn", own, found)


def _targets(targets: DataFrame) -> list[tuple[str, float]]:
    rows = sorted((r.split_name, r.target_share or 0.0) for r in targets.collect() if r.split_name)  # a handful of splits
    return [r for r in rows if r[1] > 0]


def assign(samples: DataFrame, targets: DataFrame, keys: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """``(sample_id, component, new_split)`` of every record with a known present split."""
    spark = samples.sparkSession
    keys = keys or ["spelling", "speaker"]
    held = written(records(samples).select("sample_id", *keys), "records")
    rec = finished(components(held, keys).select("sample_id", "component"), "components", held)
    size = written(rec.groupBy("component").agg(F.count("*").alias("n")), "sizes")  # read by the driver alone
    total = size.agg(F.sum("n")).first()[0] or 0
    goal = dict(_targets(targets))
    scale = sum(goal.values()) or 1.0
    missing = {k: v / scale * total for k, v in goal.items()}
    large, placed = LARGE * total, []
    for r in sorted(size.where(F.col("n") > large).collect(), key=lambda r: (-r.n, r.component)):  # at most 1 / LARGE rows
        k = max(sorted(missing), key=missing.get)
        missing[k] -= r.n
        placed.append((r.component, k))
    bucket = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "component"), 52).cast("int")
    histogram = size.where(F.col("n") <= large).groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).orderBy("bucket").collect()  # at most BUCKETS rows
    discard(size)
    rest = {k: max(v, 0.0) for k, v in missing.items()}
    scale = sum(rest.values()) or 1.0
    small = sum(r.n for r in histogram)
    names = sorted(rest)
    ends = [sum(rest[x] for x in names[: i + 1]) / scale * small for i in range(len(names))]
    cuts, upto = [], 0
    for r in histogram:
        middle = upto + r.n / 2
        cuts.append((r.bucket, next((k for k, e in zip(names, ends) if middle <= e and rest[k]), names[-1])))
        upto += r.n
    by_bucket = spark.createDataFrame(cuts, "bucket int, by_hash string")
    by_size = spark.createDataFrame(placed, "component long, by_size string")
    out = rec.withColumn("bucket", bucket).join(F.broadcast(by_bucket), "bucket", "left").join(F.broadcast(by_size), "component", "left")
    return out.select("sample_id", "component", F.coalesce("by_size", "by_hash").alias("new_split"))


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows, share and whether the tolerance is met, of each wanted split."""
    n = assigned.groupBy(F.col("new_split").alias("split_name")).agg(F.count("*").alias("n_rows"))
    total = assigned.agg(F.count("*").alias("total"))
    share = F.try_divide(F.coalesce("n_rows", F.lit(0)), F.col("total"))  # null if there are no records
    return targets.join(n, "split_name", "left").join(F.broadcast(total)).select("split_name", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.round(share, 6).alias("share"), (F.abs(share - F.col("target_share")) <= F.col("tolerance")).alias("met"))
