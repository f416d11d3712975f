"""Problem 2: a sample whose category shares follow given targets.

Records are grouped by signature (corpus and category). The work is done on the counts
of signatures, of which there are no more than target rows: a random start that meets
the floors is repaired by swaps, each of which moves as many records as help from the
signature most above its target to the one most below, until no swap lowers the total
deviation. The counts are then drawn from the records: each has a random number fixed
by seed and id, and a signature gets those with the smallest ones. Their cut-off comes
from histograms, so no signature, however large, is sorted in one task.

The floors come first: they may push other signatures below their targets, and floors
that exceed the sample together are lowered in proportion, so that no more than the wanted
rows are ever drawn. What stays short of the larger of target and floor is reported with
its cause, read off the repaired sample: ``records`` where all a signature has is drawn,
``room`` where it has more, but floors and the size of the sample leave no place.

Defined cases: an id counts once; records whose signature is not wanted are never
drawn; a signature with too few records gives all it has and is reported; if all
together are too few, the sample is smaller; an empty table gives an empty sample and
reports every target as unmet; null targets count as 0.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.llm import fields
from timbrel.session import written

SEED = 20240229
#: Bits of a pass of the search for a cut-off, passes at most, and rows among which the last place is found by sorting them.
BITS, LEVELS, MAX_SORTED = 12, 5, 100_000
#: Target rows that are brought to the driver; more than any label vocabulary has.
MAX_TARGETS = 100_000


def signatures(samples: DataFrame) -> DataFrame:
    """``(sample_id, dataset_name, categorical_emotion)``, each id once."""
    s = samples.select(F.col("sample_id").cast("long").alias("sample_id"), fields.corpus().alias("dataset_name"), fields.category().alias("categorical_emotion"))
    return s.where("sample_id is not null and dataset_name is not null and categorical_emotion is not null").distinct()


def _floors(have: dict, floor: dict, total: int) -> dict:
    """The rows every signature gets at least: its floor as far as it has records, lowered in proportion if all exceed the sample."""
    held = {k: min(floor[k], have[k]) for k in have}
    whole = sum(held.values())
    if whole <= total:
        return held
    cut = {k: n * total // whole for k, n in held.items()}
    for k in sorted(held, key=lambda k: (-(held[k] * total % whole), k))[: total - sum(cut.values())]:
        cut[k] += 1
    return cut


def allocate(available: dict, target: dict, floor: dict, total: int, seed: int = SEED) -> dict:
    """Rows to draw of each signature: a random floor-satisfying start, then swaps to the least deviation."""
    rng = random.Random(seed)
    keys = sorted(target)
    have = {k: available.get(k, 0) for k in keys}
    count = _floors(have, floor, total)
    least = dict(count)
    room = {k: have[k] - count[k] for k in keys}
    left = min(total, sum(have.values())) - sum(count.values())
    while left > 0:  # a random filling, weighted by what is left of each signature
        open_ = [k for k in keys if room[k]]
        k = rng.choices(open_, [room[x] for x in open_])[0]
        n = min(room[k], left, max(1, left // (4 * len(open_))))
        count[k] += n
        room[k] -= n
        left -= n
    while True:
        over = [k for k in keys if count[k] > max(target[k], least[k])]
        under = [k for k in keys if count[k] < min(target[k], have[k])]
        if not over or not under:
            return count
        a = max(over, key=lambda k: (count[k] - target[k], k))
        b = max(under, key=lambda k: (target[k] - count[k], k))
        n = min(count[a] - max(target[a], least[a]), min(target[b], have[b]) - count[b])
        count[a] -= n
        count[b] += n


def unmet(drawn: dict, available: dict, target: dict, floor: dict, total: int) -> dict:
    """``(short, cause)`` of each signature that the repaired sample leaves short of the larger of target and floor.

    A signature that is drawn whole lacks ``records``. In a full sample one may be short with records
    left: floors took its ``room``; it lacks records too if all it has would not do.
    """
    full = bool(drawn) and sum(drawn.values()) == total
    out = {}
    for k, n in drawn.items():
        want, have = max(target[k], floor[k]), available.get(k, 0)
        if n < want:
            out[k] = (want - n, "records" if n == have or full and have < want else "room")
    return out


def _targets(targets: DataFrame) -> list:
    rows = targets.where("dataset_name is not null and categorical_emotion is not null").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target rows")
    return rows


def plan(samples: DataFrame, targets: DataFrame, seed: int = SEED) -> list[tuple]:
    """``(dataset_name, categorical_emotion, target_rows, min_rows, available, drawn, short, cause)`` of each target row."""
    rows = _targets(targets)
    total = max([r.sample_rows or 0 for r in rows], default=0)
    target = {(r.dataset_name, r.categorical_emotion): round((r.target_share or 0) * total) for r in rows}
    floor = {(r.dataset_name, r.categorical_emotion): r.min_rows or 0 for r in rows}
    counts = signatures(samples).groupBy("dataset_name", "categorical_emotion").count()
    have = {(r[0], r[1]): r[2] for r in counts.collect()}  # one row per signature of the fixed vocabularies
    drawn = allocate(have, target, floor, total, seed)
    short = unmet(drawn, have, target, floor, total)
    return [(*k, target[k], floor[k], have.get(k, 0), drawn[k], *short.get(k, (0, None))) for k in target]


PLAN = "dataset_name string, categorical_emotion string, target_rows long, min_rows long, available long, drawn long, short long, cause string"


def report(samples: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """The plan as a table: ``short`` rows are missing from the sample of what target or floor ask for, by ``cause``."""
    return samples.sparkSession.createDataFrame(plan(samples, targets, seed), PLAN)


def draw(samples: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """``(sample_id, dataset_name, categorical_emotion)`` of the sample."""
    keys = ["dataset_name", "categorical_emotion"]
    plan_ = plan(samples, targets, seed)
    quota = samples.sparkSession.createDataFrame([(r[0], r[1], r[5]) for r in plan_], "dataset_name string, categorical_emotion string, drawn long")
    ranked = signatures(samples).join(F.broadcast(quota.where("drawn > 0")), keys).withColumn("u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "sample_id"), 4))
    ranked = written(ranked, "ranked")
    # the cut-off of each signature, twelve bits at a time: prefixes below ``p`` are drawn whole, ``open`` rows with it
    kind = "dataset_name string, categorical_emotion string, p long, open long"
    cuts = ranked.sparkSession.createDataFrame([(r[0], r[1], 0, r[5]) for r in plan_ if r[5]], kind)
    for level in range(1, LEVELS + 1):
        left = BITS * (LEVELS - level)
        inside = ranked.join(F.broadcast(cuts), keys).where(F.shiftright("u", left + BITS) == F.col("p"))
        histogram = inside.groupBy(*keys, "open", F.shiftright("u", left).alias("p")).agg(F.count("*").alias("n"))
        upto = histogram.selectExpr("*", "sum(n) over (partition by dataset_name, categorical_emotion order by p) as upto")
        met = upto.where("upto >= open and upto - n < open").select(*keys, "p", (F.col("open") - F.col("upto") + F.col("n")).alias("open"), "n").collect()  # one row per signature
        cuts = ranked.sparkSession.createDataFrame([tuple(r)[:4] for r in met], kind)
        if max((r.n for r in met), default=0) <= MAX_SORTED:
            break
    held = ranked.join(F.broadcast(cuts), keys).withColumn("own", F.shiftright("u", left)).where("own <= p")
    whole = held.where("own < p").select("sample_id", *keys)
    rest = held.where("own = p").selectExpr("*", "row_number() over (partition by dataset_name, categorical_emotion order by u, sample_id) as r")
    return whole.union(rest.where("r <= open").select("sample_id", *keys))
