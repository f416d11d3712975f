"""Problem 10: long exact spans shared between records, by recompression.

A text becomes a sequence of symbols. Rounds then name runs of equal symbols and pairs
of unlike ones: a name is a hash of what it stands for, so it is the same in every
record without any exchange, and whether two neighbours are paired depends on the two
alone. Hence equal substrings get equal symbols inside, whatever surrounds them; only
the outermost symbol at either end may differ in each round. A symbol of ``MATURE`` or
more characters takes no further part, which bounds what is lost at the ends.

The symbols left at the end are joined to chains of at least ``CHAIN`` characters. A
shared span of ``min_chars`` characters of ordinary text holds at least one whole chain.
How a long run of one character is cut depends on its whole length, so a span that holds
``MATURE`` or more equal characters in a row may lose its chains; windows around such runs
also give the least of their ``CHAIN``-character hashes, which two texts that share the
window have in common. Chains are grouped by name; those of one
record only, nearly all, are dropped after a map-side count. Groups of up to
``MAX_GROUP`` texts give candidate pairs. A larger group is not paired: its texts are
hashed anew at every window of ``min_chars`` characters over the chain, and windows are
grouped instead. Where pairs are wanted each pair of such a group is a result; where only the shared part of
each text is, a group's texts are compared with its first one alone, as that one holds the same
window. All candidates are verified on the texts.

Equal texts are one class from the start, told apart by a second hash where their class ids fall together, and
are expanded again at the end.

Defined cases: null and short texts share nothing; a repeated id counts as one record
with all its texts; a span counts by code points, whatever they are (blanks and runs of
one character too); an empty table gives an empty result; whole texts are processed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.llm.words import mix
from timbrel.operators.skew import hot_join, salted_join
from timbrel.session import bounded, discard, written

MIN_CHARS = 400
MATURE = 20
ROUNDS = 24
CHAIN = 220
MAX_GROUP = 16
#: Rows of eight or sixteen bytes that may be broadcast; larger tables meet by a shuffle.
MAX_BROADCAST = 2_000_000
#: A text in more pairs than this is sent to several tasks, each with part of its pairs.
MANY = 5_000
#: Characters named at once; a longer text is one piece of its own.
PIECE = 2_000_000

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, _STEP, _U))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each starts."""
    joined = "".join(texts)
    starts = np.cumsum([0, *map(len, texts)])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), starts


def _tokens(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First symbols: names and start offsets.

    A symbol is a run of non-blanks with the blanks after it; where that is as long as
    a mature symbol, its characters are symbols of their own.
    """
    n = len(codes)
    blank = (codes == 32) | (codes == 10)
    head = np.zeros(n + 1, bool)
    head[1:n] = blank[:-1] & ~blank[1:]
    head[starts] = True  # also the end, at n
    at = np.flatnonzero(head)
    size = np.diff(at)
    long = np.flatnonzero(size >= MATURE)
    if len(long):
        for i in long.tolist():
            head[at[i] : at[i + 1]] = True
        at = np.flatnonzero(head)
        size = np.diff(at)
    at = at[:-1]
    inside = np.arange(n) - np.repeat(at, size)
    name = mix(codes.astype(_U) + _U(1)) * _POWERS[inside]
    return mix(np.add.reduceat(name, at)) if n else name, at


def symbols(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and start offsets of the symbols after all rounds."""
    name, at = _tokens(codes, starts)
    n = len(codes)
    first = np.zeros(n + 1, bool)
    first[starts] = True
    for r in range(ROUNDS):
        if len(name) < 2:
            break
        size = np.diff(at, append=n)
        young = size < MATURE
        joint = young[:-1] & young[1:] & ~first[at[1:]]
        if not joint.any():
            break
        # runs: equal neighbours become blocks, as many to a block as make it mature; a run of
        # two blocks or more has one at each end, so a run cut off at one end keeps the other
        same = joint & (name[:-1] == name[1:])
        if same.any():
            lead = np.ones(len(name), bool)
            lead[1:] = ~same
            run = np.flatnonzero(lead)
            count = np.diff(run, append=len(name))
            rank = np.arange(len(name)) - np.repeat(run, count)
            block = -(-MATURE // size)
            tail = np.repeat(count, count) - block
            keep = np.flatnonzero((rank == 0) | (tail >= block) & ((rank % block == 0) & (rank <= tail) | (rank == tail)))
            held = np.diff(keep, append=len(name))
            name = np.where(held > 1, mix(name[keep] * _STEP + held.astype(_U)), name[keep])
            at = at[keep]
            size = np.diff(at, append=n)
            young = size < MATURE
            joint = young[:-1] & young[1:] & ~first[at[1:]]
        # pairs: a symbol of the one half of the alphabet and one of the other half after it
        side = (mix(name + _U(2 * r + 1)) >> _U(63)).astype(bool)
        pair = joint & ~side[:-1] & side[1:] & (name[:-1] != name[1:])
        left = np.flatnonzero(pair)
        if len(left):
            name[left] = mix(name[left] * _STEP + mix(name[left + 1]))
            keep = np.ones(len(name), bool)
            keep[left + 1] = False
            name, at = name[keep], at[keep]
    return name, at


def chains(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, start and end offsets of the shortest chains of at least ``CHAIN`` characters from each symbol."""
    name, at = symbols(codes, starts)
    if not len(name):
        return name, at, at
    n = len(codes)
    end = np.append(at[1:], n)
    limit = starts[np.searchsorted(starts, at, "right")]  # the end of the text
    last = np.searchsorted(end, at + CHAIN)  # first symbol that ends at CHAIN characters or later
    fits = np.flatnonzero(at + CHAIN <= limit)
    last = last[fits]
    count = last - fits + 1
    h = np.zeros(len(fits), _U)
    for k in range(int(count.max(initial=0))):
        more = k < count
        h[more] = h[more] * _STEP + name[fits[more] + k]
    key, lo, hi = mix(h + count.astype(_U)), at[fits], end[last]
    more_key, more_at = _run_windows(codes, starts)
    return np.concatenate([key, more_key]), np.concatenate([lo, more_at]), np.concatenate([hi, more_at + CHAIN])


def _run_windows(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least hashes of ``CHAIN`` characters, and their offsets, of all windows of ``MIN_CHARS`` that hold a run of ``MATURE`` equal characters."""
    keys, places = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    edge = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1], [True]])) if len(codes) else np.zeros(1, np.int64)
    runs = np.flatnonzero(np.diff(edge) >= MATURE)
    for text in np.unique(np.concatenate([np.searchsorted(starts, edge[runs], "right") - 1, np.searchsorted(starts, edge[runs + 1] - 1, "right") - 1])).tolist():
        own = codes[starts[text] : starts[text + 1]]
        windows = len(own) - MIN_CHARS + 1
        if windows < 1:
            continue
        equal = np.concatenate([[0], np.cumsum(own[1:] == own[:-1])])
        full = np.flatnonzero(equal[MATURE - 1 :] - equal[: len(own) - MATURE + 1] == MATURE - 1)  # where MATURE equal characters start
        held = np.zeros(len(own) + 1, np.int64)
        np.add.at(held, np.maximum(full - (MIN_CHARS - MATURE), 0), 1)
        np.add.at(held, full + 1, -1)
        wanted = np.flatnonzero(np.cumsum(held)[:windows])
        if not len(wanted):
            continue
        h = _windows(own, 0, len(own), CHAIN)
        view = np.lib.stride_tricks.sliding_window_view(h, MIN_CHARS - CHAIN + 1)
        least = np.unique(np.concatenate([wanted[i : i + 4096] + view[wanted[i : i + 4096]].argmin(axis=1) for i in range(0, len(wanted), 4096)]))
        keys.append(mix(h[least] + _U(1)))
        places.append(least + starts[text])
    return np.concatenate(keys), np.concatenate(places)


def _pieces(texts: list[str]) -> Iterator[slice]:
    """Consecutive texts of about ``PIECE`` characters."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for b in batches:
        fresh = []
        for i, c in enumerate(b.column(0).to_pylist()):
            if c not in seen:
                seen.add(c)
                fresh.append(i)
        if len(seen) > 1_000_000:
            seen.clear()
        b = b.take(pa.array(fresh, pa.int64()))
        texts, classes = b.column(1).to_pylist(), b.column(0).to_numpy()
        for part in _pieces(texts):
            codes, starts = _codes(texts[part])
            key, at, _ = chains(codes, starts)
            own = classes[part][np.searchsorted(starts, at, "right") - 1]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own)], names=["chain", "cls"])


def _windows(codes: np.ndarray, lo: int, hi: int, size: int) -> np.ndarray:
    """Hashes of the windows of ``size`` code points that start from ``lo`` to ``hi``."""
    hi = min(hi, len(codes) - size)
    if hi < lo:
        return np.zeros(0, _U)
    part = mix(codes[lo : hi + size].astype(_U) + _U(1))
    powers = np.cumprod(np.full(len(part), _STEP, _U))
    total = np.concatenate([np.zeros(1, _U), np.cumsum(part * powers)])
    # a window's sum is brought to the same power by the inverse of the step
    inverse = np.cumprod(np.full(hi - lo + 1, _U(pow(int(_STEP), -1, 1 << 64)), _U))
    return mix((total[size:] - total[:-size]) * inverse)


def _shared_intervals(a: np.ndarray, b: np.ndarray, size: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Maximal intervals of ``a`` and of ``b`` covered by windows of ``size`` that stand in the other."""
    ha, hb = _windows(a, 0, len(a), size), _windows(b, 0, len(b), size)
    out = []
    for codes, own, other, there in ((a, ha, hb, b), (b, hb, ha, a)):
        at = np.flatnonzero(np.isin(own, other))
        cuts = np.flatnonzero(np.diff(at) > size)
        runs = np.split(at, cuts + 1) if len(at) else []
        out.append([(int(r[0]), int(r[-1]) + size) for r in runs])
    return out[0], out[1]


def _classes(docs: DataFrame, min_chars: int) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.where(F.length(text) >= min_chars).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("cls"), text.alias("text")).where("doc_id is not null")


def candidate_pairs(texts: DataFrame, min_chars: int = MIN_CHARS, max_group: int = MAX_GROUP, every: bool = True) -> DataFrame:
    """``(cls_a, cls_b)`` with ``cls_a < cls_b``: pairs of text classes that share a chain, each once; of large groups without ``every`` those with the first class."""
    occ = written(texts.select("cls", "text").mapInArrow(_occurrences, "chain long, cls long"), "chains")
    groups = occ.groupBy("chain").agg(F.count("*").alias("n"), F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi")
    groups = written(groups, "groups")
    keys = groups.where("n > 2").select("chain")
    shared = occ.join(bounded(keys, MAX_BROADCAST), "chain")
    two = groups.where("n = 2").select(F.col("lo").alias("cls_a"), F.col("hi").alias("cls_b"))
    large = groups.where(f"n > {max_group}").select("chain")
    hot = not large.isEmpty()
    some = shared.join(bounded(large, MAX_BROADCAST), "chain", "left_anti") if hot else shared
    few = _within(some.groupBy("chain").agg(F.array_sort(F.collect_set("cls")).alias("all")))
    out = two.union(few)
    if hot:
        out = out.union(_large_groups(texts, shared.join(bounded(large, MAX_BROADCAST), "chain").distinct(), min_chars, every))
    pairs = written(out.distinct(), "pairs")
    discard(occ)
    discard(groups)
    return pairs


def _within(groups: DataFrame) -> DataFrame:
    """All pairs of each group's sorted array ``all``; for groups of bounded size, or whose pairs are the result."""
    left = groups.select("all", F.posexplode("all").alias("i", "cls_a"))
    return left.select("cls_a", F.explode(F.expr("slice(all, i + 2, size(all))")).alias("cls_b"))


def _large_groups(texts: DataFrame, hot: DataFrame, min_chars: int, every: bool) -> DataFrame:
    """Pairs of large groups, over hashes of whole windows around the chain: all, or each class with the window's first one."""
    wanted = hot.groupBy("cls").agg(F.collect_set("chain").alias("chains"))  # bounded by the text's own chains

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cls, text, names in zip(*(b.column(k).to_pylist() for k in range(3))):
                codes, starts = _codes([text])
                key, at, end = chains(codes, starts)
                hit = np.isin(key, np.array(names, np.int64).view(_U))
                parts = [_windows(codes, max(0, e - min_chars), a, min_chars) for a, e in zip(at[hit].tolist(), end[hit].tolist())]
                h = np.unique(np.concatenate(parts)) if parts else np.zeros(0, _U)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), cls, np.int64))], names=["win", "cls"])

    own = texts.select("cls", "text").join(wanted, "cls").dropDuplicates(["cls"]).select("cls", "text", "chains")
    win = written(own.mapInArrow(run, "win long, cls long"), "windows")
    shared = written(win.groupBy("win").agg(F.count("*").alias("rows"), F.min("cls").alias("lo")).where("rows > 1"), "shared")
    # texts with the same set of shared windows form the same pairs: one window of each set is kept
    linked = hot_join(win, shared, ["win"])
    signature = linked.groupBy("win", "rows", "lo").agg(F.bit_xor(F.xxhash64("cls")).alias("sig"))
    kept = written(signature.groupBy("rows", "sig").agg(F.min("win").alias("win"), F.min("lo").alias("lo")).select("win", "rows", "lo"), "kept")
    held = hot_join(win, kept, ["win"])
    if not every:
        return held.where("cls > lo").select(F.col("lo").alias("cls_a"), F.col("cls").alias("cls_b"))
    held = written(held, "linked")
    pairs = salted_join(held.select("win", F.col("cls").alias("cls_a")), held.select("win", F.col("cls").alias("cls_b")), kept, ["win"])
    return pairs.where("cls_a < cls_b").select("cls_a", "cls_b")


def class_spans(texts: DataFrame, pairs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(cls_a, cls_b, spans_a, spans_b)`` of the candidate pairs that do share a span; spans as ``[start, end)``."""
    # only texts in some pair are moved; the pairs of a text in many of them stay where they are
    per = pairs.groupBy(F.col("cls_a").alias("cls")).agg(F.count("*").alias("rows"), F.lit(0).alias("second")).union(pairs.groupBy("cls_b").agg(F.lit(0), F.count("*")))
    used = written(per.groupBy("cls").agg(F.sum("rows").alias("rows"), F.sum("second").alias("second")), "used")
    one = written(texts.select("cls", "text").join(bounded(used, MAX_BROADCAST), "cls").dropDuplicates(["cls"]), "texts")
    a = one.where("rows > 0").select(F.col("cls").alias("cls_a"), F.col("text").alias("text_a"))
    b = one.where("second > 0").select(F.col("cls").alias("cls_b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out = []
            for ca, cb, ta, tb in zip(*(batch.column(k).to_pylist() for k in range(4))):
                sa, sb = _shared_intervals(_codes([ta])[0], _codes([tb])[0], min_chars)
                if sa:
                    dicts = ([{"start": x, "end": y} for x, y in s] for s in (sa, sb))
                    out.append((ca, cb, *dicts))
            cols = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), span, span))]
            yield pa.RecordBatch.from_arrays(cols, names=["cls_a", "cls_b", "spans_a", "spans_b"])

    kind = "array<struct<start:int,end:int>>"
    first = salted_join(pairs, a, used.select(F.col("cls").alias("cls_a"), "rows"), ["cls_a"], least=MANY)
    both = salted_join(first, b, used.select(F.col("cls").alias("cls_b"), F.col("second").alias("rows")), ["cls_b"], least=MANY).select("cls_a", "cls_b", "text_a", "text_b")
    return both.mapInArrow(run, f"cls_a long, cls_b long, spans_a {kind}, spans_b {kind}")


def shared_spans(docs: DataFrame, min_chars: int = MIN_CHARS, max_group: int = MAX_GROUP, every: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(members, spans)``: ``(doc_id, cls, tag, n_chars)`` of all long texts, and :func:`class_spans` of their classes."""
    if min_chars < MIN_CHARS:
        raise ValueError(f"chains are laid out for spans of at least {MIN_CHARS} characters")
    texts = _classes(docs, min_chars)
    members = texts.select("doc_id", "cls", F.xxhash64(F.lit("tag"), "text").alias("tag"), F.length("text").alias("n_chars")).distinct()
    return members, class_spans(texts, candidate_pairs(texts, min_chars, max_group, every), min_chars)


def document_pairs(docs: DataFrame, min_chars: int = MIN_CHARS, max_group: int = MAX_GROUP) -> DataFrame:
    """``(doc_id_a, doc_id_b)`` of all documents that share a span, equal texts included."""
    members, spans = shared_spans(docs, min_chars, max_group)
    one = members.select(F.col("doc_id").alias("x"), F.col("cls").alias("cls_a"))
    two = members.select(F.col("doc_id").alias("y"), F.col("cls").alias("cls_b"))
    unlike = spans.select("cls_a", "cls_b").join(one, "cls_a").join(two, "cls_b").select("x", "y")
    keys = ["cls", "tag"]
    copies = written(members.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1"), "copies")
    held = written(hot_join(members, copies, keys).select(*keys, "doc_id"), "copied")
    alike = salted_join(held.withColumnRenamed("doc_id", "x"), held.withColumnRenamed("doc_id", "y"), copies, keys).where("x < y").select("x", "y")
    return unlike.union(alike).where("x <> y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def shared_share(docs: DataFrame, min_chars: int = MIN_CHARS, max_group: int = MAX_GROUP) -> DataFrame:
    """``(doc_id, cls, n_copies, n_chars, shared_chars)`` of documents that share spans.

    ``cls`` is the class of equal texts and ``n_copies`` its other documents; ``shared_chars`` are the
    code points in some shared span. A text that another document copies whole is shared whole.
    No pairs of large groups are formed.
    """
    members, spans = shared_spans(docs, min_chars, max_group, every=False)
    sided = spans.select(F.col("cls_a").alias("cls"), F.col("spans_a").alias("spans")).union(spans.select("cls_b", "spans_b"))
    # interval ends as +1/-1 events; covered length by a running sum in one pass per class
    events = sided.select("cls", F.explode("spans").alias("s")).select(
        "cls", F.explode(F.array(F.struct(F.col("s.start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("s.end").alias("at"), F.lit(-1).alias("d")))).alias("e")
    )
    events = events.groupBy("cls", "e.at").agg(F.sum("e.d").alias("d"))
    depth = events.selectExpr(
        "cls", "at", "sum(d) over (partition by cls order by at) as depth", "lead(at) over (partition by cls order by at) as next"
    )
    covered = depth.where("depth > 0").groupBy("cls").agg(F.sum(F.col("next") - F.col("at")).alias("covered"))
    size = members.groupBy("cls", "tag").agg(F.count("*").alias("rows"))
    held = written(size.join(covered, "cls", "left").where("rows > 1 or covered is not null"), "covered")
    copies = F.col("rows") - 1
    shared = F.when(copies > 0, F.col("n_chars")).otherwise(F.col("covered")).cast("long")
    return hot_join(members, held, ["cls", "tag"]).select("doc_id", "cls", copies.alias("n_copies"), F.col("n_chars").cast("long").alias("n_chars"), shared.alias("shared_chars"))
