"""Problem 9: passages of held-out items inside corpus documents.

Size-partitioned MinHash containment search. A leaked passage is any ``min_words`` successive
words. A document that holds one holds all five-word shingles in it, so the containment of
these is 1, whatever the document's length, and so is that of any part of them. A part
that several neighbouring passages of the item have in common, a core, therefore stands for all of
them: its MinHash signature, the least values under several hash functions, must be in the
document as a whole, in places no farther apart than the core is long.

Items are partitioned by size, and the class of an item decides on its signatures. The shortest
items are one core each: all their passages overlap. In larger ones a core covers fewer passages and
is longer, and it takes more hash functions, as more cores mean more chance hits. Shingles of
documents are looked up among the first values of all classes; at a hit the other values of
that core are compared near the place. Recall is 1, and what remains is
verified by exact containment of the ``min_words``-word shingles.

The first values are broadcast while they are at most ``MAX_BROADCAST``. Beyond it they are
broadcast as a sieve of fixed size, and only shingles that pass it meet them in a shuffle, those
of hot values where they are.

Defined cases: null, empty and blank texts and items hold nothing; items with fewer
than ``min_words`` words never count; a repeated document or item id comes out once
per pair of ids, with the most shared shingles of any of its rows; empty tables give
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbrel.llm.words import WordIds, grams, mix, words
from timbrel.operators.skew import hot_join, salted_join
from timbrel.session import written

SHINGLE = 5
MIN_WORDS = 12
#: Signatures and characters of item texts that may be broadcast (a few tens of MB at most).
MAX_BROADCAST = 500_000
MAX_BROADCAST_CHARS = 20_000_000
#: Bits of the sieve by which shingles are left out of a shuffle; 8 MB, whatever the number of items.
SIEVE_BITS = 26
#: Size classes of items: passages from which on, passages to a core (all of the item's where None), and hash functions.
CLASSES = ((1, None, 1), (6, 5, 2), (65, 4, 3))

FOUND = "doc_id long, item_id long, shared long, item_windows long"


def size_class(passages: int) -> int:
    return max(i for i, (least, _, _) in enumerate(CLASSES) if passages >= least)


def _hashes(h: np.ndarray, n: int) -> list[np.ndarray]:
    """``n`` hash functions of shingles; the first is the shingle's own."""
    return [h, *(mix(h ^ mix(np.full(1, i, np.uint64))) for i in range(1, n))]


def core_signatures(ids: np.ndarray, min_words: int = MIN_WORDS, shingle: int = SHINGLE) -> tuple[int, np.ndarray, int]:
    """Size class of an item, and a signature for each core: the shingles that are least under its class' hash functions; and the core's length."""
    h = grams(ids, shingle)
    span = min_words - shingle + 1  # shingles of a passage
    passages = len(h) - span + 1
    if passages < 1:
        return 0, np.zeros((0, 1), np.uint64), 0
    own = size_class(passages)
    _, many, functions = CLASSES[own]
    many = many or passages
    length = max(span - many + 1, 1)
    first = np.minimum(np.arange(0, passages, many), passages - many) + many - 1  # where the cores of passages many at a time start
    cores = np.lib.stride_tricks.sliding_window_view(h, length)[first]
    rows = np.arange(len(cores))
    return own, np.stack([cores[rows, np.lib.stride_tricks.sliding_window_view(x, length)[first].argmin(axis=1)] for x in _hashes(h, functions)], axis=1), length


SKETCH = "item_id long, size_class int, length int, sig long, rest array<long>"


def sketches(items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per distinct core signature of an item: size class, length of the core, first value and the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for b in batches:
            out = set()
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own, sig, length = core_signatures(ids(words(text)), min_words)
                out.update((key, own, length, *map(int, row)) for row in sig.view(np.int64))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
            cols = [pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([list(x[4:]) for x in out], pa.list_(pa.int64()))], names=["item_id", "size_class", "length", "sig", "rest"])

    return items.select("item_id", "item_text").mapInArrow(run, SKETCH)


def _near(h: np.ndarray, at: int, rest: list[int] | np.ndarray, length: int) -> bool:
    """Whether the other values of a signature stand less than a core's length from the place of the first."""
    around = h[max(0, at - length + 1) : at + length]
    return all((around == r).any() for r in rest)


def _shared(doc: list[str], items: dict[int, list[list[str]]], min_words: int) -> dict[int, tuple[int, int]]:
    """For each item its most distinct windows that stand in ``doc``, and how many it has."""
    held = {tuple(doc[i : i + min_words]) for i in range(len(doc) - min_words + 1)}
    out = {}
    for item, versions in items.items():
        best = (0, 0)
        for w in versions:
            own = {tuple(w[i : i + min_words]) for i in range(len(w) - min_words + 1)}
            best = max(best, (len(own & held), len(own)))
        if best[0]:
            out[item] = best
    return out


def find_leaks(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``(doc_id, item_id, shared, item_windows)`` of every document and item that share a passage.

    ``shared`` counts the item's distinct windows of ``min_words`` words that stand in
    the document, so ``shared / item_windows`` is the exact containment.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("item_text").cast("string").alias("item_text"))
    sigs = sketches(items, min_words)
    some = sigs.limit(max_broadcast + 1).toArrow()
    small = items.agg(F.count("*").alias("n"), F.sum(F.length("item_text")).alias("chars")).first()
    if some.num_rows > max_broadcast or small.n > max_broadcast or (small.chars or 0) > MAX_BROADCAST_CHARS:
        found = _by_shuffle(docs, items, sigs, min_words)
    else:
        held = set(some["item_id"].to_pylist())
        texts = items.select("item_id", "item_text").toArrow()
        pairs = [(i, t) for i, t in zip(texts["item_id"].to_pylist(), texts["item_text"].to_pylist()) if i in held]
        found = _by_broadcast(docs, pairs, [tuple(x.values()) for x in some.to_pylist()], min_words)
    return found.groupBy("doc_id", "item_id").agg(F.max("shared").alias("shared"), F.max("item_windows").alias("item_windows"))


def _hits(texts: list[str], ids: WordIds, passes) -> Iterator[tuple[int, list[str], np.ndarray, int]]:
    """``(row, words, shingles, place)`` wherever a shingle of a text passes; ``passes`` takes all shingles at once."""
    split = [words(x) for x in texts]
    starts = np.cumsum([0, *map(len, split)])
    flat: list[str] = []
    for w in split:
        flat += w
    h = grams(ids(flat), SHINGLE)  # those over a text's end match by chance at most; hits are verified
    at = passes(h)
    for row, place in zip((np.searchsorted(starts, at, "right") - 1).tolist(), at.tolist()):
        yield row, split[row], h, place


def _by_broadcast(docs: DataFrame, texts: list[tuple[int, str]], sigs: list[tuple], min_words: int) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((texts, sigs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, sigs = shared.value
        owners: dict[int, list[tuple]] = defaultdict(list)
        for item, _, length, sig, rest in sigs:
            owners[sig & 0xFFFFFFFFFFFFFFFF].append((item, length, np.array(rest, np.int64).view(np.uint64)))
        first = np.array(sorted(owners), np.uint64)
        sieve = np.zeros(1 << 20, bool)
        sieve[(first & np.uint64(0xFFFFF)).astype(np.int64)] = True
        item_words: dict[int, list[list[str]]] = defaultdict(list)
        for i, t in texts:
            item_words[i].append(words(t))

        def passes(h):
            at = np.flatnonzero(sieve[(h & np.uint64(0xFFFFF)).astype(np.int64)])
            return at[np.isin(h[at], first)]

        ids = WordIds()
        for b in batches:
            out, near, said = [], defaultdict(set), {}
            keys = b.column(0).to_pylist()
            for row, w, h, at in _hits(b.column(1).to_pylist(), ids, passes):
                said[row] = w
                near[row].update(item for item, length, rest in owners[int(h[at])] if item not in near[row] and _near(h, at, rest, length))
            for row, found in near.items():
                out += [(keys[row], i, n, of) for i, (n, of) in _shared(said[row], {i: item_words[i] for i in found}, min_words).items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], names=["doc_id", "item_id", "shared", "item_windows"])

    return docs.where("doc_id is not null and text is not null").mapInArrow(run, FOUND)


def _sieve_bit(bits: int) -> Column:
    return F.shiftrightunsigned("sig", 64 - bits)


def _sieve(sigs: DataFrame, bits: int) -> np.ndarray:
    """A bit for the leading bits of each first value; ``bits`` fix its size, however many values there are."""
    word = F.shiftright(_sieve_bit(bits), 3)
    byte = sigs.groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), _sieve_bit(bits).bitwiseAND(F.lit(7)).cast("int"))).cast("short").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 3), np.uint8)
    out[byte["w"].to_numpy()] = byte["b"].to_numpy()
    return out


def _by_shuffle(docs: DataFrame, items: DataFrame, sigs: DataFrame, min_words: int, bits: int = SIEVE_BITS) -> DataFrame:
    docs = docs.where("doc_id is not null and text is not null")
    sigs = written(sigs, "signatures")
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(sigs, bits))
    span = min_words - SHINGLE + 1

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passes(h):
            top = (h >> np.uint64(64 - bits)).astype(np.int64)
            return np.flatnonzero((sieve.value[top >> 3] >> (top & 7).astype(np.uint8)) & 1)

        ids = WordIds()
        for b in batches:
            keys, out = b.column(0).to_pylist(), []
            for row, _, h, at in _hits(b.column(1).to_pylist(), ids, passes):
                around = h[max(0, at - span + 1) : at + span].view(np.int64).tolist()
                out.append((keys[row], int(h[at : at + 1].view(np.int64)[0]), around, min(at, span - 1)))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["doc_id", "sig", "around", "middle"])

    hits = written(docs.mapInArrow(shingles, "doc_id long, sig long, around array<long>, middle int"), "shingles")
    counts = written(hits.groupBy("sig").agg(F.count("*").alias("rows")), "counts")
    met = salted_join(hits, sigs.select("sig", "item_id", "length", "rest"), counts, ["sig"])
    inside = F.slice("around", F.greatest(F.col("middle") - F.col("length") + 2, F.lit(1)), F.least(F.col("middle"), F.col("length") - 1) + F.col("length"))
    pairs = written(met.where(F.size(F.array_except("rest", inside)) == 0).select("doc_id", "item_id").distinct(), "candidates")
    per_item = pairs.groupBy("item_id").agg(F.count("*").alias("rows")).join(items, "item_id")
    per_doc = pairs.groupBy("doc_id").agg(F.count("*").alias("rows")).join(docs, "doc_id")
    with_items = hot_join(pairs, written(per_item, "items"), ["item_id"]).drop("rows")
    both = hot_join(written(with_items, "with-items"), written(per_doc, "docs"), ["doc_id"]).select("doc_id", "text", "item_id", "item_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, text, i, item in zip(*(b.column(k).to_pylist() for k in range(4))):
                out += [(d, i, n, of) for n, of in _shared(words(text), {i: [words(item)]}, min_words).values()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], names=["doc_id", "item_id", "shared", "item_windows"])

    return both.mapInArrow(run, FOUND)


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per item of at least one leak: documents that hold it, and its highest containment."""
    name = items.select("item_id", "dataset_name", "eval_split").dropDuplicates(["item_id"])
    return (
        found.groupBy("item_id")
        .agg(F.count("*").alias("n_docs"), F.max(F.col("shared") / F.col("item_windows")).alias("max_containment"))
        .join(name, "item_id")
        .select("item_id", "dataset_name", "eval_split", "n_docs", F.round("max_containment", 6).alias("max_containment"))
    )
