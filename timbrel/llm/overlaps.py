"""Problem 3: records of held-out splits that stand, exactly or almost, in training.

Two rules: the same audio file name within a corpus, or transcripts of at least
``MIN_WORDS`` words of which one becomes the other by at most one word edit for every six
words of the longer one.

Equal transcripts are one class from the start. For unequal ones, the word n-gram hashes of the
held-out classes are laid out first, and training is scanned for hits: sieves of them, bounded in
size, are broadcast, and training n-grams that pass them meet held-out ones that pass sieves of those,
partitioned by hash. The longer of two similar texts has ``k + 1`` disjoint n-grams (``k`` edits allowed
at its length), of which one at least stands untouched in the shorter one, displaced by
``k`` words at most. So one side lays out ``k + 1`` disjoint n-grams, the other all of its
n-grams, in both directions, and no similar pair is lost. N-grams of more than ``1 / HOT`` of all places,
told apart by 44 bits of their hashes, are hot; at most ``HOT`` exist, and their list is broadcast. Disjoint n-grams are placed beside
hot ones wherever the text allows it; where it does not, the key of a hot one also holds
classes of length and place, so that its group splits. Pairs that meet are compared by an edit
distance over word codes in the JVM. Those that are left, few, are compared over the words themselves,
which are read again from their records, so that no text is stored or shuffled before. Every
intermediate table and shuffle is deleted as soon as nothing needs it.

Defined cases: null, empty and short transcripts match none; null and blank audio paths
match none; a record without a known split counts nowhere; repeated rows of one id are
one record; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbrel.llm import fields
from timbrel.llm.words import WordIds, grams, mix, words
from timbrel.operators.skew import hot_join, salted_join
from timbrel.session import bounded, discard, finished, release, written

MIN_WORDS = 10
EDIT_EVERY = 6
GRAM = 4
#: So many n-grams may be hot, 8 MB to broadcast; a cold one of 10^12 places has 10^6 at most.
HOT = 1_000_000
HOT_LEAST = 100
#: Bits of the largest sieve, 32 MB; there is one for each role. With more n-grams than bits it would let nearly all pass and is left out.
SIEVE_BITS = 28
#: Hashes travel in blocks of this many low bits, as short numbers without the bits that all of a block share.
BLOCK_BITS = 16
#: Hashes that a task gathers before it hands on their blocks.
GATHERED = 1 << 22
#: Classes whose words are read by a broadcast of their records; more meet the records by a shuffle.
MAX_BROADCAST = 1_000_000
#: Words up to which the layout of disjoint n-grams is optimised exactly.
EXACT_LAYOUT = 200
CONTAINMENT_GRAM = 5


def file_key(c: str = "audio_path") -> Column:
    """Last part of a path in lower case, without an audio extension; null if there is none."""
    name = F.regexp_replace(F.lower(F.regexp_extract(fields.outer(c), r"([^/\\]*)$", 1)), r"\.(wav|flac|mp3)$", "")
    return F.when(F.length(name) > 0, name)


def records(samples: DataFrame) -> DataFrame:
    """``(sample_id, corpus, split, side, file, transcript)`` of the records that have a known split."""
    split = fields.split()
    return samples.select(
        F.col("sample_id").cast("long").alias("sample_id"), fields.corpus().alias("corpus"), split.alias("split"),
        F.when(split == "train", 0).otherwise(1).alias("side"), file_key().alias("file"), F.col("transcript").cast("string").alias("transcript"),
    ).where("sample_id is not null and split is not null")


def _codes(flat: list[str], ids: WordIds) -> np.ndarray:
    """One code point above the basic plane for each word."""
    return ((ids(flat) >> np.uint64(7)) % np.uint64(0x100000)).astype(np.uint32) + np.uint32(0x10000)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class, word count and code string of each transcript that is long enough."""
    ids = WordIds()
    for b in batches:
        split = [words(x) for x in b.column(2).to_pylist()]
        at = [i for i, w in enumerate(split) if len(w) >= MIN_WORDS]
        split = [split[i] for i in at]
        text = _codes([x for w in split for x in w], ids).tobytes().decode("utf-32-le")
        ends = np.cumsum([0, *map(len, split)]).tolist()
        cls = _classes([" ".join(w) for w in split])
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(at, pa.int64())), b.column(1).take(pa.array(at, pa.int64())), pa.array(cls), pa.array(list(map(len, split)), pa.int32()), pa.array([text[i:j] for i, j in zip(ends, ends[1:])], pa.string())],
            names=["sample_id", "side", "cls", "n", "code"],
        )


def _classes(texts: list[str]) -> np.ndarray:
    """The class of each text, which is its hash."""
    return (WordIds()(texts) if texts else np.zeros(0, np.uint64)).view(np.int64)


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class and words of each transcript that is long enough."""
    for b in batches:
        texts = [" ".join(w) for w in map(words, b.column(0).to_pylist()) if len(w) >= MIN_WORDS]
        yield pa.RecordBatch.from_arrays([pa.array(_classes(texts)), pa.array(texts, pa.string())], names=["cls", "words"])


class Texts:
    """The n-grams of many code strings: hashes, and the text and place of each."""

    def __init__(self, codes: list[str]):
        self.n = np.fromiter(map(len, codes), np.int64, len(codes))
        self.starts = np.concatenate([[0], np.cumsum(self.n)])[:-1]
        flat = np.frombuffer("".join(codes).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.all = grams(flat, GRAM)  # also those over a text's end
        text = np.repeat(np.arange(len(codes)), self.n)
        place = np.arange(len(flat)) - self.starts[text]
        self.index = np.flatnonzero(place <= self.n[text] - GRAM)
        self.text, self.place, self.key = text[self.index], place[self.index], self.all[self.index]


def _gathered(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Arrays joined up to ``GATHERED`` numbers, so that blocks are not small."""
    held, size = [], 0
    for x in parts:
        held.append(x)
        size += len(x)
        if size >= GATHERED:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def _cut(values: np.ndarray, bits: int) -> tuple[np.ndarray, list[int]]:
    """The block of each run of sorted ``values`` that agree above their ``bits`` low bits, and where the runs begin and end."""
    block = (values >> np.uint64(bits)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    return block[starts], [*starts.tolist(), len(values)]


#: Bits of a hash by which n-grams are counted: 12 of the block and 32 within it.
_COUNTED, _WITHIN = np.uint64(64 - 44), 32


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of n-grams, by 44 bits of their hashes, and how often each occurs."""
    for keys in _gathered(Texts(b.column(0).to_pylist()).key >> _COUNTED for b in batches):
        keys, counts = np.unique(keys, return_counts=True)
        block, ends = _cut(keys, _WITHIN)
        low, counts = keys.astype(np.uint32), counts.astype(np.uint32)
        runs = list(zip(ends, ends[1:]))
        yield pa.RecordBatch.from_arrays([pa.array(block), pa.array([low[i:j].tobytes() for i, j in runs], pa.binary()), pa.array([counts[i:j].tobytes() for i, j in runs], pa.binary())], names=["block", "low", "n"])


def _frequent(limit: int):
    """Function that adds up blocks of :func:`_gram_counts` and gives the n-grams with more than ``limit`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[tuple[bytes, bytes]]] = {}
        for b in batches:
            for block, *x in zip(*(c.to_pylist() for c in b.columns)):
                blocks.setdefault(block, []).append(tuple(x))
        for block, parts in blocks.items():
            low, at = np.unique(np.frombuffer(b"".join(x[0] for x in parts), np.uint32), return_inverse=True)
            n = np.bincount(at, np.frombuffer(b"".join(x[1] for x in parts), np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array(low[n > limit].astype(np.int64) + (block << _WITHIN))], names=["key"])

    return run


def _disjoint(hot: np.ndarray, pieces: int) -> list[int]:
    """Starts of ``pieces`` disjoint n-grams with few hot ones; ``hot`` flags each place.

    The least number of hot ones, unless the text is long and has too few disjoint cold
    ones; then the even layout is kept, which is as valid.
    """
    n = len(hot) + GRAM - 1
    even = [n * i // pieces for i in range(pieces)]
    if not hot[even].any():
        return even
    cold, free = [], 0
    for i in np.flatnonzero(~hot).tolist():
        if i >= free:
            cold.append(i)
            free = i + GRAM
    if len(cold) >= pieces:
        return [cold[len(cold) * i // pieces] for i in range(pieces)]
    if n > EXACT_LAYOUT:
        return even
    best = [[0] * (n + 1)] + [[n + 1] * (n + 1) for _ in range(pieces)]
    for p in range(1, pieces + 1):
        row, up = best[p], best[p - 1]
        for end in range(p * GRAM, n + 1):
            row[end] = min(row[end - 1], up[end - GRAM] + int(hot[end - GRAM]))
    out, end = [], n
    for p in range(pieces, 0, -1):
        while best[p][end] == best[p][end - 1]:
            end -= 1
        out.append(end - GRAM)
        end -= GRAM
    return out[::-1]


def _width(n: np.ndarray) -> np.ndarray:
    """Width, as a power of two above its edits, of the length and place classes of hot n-grams for longer texts of ``n`` words."""
    return np.frexp((n // EDIT_EVERY + 1).astype(float))[1].astype(np.uint64)


def _placed(key: np.ndarray, width: np.ndarray, length: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys of hot n-grams by class of text length and place."""
    where = (length.astype(np.uint64) >> width) * np.uint64(1 << 24) + (at.astype(np.uint64) >> width)
    return mix(key ^ mix(where * np.uint64(64) + width))


def _once(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key of a text once."""
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    return text[fresh], key[fresh]


def _rows(texts: Texts, hot_keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """``(text, key, place, long)``: all n-grams of each text, and ``long`` the disjoint ones of it as the longer text.

    A hot n-gram's key holds its class of length and place and its row no place (-1).
    """
    n, key, text, place = texts.n, texts.key, texts.text, texts.place
    hot = np.zeros(len(key), bool)
    if len(hot_keys):
        seen = key >> _COUNTED
        hot = hot_keys[np.minimum(np.searchsorted(hot_keys, seen), len(hot_keys) - 1)] == seen
    out = [(text[~hot], key[~hot], place[~hot], False)]
    if hot.any():
        # the longer text has up to a fifth more words, so one of at most two widths
        m = n[text[hot]]
        widths = (_width(m), _width(m + m // (EDIT_EVERY - 1)))
        t, k = _once(np.tile(text[hot], 2), np.concatenate([_placed(key[hot], w, m, place[hot]) for w in widths]))
        out.append((t, k, np.full(len(k), -1), False))
    pieces = n // EDIT_EVERY + 1
    text = np.repeat(np.arange(len(n)), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    place = n[text] * nth // pieces[text]
    flags = np.zeros(len(texts.all) + GRAM, bool)
    flags[texts.index] = hot
    for t in np.unique(text[flags[texts.starts[text] + place]]).tolist():  # an even layout that meets a hot one
        i, j = texts.starts[t], texts.starts[t] + n[t] - GRAM + 1
        place[text == t] = _disjoint(flags[i:j], int(pieces[t]))
    at = texts.starts[text] + place
    hit = flags[at]
    out.append((text[~hit], texts.all[at[~hit]], place[~hit], True))
    if hit.any():
        text, place, key = text[hit], place[hit], texts.all[at[hit]]
        m = n[text]
        k, w = m // EDIT_EVERY, _width(m)
        keys = [_placed(key, w, size, np.maximum(place + d, 0)) for size in (m - k, m) for d in (-k, 0 * k, k)]
        t, k = _once(np.tile(text, len(keys)), np.concatenate(keys))
        out.append((t, k, np.full(len(k), -1), True))
    return out


#: Bits, hashes and table of a sieve, which has every key at one or two places; a plain tuple, as broadcasts hold no package code.
Sieve = tuple[int, int, np.ndarray]


def _has(sieve: Sieve, key: np.ndarray) -> np.ndarray:
    """Whether each key may be one of the sieve's."""
    bits, hashes, table = sieve
    out = np.ones(len(key), bool)
    for i in range(hashes):
        at = _sieve_places(key[out], i, bits)
        out[out] = (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
    return out


def _sieve_places(key: np.ndarray, i: int, bits: int) -> np.ndarray:
    return mix(key + np.uint64(i)) >> np.uint64(64 - bits)


def _marks(shape: tuple[int, int]):
    """Function that gives the sieve's places of all keys as blocks."""
    bits, hashes = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys in _gathered(b.column(0).to_numpy().view(np.uint64) for b in batches):
            at = np.unique(np.concatenate([_sieve_places(keys, i, bits) for i in range(hashes)]))
            block, ends = _cut(at, BLOCK_BITS)
            low = at.astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array([low[i:j].tobytes() for i, j in zip(ends, ends[1:])], pa.binary())], names=["block", "low"])

    return run


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of each block of :func:`_marks`."""
    blocks: dict[int, np.ndarray] = {}
    for b in batches:
        for block, low in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            at = np.zeros(1 << BLOCK_BITS, bool)
            at[np.frombuffer(low, np.uint16)] = True
            at = np.packbits(at, bitorder="little")
            blocks[block] = blocks[block] | at if block in blocks else at
    yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([x.tobytes() for x in blocks.values()], pa.binary())], names=["block", "bits"])


def _sieves(rows: DataFrame) -> dict[bool, Sieve]:
    """A sieve of the keys of the laid out ``rows`` for each role, by whether its rows are ``long``; a role of too many rows has none."""
    out = {}
    for r in rows.groupBy("long").count().collect():
        bits = min(max(BLOCK_BITS, (16 * r["count"]).bit_length()), SIEVE_BITS)
        if r["count"] > 1 << bits:
            continue
        shape = bits, 2 if 2 * r["count"] <= 1 << bits else 1
        marks = rows.where(F.col("long") == F.lit(r.long)).select("key").mapInArrow(_marks(shape), "block long, low binary")
        found = marks.repartition("block").mapInArrow(_filled, "block long, bits binary").toArrow()  # 2 ** bits at most
        table = np.zeros((1 << (bits - BLOCK_BITS), 1 << (BLOCK_BITS - 3)), np.uint8)
        for block, x in zip(found["block"].to_pylist(), found["bits"].to_pylist()):
            table[block] = np.frombuffer(x, np.uint8)
        out[r.long] = (*shape, table.reshape(-1).view(np.uint64))
    return out


def _meets(sieves: dict[bool, Sieve], key: np.ndarray, long: bool) -> np.ndarray:
    """Whether each key in the role ``long`` may meet one of the other role that the sieves are of."""
    return _has(sieves[not long], key) if (not long) in sieves else np.ones(len(key), bool)


def _layout(hot_keys: np.ndarray, sieves=None):
    """Function that lays out the rows of each class; with broadcast ``sieves`` only those that a row of the other side may meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            parts = []
            for text, key, place, long in _rows(Texts(b.column(2).to_pylist()), hot_keys):
                if sieves is not None:
                    met = _meets(sieves.value, key, long)
                    text, key, place = text[met], key[met], place[met]
                parts.append((key.view(np.int64), place.astype(np.int32), np.full(len(key), long), cls[text], n[text].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names=["key", "at", "long", "cls", "n"])

    return run


LAYOUT = "key long, at int, long boolean, cls long, n int"


def _sifted(sieves):
    """Function that keeps those laid out rows that a row of the other side may meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, long = b.column(0).to_numpy().view(np.uint64), b.column(2).to_numpy(zero_copy_only=False)
            met = np.zeros(len(key), bool)
            for role in (False, True):
                met[long == role] = _meets(sieves.value, key[long == role], role)
            yield b.filter(pa.array(met))

    return run


def _word_distance(a: list[str], b: list[str], most: int) -> int:
    """Edit distance over words, or ``most + 1`` if it is larger."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(left[j - 1] + (x != y), left[j] + 1, row[-1] + 1))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def runs(w):
        return {tuple(w[i : i + CONTAINMENT_GRAM]) for i in range(len(w) - CONTAINMENT_GRAM + 1)}

    ids = WordIds()
    for b in batches:
        out = []
        for a, c, d, ta, tc in zip(*(b.column(k).to_pylist() for k in range(5))):
            wa, wc = ta.split(" "), tc.split(" ")
            most = max(len(wa), len(wc)) // EDIT_EVERY
            used = list({*wa, *wc})
            if len(used) != len(np.unique(_codes(used, ids))):  # two words share a code, so the distance over codes may be too small
                d = _word_distance(wa, wc, most)
            if d <= most:
                ra, rc = runs(wa), runs(wc)
                out.append((a, c, d, len(ra & rc) / len(ra), len(ra & rc) / len(rc)))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["cls_a", "cls_b", "edits", "in_b", "in_a"])


def similar_classes(classes: DataFrame) -> DataFrame:
    """``(cls_a, cls_b, edits)`` of unequal transcripts, one with training and one with held-out records, that are similar by their word codes.

    As two words may share a code, :func:`by_words` has the last word.
    """
    spark = classes.sparkSession
    total = classes.agg(F.sum(F.col("n") - (GRAM - 1))).first()[0] or 0
    counts = classes.select("code").mapInArrow(_gram_counts, "block long, low binary, n binary").repartition("block")
    hot = counts.mapInArrow(_frequent(max(HOT_LEAST, total // HOT)), "key long").toArrow()["key"].to_numpy()  # at most HOT keys
    hot = np.sort(hot.view(np.uint64))
    del counts
    held = written(classes.where("held").select("cls", "n", "code").mapInArrow(_layout(hot), LAYOUT), "held")
    sieves = spark.sparkContext.broadcast(_sieves(held))
    train = written(classes.where("train").select("cls", "n", "code").mapInArrow(_layout(hot, sieves), LAYOUT), "train")
    sieves.destroy()
    release(spark)
    sieves = spark.sparkContext.broadcast(_sieves(train))
    sifted = held.mapInArrow(_sifted(sieves), LAYOUT)
    h = sifted.select("key", F.col("long").alias("side"), *(F.col(c).alias(f"{c}_h") for c in ("at", "cls", "n")))
    t = train.select("key", (~F.col("long")).alias("side"), *(F.col(c).alias(f"{c}_t") for c in ("at", "cls", "n")))
    longer, shorter = F.when(F.col("side"), F.col("n_h")).otherwise(F.col("n_t")), F.when(F.col("side"), F.col("n_t")).otherwise(F.col("n_h"))
    edits = F.floor(longer / EDIT_EVERY)
    near = (shorter <= longer) & (longer - shorter <= edits) & ((F.col("at_h") < 0) | (F.abs(F.col("at_h") - F.col("at_t")) <= edits)) & (F.col("cls_h") != F.col("cls_t"))
    met = written(h.join(t, ["key", "side"]).where(near).select(F.least("cls_h", "cls_t").alias("cls_a"), F.greatest("cls_h", "cls_t").alias("cls_b")).distinct(), "met")
    sieves.destroy()
    discard(held, train)
    release(spark)
    one = classes.select(F.col("cls").alias("cls_a"), F.col("code").alias("code_a"), F.col("n").alias("n_a"))
    two = classes.select(F.col("cls").alias("cls_b"), F.col("code").alias("code_b"), F.col("n").alias("n_b"))
    close = (
        met.join(one, "cls_a").join(two, "cls_b")
        .withColumn("edits", F.levenshtein("code_a", "code_b"))
        .where(F.col("edits") <= F.floor(F.greatest("n_a", "n_b") / EDIT_EVERY))
        .select("cls_a", "cls_b", "edits")
    )
    return finished(close, "close", met)


def by_words(close: DataFrame, members: DataFrame, rec: DataFrame) -> DataFrame:
    """``(cls_a, cls_b, edits, in_b, in_a)`` of the pairs of :func:`similar_classes` that are similar by their words too.

    ``in_b`` is the share of a's five-word runs that stand in b, ``in_a`` the reverse. The
    words of a class are read from one of its ``members`` in ``rec``.
    """
    wanted = close.select(F.col("cls_a").alias("cls")).union(close.select("cls_b")).distinct()
    ids = written(members.join(wanted, "cls").groupBy("cls").agg(F.min("sample_id").alias("sample_id")).select("sample_id").distinct(), "read-again")
    # an id may have several transcripts; those of other classes find no pair
    texts = written(rec.select("sample_id", "transcript").join(bounded(ids, MAX_BROADCAST), "sample_id").select("transcript").mapInArrow(_worded, "cls long, words string").dropDuplicates(["cls"]), "texts")
    a, b = texts.toDF("cls_a", "words_a"), texts.toDF("cls_b", "words_b")
    pairs = close.join(a, "cls_a").join(b, "cls_b").select("cls_a", "cls_b", "edits", "words_a", "words_b")
    return finished(pairs.mapInArrow(_verified, "cls_a long, cls_b long, edits int, in_b double, in_a double"), "similar", ids, texts)


def file_classes(rec: DataFrame) -> DataFrame:
    """``(sample_id, side, corpus, file, n_links)`` of :func:`records` whose audio file name stands in training and held-out splits alike.

    ``n_links`` counts the records of the other side; pairs are not formed.
    """
    files = written(rec.where("corpus is not null and file is not null").select("corpus", "file", "side", "sample_id").distinct(), "named-files")
    size = files.groupBy("corpus", "file").agg(F.count("*").alias("rows"), F.sum("side").alias("n_held")).where("n_held > 0 and n_held < rows")
    linked = hot_join(files, written(size, "files"), ["corpus", "file"])
    return linked.select("sample_id", "side", "corpus", "file", F.when(F.col("side") == 0, F.col("n_held")).otherwise(F.col("rows") - F.col("n_held")).alias("n_links"))


class Overlaps(NamedTuple):
    """Classes of equal transcripts, their similar pairs, and records by class and by file."""

    #: ``(sample_id, side, cls)``
    members: DataFrame
    #: ``(t, h, edits, containment)``: similar classes, one of training and one of held-out records, in both directions
    similar: DataFrame
    #: as :func:`file_classes`
    files: DataFrame


def find(samples: DataFrame) -> Overlaps:
    """All overlaps, by classes: records of one transcript or file are never paired here."""
    rec = records(samples)
    coded = written(rec.select("sample_id", "side", "transcript").mapInArrow(_coded, "sample_id long, side int, cls long, n int, code string"), "coded")
    classes = coded.groupBy("cls").agg(F.first("n").alias("n"), F.first("code").alias("code"), F.bool_or(F.col("side") == 0).alias("train"), F.bool_or(F.col("side") == 1).alias("held"))
    classes = written(classes, "classes")
    members = finished(coded.select("sample_id", "side", "cls").distinct(), "members", coded)
    release(samples.sparkSession)
    close = similar_classes(classes)
    discard(classes)
    release(samples.sparkSession)
    pairs = by_words(close, members, rec)
    discard(close)
    directed = pairs.select(F.col("cls_a").alias("t"), F.col("cls_b").alias("h"), "edits", F.col("in_a").alias("containment")).union(
        pairs.select("cls_b", "cls_a", "edits", "in_b")
    )
    return Overlaps(members, directed, written(file_classes(rec), "same-files"))


def overlaps(samples: DataFrame) -> DataFrame:
    """``(train_id, held_id, kind, edits, containment)`` of all overlapping records.

    ``kind`` is ``file``, ``exact`` or ``near``; ``containment`` the share of the held-out
    record's five-word runs that stand in the training record (null for ``file``). The pairs
    of a large class are spread over tasks.
    """
    members, directed, files = find(samples)
    train = members.where("side = 0").select("cls", F.col("sample_id").alias("train_id"))
    held = members.where("side = 1").select("cls", F.col("sample_id").alias("held_id"))
    near = directed.join(train.withColumnRenamed("cls", "t"), "t").join(held.withColumnRenamed("cls", "h"), "h").select("train_id", "held_id", F.lit("near").alias("kind"), "edits", "containment")
    of = written(train.groupBy("cls").agg(F.count("*").alias("rows")), "class-sizes")
    exact = salted_join(train, held, of, ["cls"]).select("train_id", "held_id", F.lit("exact").alias("kind"), F.lit(0).alias("edits"), F.lit(1.0).alias("containment"))
    keys = ["corpus", "file"]
    a, b = files.where("side = 0").select(*keys, F.col("sample_id").alias("train_id")), files.where("side = 1").select(*keys, F.col("sample_id").alias("held_id"))
    of = written(files.where("side = 0").groupBy(*keys).agg(F.count("*").alias("rows")), "file-sizes")
    file = salted_join(a, b, of, keys).select("train_id", "held_id", F.lit("file").alias("kind"), F.lit(None).cast("int").alias("edits"), F.lit(None).cast("double").alias("containment"))
    return near.union(exact).union(file)


def overlap_pairs(found: DataFrame) -> DataFrame:
    """``(sample_id_a, sample_id_b)``, each pair once with the smaller id first."""
    return found.select(F.least("train_id", "held_id").alias("sample_id_a"), F.greatest("train_id", "held_id").alias("sample_id_b")).where("sample_id_a <> sample_id_b").distinct()


def overlap_report(samples: DataFrame) -> DataFrame:
    """Held-out records with an overlap, per split, corpus and kind; by classes, without forming pairs."""
    names = records(samples).select("sample_id", "split", F.coalesce("corpus", F.lit("unknown")).alias("dataset_name")).where("split <> 'train'").distinct()
    members, directed, files = find(samples)
    held = members.where("side = 1")
    size = written(members.groupBy("cls").agg(F.count_if(F.col("side") == 1).alias("rows"), F.count_if(F.col("side") == 0).alias("n_train")).where("rows > 0"), "held-classes")
    exact = hot_join(held, size.where("n_train > 0"), ["cls"]).select("sample_id", F.lit("exact").alias("kind"))
    # of both directions of a pair only those count that lead from a training class to a held-out one
    trained = members.where("side = 0").select(F.col("cls").alias("t")).distinct()
    near = directed.join(trained, "t").select(F.col("h").alias("cls")).distinct().join(size, "cls")
    near = hot_join(held, written(near, "near-classes"), ["cls"]).select("sample_id", F.lit("near").alias("kind"))
    found = exact.union(near).union(files.where("side = 1").select("sample_id", F.lit("file")))
    return found.join(names, "sample_id").groupBy("split", "dataset_name", "kind").agg(F.count_distinct("sample_id").alias("n_records"))
