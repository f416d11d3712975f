"""Records as they stand in source files: load what parses, state why the rest fails.

A record is split by a minimum-cost error parse. Rows that a cost-free parse reads with valid
types, nearly all, load without leaving the JVM (:func:`loads`). Every other row goes
through the dynamic programme of :func:`repair`, which inserts or deletes quotes and
delimiters until the row has the wanted number of fields, and the edits state the
reason: an edited quote means ``quoting``, else an edited delimiter ``column_count``, and no
edit at all ``invalid_value``. As quotes are judged first, one edit of a quote costs more than
any number of delimiter edits, and a delimiter is never put beside a quote, where it would
excuse it. The edits are returned, so that a reject can be mended by hand. Rows of a
file of neither kind are ``unknown_file``.

Defined cases: a null or blank record is a ``column_count`` reject; a null file name
is an ``unknown_file`` reject; a repeated row comes out as often as it goes in; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column orders and vocabularies of the two file kinds.
DIALOGUE_COLUMNS = ["Dialogue_ID", "Utterance_ID", "Utterance", "Speaker", "Emotion", "Sentiment", "Season", "Episode", "StartTime", "EndTime"]
DIALOGUE_EMOTIONS = {"neutral", "joy", "sadness", "anger", "fear", "disgust", "surprise"}
PARTITIONS = {"Train", "Validation", "Development", "Test1", "Test2", "Test"}

_TOKEN = re.compile(r'"|,|[^",]+')
_DIGITS = re.compile(r"[0-9]+")
#: Replacement character and control characters other than tab and line breaks.
_BAD_TEXT = re.compile("[�\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")

PARSED = (
    "line_id long, file_name string, line_no int, kind string, fields array<string>, "
    "reason string, edit_cost int, edits array<string>"
)
_START, _BARE, _QUOTED, _CLOSED = range(4)


#: What an edit of a quote costs; more than all delimiters of a record.
QUOTE = 1 << 40
#: Quotes, commas and texts between them after which the programme keeps its costs alone; the edits up to there are found by going over them once more.
STRETCH = 4_096
#: The column that takes what is too much in a record: the only one of free text.
FREE_TEXT = 2


def _free(tokens: list[tuple[str, int]]) -> tuple[list[str], list[int]] | None:
    """Fields and places of delimiters of the parse without edits of quotes, of which there is one at most."""
    mode, fields, parts, at = _START, [], [], []
    for token, place in tokens:
        if mode == _QUOTED:
            if token == '"':
                mode = _CLOSED
            else:
                parts.append(token)
        elif token == ",":
            fields.append("".join(parts))
            at.append(place)
            mode, parts = _START, []
        elif token == '"':
            if mode == _BARE:
                return None
            if mode == _CLOSED:
                parts.append('"')
            mode = _QUOTED
        elif mode == _CLOSED:
            return None
        else:
            mode = _BARE
            parts.append(token)
    return None if mode == _QUOTED else ([*fields, "".join(parts)], at)


def _delimited(fields: list[str], at: list[int], width: int, end: int) -> tuple[list[str], list[str]]:
    """Delimiter edits, and the fields after them, that bring a parse to ``width`` fields."""
    more = len(fields) - width
    if more <= 0:
        return [f"insert_delimiter@{end}"] * -more, fields + [""] * -more
    i = min(FREE_TEXT, width - 1)
    return [f"delete_delimiter@{x}" for x in at[i : i + more]], [*fields[:i], "".join(fields[i : i + more + 1]), *fields[i + more + 1 :]]


#: For a token, quote edits and mode afterwards by the mode before it: what the grammar reads, and what edits make of it.
_STEPS = {
    ",": {_START: ((0, _START),), _BARE: ((0, _START),), _QUOTED: ((0, _QUOTED),), _CLOSED: ((0, _START),)},
    '"': {_START: ((0, _QUOTED), (1, _START)), _BARE: ((1, _BARE),), _QUOTED: ((0, _CLOSED), (1, _QUOTED)), _CLOSED: ((0, _QUOTED), (1, _CLOSED))},
    "": {_START: ((0, _BARE),), _BARE: ((0, _BARE),), _QUOTED: ((0, _QUOTED),), _CLOSED: ()},
}
_NEVER = 1 << 30


def _least_quotes(tokens: list[tuple[str, int]]) -> list[list[int]]:
    """The least number of edited quotes from before each token to the end, by mode; fields are not counted."""
    out = [[0, 0, 1, 0]]
    for token, _ in reversed(tokens):
        after, steps = out[-1], _STEPS[token if token in _STEPS else ""]
        row = [min((c + after[m] for c, m in steps[mode]), default=_NEVER) for mode in range(4)]
        row[_QUOTED], row[_START] = min(row[_QUOTED], 1 + row[_CLOSED]), min(row[_START], 1 + row[_QUOTED])  # a quote put in before it
        out.append(row)
    return out[::-1]


def repair(text: str, width: int) -> tuple[int, list[str], list[str]]:
    """Cheapest edits that make ``text`` a record of ``width`` fields.

    Returns the number of edits, the edits as ``operation@offset`` and the fields
    afterwards. The layer without an edited quote holds one parse at most; what it lacks are
    delimiters. Further layers are searched by (fields closed so far, mode of the current field).
    The work is linear in the number of quotes and commas.
    """
    tokens = [(m.group(), m.start()) for m in _TOKEN.finditer(text)]
    free = _free(tokens)
    if free:
        edits, fields = _delimited(*free, width, len(text))
        return len(edits), edits, fields
    least = _least_quotes(tokens)
    budget, here = least[0][_START], least[0]

    # states[state] = (cost, trail); a trail is a linked list of (parent, edit, appended text, closes field) that ends in (None, state it began with)
    def offer(into, k, mode, cost, trail):
        if k < width and cost // QUOTE + here[mode] <= budget and ((k, mode) not in into or into[k, mode][0] > cost):
            into[k, mode] = (cost, trail)

    def insertions(states, at, before):
        """Free-standing insertions at ``at``, where the token ``before`` (none at the end) comes next."""
        for (k, mode), (cost, trail) in sorted(states.items(), key=lambda x: x[1][0]):
            if mode == _QUOTED:
                offer(states, k, _CLOSED, cost + QUOTE, (trail, f"insert_quote@{at}", "", False))
            if mode == _START:
                offer(states, k, _QUOTED, cost + QUOTE, (trail, f"insert_quote@{at}", "", False))
        for k, mode in sorted(states):
            cost, trail = states[k, mode]
            if mode == _START or mode != _QUOTED and before in ("", ","):
                offer(states, k + 1, _START, cost + 1, (trail, f"insert_delimiter@{at}", "", True))

    def stretch(first, costs):
        """The states after the stretch of tokens from ``first`` on, which begins with states of these ``costs``."""
        nonlocal here
        here = least[first]
        best = {state: (cost, (None, state)) for state, cost in costs.items()}
        for i, (token, at) in enumerate(tokens[first : first + STRETCH], first):
            insertions(best, at, token)
            here = least[i + 1]
            after: dict[tuple[int, int], tuple[int, tuple]] = {}
            for (k, mode), (cost, trail) in best.items():
                if token == ",":
                    if mode == _QUOTED:
                        offer(after, k, _QUOTED, cost, (trail, "", ",", False))
                    else:
                        offer(after, k + 1, _START, cost, (trail, "", "", True))
                        offer(after, k, mode, cost + 1, (trail, f"delete_delimiter@{at}", "", False))
                        if joins and mode != _START:
                            offer(after, k, _START, cost + 1, (trail, f"delete_delimiter@{at}", "", False))
                elif token == '"':
                    if mode == _START:
                        offer(after, k, _QUOTED, cost, (trail, "", "", False))
                    elif mode == _QUOTED:
                        offer(after, k, _CLOSED, cost, (trail, "", "", False))
                        offer(after, k, _QUOTED, cost + QUOTE, (trail, f"insert_quote@{at}", '"', False))
                    elif mode == _CLOSED:  # the quote before it was the first of a doubled one
                        offer(after, k, _QUOTED, cost, (trail, "", '"', False))
                    offer(after, k, mode, cost + QUOTE, (trail, f"delete_quote@{at}", "", False))
                elif mode == _QUOTED:
                    offer(after, k, _QUOTED, cost, (trail, "", token, False))
                elif mode in (_START, _BARE):
                    offer(after, k, _BARE, cost, (trail, "", token, False))
            best = after
        if first + STRETCH >= len(tokens):
            for _ in range(width):
                insertions(best, len(text), "")
        return best

    # surplus fields are joined as the grammar allows; where quoted ones leave too many, as if they were bare
    for joins in (False, True):
        begins, costs = [], {(0, _START): 0}
        for first in range(0, len(tokens), STRETCH):
            begins.append((first, costs))
            best = stretch(first, costs)
            costs = {state: cost for state, (cost, _) in best.items()}
        ends = [x for x in best if x[0] == width - 1 and x[1] != _QUOTED]
        if ends:
            break
    state = min(ends, key=lambda x: best[x][0])
    edits, parts = [], []
    while begins:
        first, costs = begins.pop()
        if best is None:
            best = stretch(first, costs)
        _, trail = best[state]
        while trail[0]:
            trail, edit, part, closes = trail
            if edit:
                edits.append(edit)
            parts.append(None if closes else part)
        state, best = trail[1], None
    fields: list[list[str]] = [[]]
    for part in reversed(parts):
        if part is None:
            fields.append([])
        else:
            fields[-1].append(part)
    return len(edits), edits[::-1], ["".join(x) for x in fields]


def _reason(edits: list[str], valid: bool) -> str | None:
    """What the cheapest edits say of a record, and its types if there are none."""
    if any("quote" in x for x in edits):
        return "quoting"
    if edits:
        return "column_count"
    return None if valid else "invalid_value"


def _dialogue(text: str) -> tuple[list[str], str | None, int, list[str]]:
    cost, edits, fields = repair(text, len(DIALOGUE_COLUMNS))
    valid = (
        all(_DIGITS.fullmatch(x.strip()) for x in fields[:2])
        and fields[2].strip()
        and not _BAD_TEXT.search(fields[2])
        and fields[4].strip().lower() in DIALOGUE_EMOTIONS
    )
    return fields, _reason(edits, valid), cost, edits


def _partition(text: str) -> tuple[list[str], str | None, int, list[str]]:
    """As :func:`_dialogue`; these records have no quotes, so each one is deleted, and their delimiter is fixed by the record.

    The cheapest edits for the width then are the deletion of its last delimiters or the insertion of one at the end.
    """
    edits = [f"delete_quote@{m.start()}" for m in re.finditer('"', text)]
    mark = ";" if ";" in text else "," if "," in text else r"\s+"
    inner = text if mark != r"\s+" else text.rstrip()
    places = [m.start() for m in re.finditer(mark, inner) if mark != r"\s+" or m.start()]
    fields = text.replace('"', "").split(*([mark] if mark != r"\s+" else []))
    if len(fields) < 2:
        edits += [f"insert_delimiter@{len(text)}"] * (2 - max(len(fields), 1))
    else:
        edits += [f"delete_delimiter@{x}" for x in places[1:]]
    valid = len(fields) == 2 and fields[1].strip() in PARTITIONS
    return fields, _reason(edits, valid), len(edits), edits


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for kind, text in zip(pdf["kind"], pdf["raw_text"]):
            text = text if isinstance(text, str) else ""
            out.append(_dialogue(text) if kind == "dialogue" else _partition(text) if kind == "partition" else ([], "unknown_file", 0, []))
        head = pdf[["line_id", "file_name", "line_no", "kind"]]
        yield head.assign(fields=[x[0] for x in out], reason=[x[1] for x in out], edit_cost=[x[2] for x in out], edits=[x[3] for x in out])


#: Stands between fields while a record is split in the JVM; a record that holds it is left to the programme.
_MARK = "\x01"


def _dialogue_fields(t: Column) -> Column:
    """Fields of a record by the cost-free parse, null if there is none.

    Cut at its quotes, a record alternates between what stands outside of quotes and inside. What
    stands outside begins and ends with a comma, but for the record's ends; nothing between two
    quotes is a doubled one.
    """
    parts, last = F.split(t, '"'), F.size(F.split(t, '"')) - 1
    outside = lambda i: i % 2 == 0
    doubled = lambda x, i: (x == "") & (i > 0) & (i < last)
    fine = lambda x, i: ((i == 0) | x.startswith(",")) & ((i == last) | x.endswith(",")) | (x == "")
    sound = (last % 2 == 0) & F.forall(F.transform(parts, lambda x, i: ~outside(i) | fine(x, i)), lambda x: x)
    joined = F.array_join(F.transform(parts, lambda x, i: F.when(~outside(i), x).when(doubled(x, i), '"').otherwise(F.replace(x, F.lit(","), F.lit(_MARK)))), "")
    return F.when(t.contains(_MARK), None).when(~t.contains('"'), F.split(t, ",")).when(sound, F.split(joined, _MARK))


def _partition_fields(t: Column) -> Column:
    return F.when(t.contains('"') | t.rlike("[\x1c-\x1f]"), None).when(t.contains(";"), F.split(t, ";")).when(t.contains(","), F.split(t, ",")).otherwise(F.split(F.regexp_replace(t, r"(?U)^\s+|\s+$", ""), r"(?U)\s+"))


def loads(kind: Column, fields: Column) -> Column:
    """Whether the fields of a cost-free parse are valid for sure; what is in doubt is left to the programme."""
    whole = lambda x: x.rlike(r"\A *[0-9]+ *\z")
    text = lambda x: x.rlike(r"[\p{L}\p{N}\p{P}]") & ~x.rlike("[\ufffd\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]")
    dialogue = lambda f: (F.size(f) == len(DIALOGUE_COLUMNS)) & whole(f[0]) & whole(f[1]) & text(f[2]) & F.lower(F.trim(f[4])).isin(*sorted(DIALOGUE_EMOTIONS))
    partition = lambda f: (F.size(f) == 2) & F.trim(f[1]).isin(*sorted(PARTITIONS))
    # the array binds the fields, so that they are split once for all tests
    test = lambda f: F.when(kind == "dialogue", dialogue(f)).otherwise(partition(f))
    return F.coalesce(F.exists(F.array(fields), test), F.lit(False))


def parse_records(lines: DataFrame) -> DataFrame:
    """One row per input row: its kind, fields, the reason it fails (null if it loads) and the edits."""
    name = F.coalesce("file_name", F.lit(""))
    kind = F.when(name.contains("_sent_emo_") & name.endswith(".csv"), "dialogue").when(F.element_at(F.split(name, "/"), -1).startswith("partition_") & name.endswith(".txt"), "partition")
    rows = lines.select(F.col("line_id").cast("long"), F.col("file_name").cast("string"), F.col("line_no").cast("int"), F.col("raw_text").cast("string"), kind.alias("kind"))
    t = F.col("raw_text")
    fields = F.when(F.col("kind") == "dialogue", _dialogue_fields(t)).when(F.col("kind") == "partition", _partition_fields(t))
    clean = loads(F.col("kind"), fields)
    loaded = rows.where(clean).select("line_id", "file_name", "line_no", "kind", fields.alias("fields"), F.lit(None).cast("string").alias("reason"), F.lit(0).alias("edit_cost"), F.array().cast("array<string>").alias("edits"))
    return loaded.union(rows.where(~clean).mapInPandas(_parse, PARSED))


def valid_dialogue_rows(parsed: DataFrame) -> DataFrame:
    """Typed dialogue rows; labels lower-cased and stripped, text as it stands."""
    f = F.col("fields")
    text = {n: f[i] for i, n in enumerate(DIALOGUE_COLUMNS)}
    return parsed.where((F.col("kind") == "dialogue") & F.col("reason").isNull()).select(
        "line_id",
        "file_name",
        F.expr("try_cast(trim(fields[0]) as bigint)").alias("dialogue_id"),
        F.expr("try_cast(trim(fields[1]) as bigint)").alias("utterance_id"),
        text["Utterance"].alias("utterance"),
        F.trim(text["Speaker"]).alias("speaker"),
        F.lower(F.trim(text["Emotion"])).alias("emotion"),
        F.lower(F.trim(text["Sentiment"])).alias("sentiment"),
        text["Season"].alias("season"),
        text["Episode"].alias("episode"),
        text["StartTime"].alias("start_time"),
        text["EndTime"].alias("end_time"),
    )


def valid_partition_rows(parsed: DataFrame) -> DataFrame:
    """``utterance_id`` and ``partition`` of the partition records that load."""
    return parsed.where((F.col("kind") == "partition") & F.col("reason").isNull()).select(
        "line_id", "file_name", F.trim(F.col("fields")[0]).alias("utterance_id"), F.trim(F.col("fields")[1]).alias("partition")
    )


def rejects(parsed: DataFrame) -> DataFrame:
    """Rows that fail, with reason and edits."""
    return parsed.where(F.col("reason").isNotNull())
