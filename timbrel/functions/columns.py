"""Column expressions that the operators share. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timbrel import rubric, taxonomy

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strip(c) -> Column:
    """Without outer white space of any kind; Spark's trim takes spaces only."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(" \t\n\r\x0b\x0c"))


def clamp(c, low: float = rubric.LOW, high: float = rubric.HIGH) -> Column:
    """Bounded value; null stays null, which ``least`` alone would turn into the bound."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


#: The characters that Unicode counts as white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def outer(c) -> Column:
    """Without outer white space of any kind, Unicode's included."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE_SPACE))


def corpus_name(c="dataset_name") -> Column:
    """The corpus a name means, whatever its case and separators; null for an unknown one."""
    return lookup(F.regexp_replace(F.lower(c), r"(?U)[\s_-]+", ""), taxonomy.CORPORA)


def split_name(c="split") -> Column:
    """``train``, ``val`` or ``test``; null for any other value."""
    return lookup(F.lower(outer(c)), taxonomy.SPLITS)


def category(c="categorical_emotion") -> Column:
    """The category a label means; null for one outside of the vocabulary."""
    v = F.lower(outer(c))
    return F.when(v.isin(list(taxonomy.EMOTIONS)), v)


def speaker_name(c="speaker_id") -> Column:
    """A speaker in lower case; null where the speaker is not known."""
    v = F.lower(outer(c))
    return F.when(~v.isin(taxonomy.NO_SPEAKER), v)


def person_name(c="annotator_id") -> Column:
    """An annotator in upper case; null where nobody is named."""
    return F.nullif(F.upper(outer(c)), F.lit(""))


def number(c) -> Column:
    """The double that a stripped text spells in plain or exponent notation, else null."""
    s = strip(c)
    return F.when(s.rlike(_NUMBER), s.try_cast("double"))


def number_or(c, default: float) -> Column:
    return F.coalesce(number(c), F.lit(float(default)))


def half_step(c) -> Column:
    """Rounded to halves, ties to the even half."""
    return F.bround(c * 2, 0) / 2


def rescale(c, top: float, low: float = 1.0, to: float = 5.0) -> Column:
    """From ``low``..``top`` to ``low``..``to``."""
    return c if top == to else F.lit(low) + (c - low) * (to - low) / (top - low)


def canonical_label(dataset: Column, raw: Column) -> Column:
    """The canonical emotion of a corpus' code; ``other`` for an unknown one."""
    pairs = [F.lit(x) for d, m in taxonomy.LABELS.items() for k, v in m.items() for x in (f"{d}/{k}", v)]
    return F.coalesce(F.create_map(*pairs)[F.concat_ws("/", dataset, raw)], F.lit("other"))


def lookup(c: Column, values: dict, default=None) -> Column:
    found = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[c]
    return found if default is None else F.coalesce(found, F.lit(default))


def last_turns(turns: Column, n: int) -> Column:
    """The last ``n`` elements; all of a shorter array, none of a null one."""
    held = F.coalesce(turns, F.array().cast("array<string>"))
    return F.slice(held, F.greatest(F.size(held) - n + 1, F.lit(1)), F.lit(n))


def numbered(turns: Column, mark: str = "  Turn ") -> Column:
    """``  Turn 1: ...`` lines of an array."""
    lines = F.transform(turns, lambda t, i: F.concat(F.lit(mark), (i + 1).cast("string"), F.lit(": "), t))
    return F.array_join(lines, "\n")


def indented(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("  "), t)), "\n")


def mean_of(arr: Column, field: str) -> Column:
    """Mean of a field over an array of structs; null of an empty one."""
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x[field])
    return F.when(F.size(arr) > 0, total / F.size(arr))


def sections(text: Column) -> dict[str, Column]:
    """``evidence`` and ``reasoning`` of a sectioned response, stripped; empty if the heading is missing."""
    def cut(start: str, end: str) -> Column:
        at = F.instr(text, start)
        rest = text.substr(at + F.lit(len(start)), F.length(text))
        stop = F.instr(rest, end)
        return F.when(at == 0, F.lit("")).otherwise(strip(F.when(stop > 0, rest.substr(F.lit(1), stop - 1)).otherwise(rest)))

    return {"evidence": cut("[EVIDENCE]", "[REASONING]"), "reasoning": cut("[REASONING]", "[SCORES]")}


def _score_lines(text: Column) -> Column:
    """Stripped lines after the first line that is exactly ``[SCORES]``."""
    lines = F.transform(F.split(text, "\n"), strip)
    at = F.array_position(lines, "[SCORES]")
    return F.when(at > 0, F.slice(lines, at.cast("int") + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))


def score_pairs(text: Column) -> Column:
    """``name: number`` lines of a response's score section as an array of structs, numbers clamped.

    Store it as a column before :func:`scores_of` reads it seven times.
    """
    pair = lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), clamp(number(x.substr(F.instr(x, ":") + F.lit(1), F.length(x)))).alias("v"))
    return F.filter(F.transform(F.filter(_score_lines(text), lambda x: x.contains(":")), pair), lambda p: p["v"].isNotNull())


def scores_of(pairs: Column) -> dict[str, Column]:
    """Each dimension's score: the last pair of its name; null if there is none."""
    return {n: F.try_element_at(F.filter(pairs, _named(n)), F.lit(-1))["v"] for n in rubric.NAMES}


def _named(name: str):
    return lambda p: p["k"] == name


def with_scores(df, text: str):
    """``df`` with ``_pairs`` of a text column, and the score columns to select from it."""
    return df.withColumn("_pairs", score_pairs(F.col(text))), scores_of(F.col("_pairs"))


def score_struct(columns: dict[str, Column], default: float = rubric.NEUTRAL) -> Column:
    return F.struct(*(F.coalesce(columns[n], F.lit(default)).alias(n) for n in rubric.NAMES))


def unfenced(text: Column) -> Column:
    """A response without the code fence around it."""
    t = strip(text)
    t = F.when(t.startswith("```") & t.contains("\n"), t.substr(F.instr(t, "\n") + F.lit(1), F.length(t))).otherwise(t)
    cut = F.length(t) - F.instr(F.reverse(t), "```") - 2
    return strip(F.when(t.endswith("```"), t.substr(F.lit(1), cut)).otherwise(t))
