"""Problem 1: ordered conversations with roles out of single message rows.

Rows equal in conversation, turn, speaker and text are one turn. A turn is linked to the
turn it replies to (the one before) and to those it quotes, where a quotation stands word
for word in the turn at its place. The connected components of these links, found by
alternating large-star and small-star joins, are the conversations; each is ordered and
validated by itself, and an identifier whose turns are not one sound component names a
broken conversation. :func:`assemble` and :func:`assemble_quoting` do without identifiers.

A conversation is dropped for any of: ``no_number`` (a row without a turn number),
``hole`` (a component whose turns are not 0, 1, 2, ...), ``conflict`` (a turn with two
speakers or texts), ``blank`` (text or speaker), ``one_speaker``, ``missing_turn`` (a
quoting record names a turn that is not there), ``context`` (a record's quoted turns
are not exactly those right before it).

Defined cases: rows without an identifier belong to none unless links give them one;
null quoted turns are no quoted turns; a null quoted turn matches nothing; repeated rows
count once; quoting records of unknown conversations are ignored; empty tables give
empty results; texts are compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbrel.functions.columns import corpus_name, outer
from timbrel.llm.graph import star_components
from timbrel.operators.skew import hot_join
from timbrel.session import finished, written

CONTEXT = 3
#: Words from which a stretch of turns tells its conversation, speakers' names included.
STRETCH_WORDS = 6
REASONS = ("no_number", "hole", "conflict", "blank", "one_speaker", "missing_turn", "context")


def _squeezed(c: Column) -> Column:
    """Without outer and with single inner white space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _quote_key(c: Column) -> Column:
    """Hash of ``[speaker] text`` regardless of letter case and extra white space."""
    return F.xxhash64(F.lower(F.regexp_replace(_squeezed(c), r"^\[ ?(.*?) ?\] ?", "[$1] ")))


def turns(messages: DataFrame) -> DataFrame:
    """One row per turn and version: keys, normalised speaker and text as hashes, and the quotation key."""
    speaker, text = F.lower(outer("speaker")), _squeezed("utterance")
    return messages.where("dialogue_id is not null").select(
        F.col("dialogue_id").cast("long").alias("conv"),
        F.col("utterance_id").cast("long").alias("turn"),
        F.when(F.length(speaker) > 0, F.xxhash64(speaker)).alias("speaker_key"),
        F.when(F.length(text) > 0, F.xxhash64(text)).alias("text_key"),
        _quote_key(F.concat(F.lit("["), F.coalesce(outer("speaker"), F.lit("")), F.lit("] "), F.coalesce("utterance", F.lit("")))).alias("quote_key"),
    ).distinct()


def quoting_records(samples: DataFrame) -> DataFrame:
    """``(conv, turn, context_turns)`` of the dialogue corpus' records, from ids like ``dia12_utt3``."""
    number = lambda i: F.expr(f"try_cast(regexp_extract(trim(utterance_id), '^dia([0-9]+)_utt([0-9]+)$', {i}) as bigint)")
    return samples.where(corpus_name() == "meld").select(number(1).alias("conv"), number(2).alias("turn"), "context_turns").where("conv is not null and turn is not null")


#: Turn numbers below this, of conversations from 0 to ``MAX_PLAIN``, make exact node ids; other nodes are hashed, below 0.
TURNS = 1 << 24
MAX_PLAIN = (1 << 39) - 1


def _node(conv: str | Column, turn: str | Column) -> Column:
    """Id of a turn; those of one conversation follow each other."""
    conv, turn = (F.col(c) if isinstance(c, str) else c for c in (conv, turn))
    plain = conv.between(0, MAX_PLAIN) & turn.between(0, TURNS - 1)
    return F.when(plain, conv * TURNS + turn).otherwise(F.xxhash64(conv, turn).bitwiseOR(F.lit(-(1 << 63))))


def broken_conversations(messages: DataFrame, samples: DataFrame) -> DataFrame:
    """``(conv, reason)``: every reason for which a conversation is dropped."""
    t = written(turns(messages), "turns")
    per_turn = t.where("turn is not null").groupBy("conv", "turn").agg(
        F.min("speaker_key").alias("s1"), F.max("speaker_key").alias("s2"), F.min("text_key").alias("t1"), F.max("text_key").alias("t2"),
        F.bool_or(F.col("speaker_key").isNull() | F.col("text_key").isNull()).alias("blank"),
    )
    per_turn = written(per_turn.withColumn("node", _node("conv", "turn")), "turn")
    now = per_turn.select("conv", "turn")

    size = written(t.groupBy("conv").agg(F.count("*").alias("rows"), F.bool_or(F.col("turn").isNull()).alias("no_number")), "known")
    context = F.coalesce("context_turns", F.array().cast("array<string>"))
    quotes = quoting_records(samples).select(
        "conv", "turn", F.size(context).alias("held"), F.transform(context, _quote_key).alias("keys"), F.exists(context, lambda x: x.isNull()).alias("gap")
    ).distinct()
    records = written(hot_join(quotes, size, ["conv"]).drop("rows", "no_number"), "quotes")
    # each quoted turn beside the turn at its place
    placed = records.where(F.col("held") <= CONTEXT).select("conv", F.col("turn").alias("by"), "held", F.posexplode("keys").alias("i", "quote_key"))
    placed = placed.select("conv", "by", (F.col("by") - F.col("held") + F.col("i")).alias("turn"), "quote_key").distinct()
    said = t.where("turn is not null").select("conv", "turn", "quote_key", F.lit(True).alias("there")).distinct()
    placed = written(placed.join(said, ["conv", "turn", "quote_key"], "left").select("conv", "by", "turn", "there"), "placed")

    replies = per_turn.where("turn > 0").select(F.col("node").alias("src"), "conv", (F.col("turn") - 1).alias("turn")).join(now, ["conv", "turn"])
    links = replies.select("src", _node("conv", "turn").alias("dst")).union(placed.where("there").select(_node("conv", "by"), _node("conv", "turn")))
    component = star_components(links)
    shape = per_turn.join(component, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(
        F.min("conv").alias("conv"), F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count("*").alias("n"), F.bool_or("blank").alias("blank"),
        F.bool_or((F.col("s1") != F.col("s2")) | (F.col("t1") != F.col("t2"))).alias("conflict"), F.min("s1").alias("s1"), F.max("s2").alias("s2"),
    )
    shape = shape.groupBy("conv").agg(
        F.bool_or(F.expr("lo <> 0 or hi <> n - 1")).alias("hole"), F.bool_or("blank").alias("blank"), F.bool_or("conflict").alias("conflict"),
        F.coalesce(F.min("s1") == F.max("s2"), F.lit(True)).alias("one_speaker"),
    )
    named = F.array_compact(F.array(*(F.when(F.coalesce(F.col(r), F.lit(False)), F.lit(r)) for r in ("hole", "blank", "conflict", "one_speaker"))))
    out = shape.select("conv", F.explode(named).alias("reason"))
    out = out.union(size.where("no_number").select("conv", F.lit("no_number")))
    absent = records.join(now, ["conv", "turn"], "left_anti")
    out = out.union(absent.select("conv", F.lit("missing_turn")))
    length = records.where(F.col("gap") | (F.col("held") != F.least(F.col("turn"), F.lit(CONTEXT))))
    out = out.union(length.select("conv", F.lit("context")))
    out = out.union(placed.where("there is null").select("conv", F.lit("context"))).distinct()
    return finished(out, "reasons", t, per_turn, size, records, placed, component)


def conversations(messages: DataFrame, samples: DataFrame) -> DataFrame:
    """``(dialogue_id, turn, role, speaker, text)`` of the conversations that hold.

    Roles are ``speaker_1``, ``speaker_2``, ... in the order of first speaking. Turns stay
    rows, so that a conversation of any length is spread over tasks.
    """
    bad = written(broken_conversations(messages, samples).select("conv").distinct(), "broken")
    rows = messages.where("dialogue_id is not null").select(
        F.col("dialogue_id").cast("long").alias("conv"), F.col("utterance_id").cast("long").alias("turn"), F.initcap(F.lower(outer("speaker"))).alias("speaker"), _squeezed("utterance").alias("text")
    )
    rows = written(rows.distinct(), "rows")
    # a conversation's rows are its speakers' rows, so the small table of speakers is sieved
    first = rows.groupBy("conv", "speaker").agg(F.min("turn").alias("first"), F.count("*").alias("rows")).join(bad, "conv", "left_anti")
    role = first.selectExpr("conv", "speaker", "concat('speaker_', row_number() over (partition by conv order by first, speaker)) as role", "rows")
    return hot_join(rows, written(role, "roles"), ["conv", "speaker"]).select(F.col("conv").alias("dialogue_id"), "turn", "role", "speaker", "text")


def assemble(messages: DataFrame, links: DataFrame) -> DataFrame:
    """``(message_id, conversation)`` of messages that carry no conversation identifier.

    ``links`` are ``(message_id, to_id)`` rows of replies and quotations. Messages
    without any link are conversations of their own. Links to unknown messages count as
    links to a message that is not there, so that its quoters stay together.
    """
    component = star_components(links, "message_id", "to_id")
    ids = messages.select(F.col("message_id").cast("long").alias("message_id")).where("message_id is not null").distinct()
    return ids.join(component, ids["message_id"] == component["node"], "left").select("message_id", F.coalesce("component", "message_id").alias("conversation"))


def assemble_quoting(samples: DataFrame, least_words: int = STRETCH_WORDS) -> DataFrame:
    """``(sample_id, conversation, n_before, n_records)`` of the dialogue corpus' records, without looking at their identifiers.

    A record knows what it says and the up to three turns before it, four turns in all.
    From each of these the shortest stretch of at least ``least_words`` words, one to three
    turns with their speakers, is a node; records that hold the same stretch are linked by
    it. So links stay as many as turns, however often something is said, and what many
    conversations share, like a short greeting, links none. ``n_before`` is the number
    of quoted turns (three stands for three or more). A record that shares no stretch is a
    conversation of its own; a repeated id counts once, with its longest quotation.
    """
    turn = lambda c: F.struct(_quote_key(c).alias("k"), F.size(F.split(_squeezed(c), " ")).alias("w"))
    said = F.concat(F.lit("["), F.coalesce(outer("speaker_id"), F.lit("")), F.lit("] "), F.coalesce("transcript", F.lit("")))
    context = F.filter(F.coalesce("context_turns", F.array().cast("array<string>")), lambda x: x.isNotNull())
    rec = samples.where((corpus_name() == "meld") & F.col("sample_id").isNotNull()).select(F.col("sample_id").cast("long").alias("sample_id"), F.size(context).alias("n"), F.transform(F.array_append(context, said), turn).alias("t"))
    rec = written(rec.groupBy("sample_id").agg(F.max(F.struct("n", "t")).alias("r")).select("sample_id", "r.n", "r.t").withColumn("message", F.xxhash64(F.lit("message"), "sample_id")), "messages")

    def shortest(i):
        runs = F.array(*(F.when(i + k <= F.size("t"), F.slice("t", i + 1, k)) for k in range(1, CONTEXT + 1)))
        fine = F.filter(runs, lambda r: F.aggregate(r, F.lit(0), lambda n, x: n + x["w"]) >= least_words)
        return F.transform(F.try_element_at(fine, F.lit(1)), lambda x: x["k"])

    stretches = F.array_compact(F.transform(F.sequence(F.lit(0), F.size("t") - 1), shortest))
    links = rec.select("message", F.explode(stretches).alias("s")).select("message", F.xxhash64(F.lit("stretch"), "s").alias("stretch"))
    component = star_components(links, "message", "stretch")
    found = rec.join(component, F.col("message") == F.col("node"), "left")
    found = written(found.select("sample_id", F.coalesce("component", "message").alias("conversation"), F.col("n").alias("n_before")), "assembled")
    size = written(found.groupBy("conversation").agg(F.count("*").alias("rows")), "assembled-sizes")
    out = hot_join(found, size, ["conversation"]).select("sample_id", "conversation", "n_before", F.col("rows").alias("n_records"))
    return finished(out, "conversations", rec, component, found, size)
