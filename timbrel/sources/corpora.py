"""Readers of the four corpora. Each returns the unified ``SAMPLE`` schema.

``ordinal`` is the place in corpus order. Parsing is split from file access: every
``parse_*`` function takes a table of file names or lines, so it also runs on tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timbrel.functions.columns import canonical_label, lookup, number, number_or, person_name, rescale, strip
from timbrel.operators.frames import context_turns
from timbrel.operators.samples import first_n
from timbrel.sources import paths
from timbrel.taxonomy import ACTOR_SPLITS, DIALOGUE_AUDIO, DIALOGUE_DIRS, DIALOGUE_FILES, INTENSITIES, PARTITION_SPLITS, SAMPLE, SESSION_SPLITS, STATEMENTS, VAD

_DEFAULTS = {
    "sample_rate": "16000", "duration_sec": "0.0D", "audio_path": "''", "speaker_id": "''", "gender": "''", "transcript": "''", "context_turns": "array()", "categorical_emotion": "null",
    "emotion_raw_label": "''", "vad_annotations": f"cast(array() as array<{VAD}>)", "sentiment": "''", "emotion_intensity": "''", "metadata": "map()",
}


def unified(df: DataFrame) -> DataFrame:
    """``df`` in the unified schema; columns it lacks get their empty value."""
    out = []
    for part in SAMPLE.replace(f"array<{VAD}>", "array<VAD>").split(", "):
        name, kind = part.split(" ", 1)
        value = F.col(name) if name in df.columns else F.expr(_DEFAULTS[name])
        out.append(value.cast(kind.replace("VAD", VAD)).alias(name))
    return df.select(*out)


def _ordinal() -> Column:
    """A number that grows with the sort order, without a global window: ids grow with partition and row."""
    return F.monotonically_increasing_id()


# ---- acted corpus: all labels are in the file name -------------------------------------


def parse_coded_names(names: DataFrame, stem: str = "stem") -> DataFrame:
    """Fields of ``MM-CC-EE-II-SS-RR-AA`` names; names of another shape and video-only files are dropped."""
    p = F.split(stem, "-")
    part = lambda i: F.try_element_at(p, F.lit(i))
    actor = part(7).try_cast("int")
    return names.where((F.size(p) == 7) & (part(1) != "02")).select(
        "*",
        F.when(part(2) == "01", "speech").otherwise("song").alias("channel"),
        canonical_label(F.lit("ravdess"), part(3)).alias("categorical_emotion"),
        part(3).alias("emotion_raw_label"),
        lookup(part(4), INTENSITIES, "normal").alias("emotion_intensity"),
        part(4).alias("intensity"), part(5).alias("statement"), part(6).alias("repetition"), part(1).alias("modality"), actor.alias("actor"),
        F.when(actor % 2 == 1, "M").otherwise("F").alias("gender"),
        F.format_string("Actor_%02d", actor).alias("speaker_id"),
        lookup(part(5), STATEMENTS, "").alias("transcript"),
    )


def acted_root(spark: SparkSession, root: str) -> str | None:
    """The folder with actor folders: the root or one of its children."""
    return paths.first_existing(spark, [f"{p}/Actor_01" for p in [root, *paths.children(spark, root)]])


def read_acted(spark: SparkSession, root: str, split: str = "train", actors: list[int] | None = None, speech_only: bool = True, include_neutral: bool = True, max_samples: int | None = None) -> DataFrame:
    """The acted corpus; splits are by actor."""
    found = acted_root(spark, root)
    if not found:
        return spark.createDataFrame([], SAMPLE)
    base = found.rsplit("/", 1)[0]
    f = paths.files(spark, f"{base}/Actor_*", "*.wav").withColumn("stem", F.regexp_replace("name", r"\.wav$", ""))
    f = f.withColumn("folder", F.regexp_extract("path", r"/Actor_(\d+)/[^/]*$", 1).try_cast("int"))
    f = parse_coded_names(f.where(F.col("folder").isin([*(actors or ACTOR_SPLITS.get(split, range(1, 25)))])))
    # the folder names the actor
    f = f.withColumn("speaker_id", F.format_string("Actor_%02d", "folder")).withColumn("gender", F.when(F.col("folder") % 2 == 1, "M").otherwise("F"))
    if speech_only:
        f = f.where("channel = 'speech'")
    if not include_neutral:
        f = f.where("categorical_emotion <> 'neutral'")
    meta = F.create_map(*(x for n in ("modality", "channel", "repetition") for x in (F.lit(n), F.col(n))), F.lit("intensity_code"), F.col("intensity"), F.lit("statement_code"), F.col("statement"), F.lit("actor_num"), F.col("folder").cast("string"))
    f = f.orderBy("folder", "stem").select("*", meta.alias("metadata"), F.lit("ravdess").alias("dataset_name"), F.lit(split).alias("split"), F.col("stem").alias("utterance_id"), F.col("path").alias("audio_path"), _ordinal().alias("ordinal"))
    return first_n(unified(f), max_samples, ["ordinal"])


# ---- dyadic corpus: evaluation lines and transcripts ------------------------------------

def _decimals(fields: Column, n: int) -> Column:
    """Whether an array holds exactly ``n`` plain decimal numbers with a point."""
    return (F.size(fields) == n) & F.forall(fields, lambda x: x.rlike(r"^[0-9]+[.][0-9]+$"))


def _evaluation(line: Column) -> dict[str, Column]:
    """Parts of ``[start - end] utterance label [v, a, d]``: cut at the brackets, then at dash, blanks and commas."""
    times = F.transform(F.split(F.substring_index(F.substring_index(line, "]", 1), "[", -1), "-"), strip)
    after = line.substr(F.instr(line, "]") + F.lit(1), F.length(line))
    named = F.substring_index(after, "[", 1)
    names = F.split(strip(named), r"\s+")
    values = F.transform(F.split(F.substring_index(F.substring_index(F.substring_index(after, "]", 1), "[", 2), "[", -1), ","), strip)
    spaced = named.rlike(r"^\s.*\s$") & after.contains("[") & F.substring_index(after, "[", -1).contains("]")
    fine = line.startswith("[") & _decimals(times, 2) & (F.size(names) == 2) & F.get(names, F.lit(1)).rlike(r"^\w+$") & _decimals(values, 3) & spaced
    return {"fine": fine, "times": times, "utterance": F.get(names, F.lit(0)), "label": F.get(names, F.lit(1)), "values": values}


def _spoken(line: Column) -> dict[str, Column]:
    """Parts of ``utterance [start-end]: text``."""
    head = F.substring_index(line, "]:", 1)
    named, times = F.substring_index(head, "[", 1), F.split(F.substring_index(head, "[", -1), "-")
    fine = line.contains("]:") & head.contains("[") & named.rlike(r"^\S+\s+$") & _decimals(times, 2)
    return {"fine": fine, "utterance": strip(named), "text": strip(line.substr(F.length(head) + F.lit(3), F.length(line)))}


def parse_evaluations(lines: DataFrame, line: str = "value", merge_excited: bool = True, parity: bool = False) -> DataFrame:
    """Fields of evaluation lines; other lines are dropped.

    With ``parity`` every speaker is read as male and the dialogue id is the first two
    parts of the utterance id; else gender comes from the last part and the id keeps all
    parts before it.
    """
    t = strip(line)
    e = _evaluation(t)
    rows = lines.withColumn("_e", F.when(e["fine"], F.struct(*(e[n].alias(n) for n in ("times", "utterance", "label", "values"))))).where("_e is not null")
    e = F.col("_e")
    emotion = canonical_label(F.lit("iemocap"), F.lower(F.substring(e["label"], 1, 3)))
    if merge_excited:
        emotion = F.when(emotion == "excited", "happy").otherwise(emotion)
    utterance = e["utterance"]
    gender = F.lit("M") if parity else F.when(F.element_at(F.split(utterance, "_"), -1).startswith("F"), "F").otherwise("M")
    dialog = F.substring_index(utterance, "_", 2) if parity else F.regexp_replace(utterance, "_[^_]*$", "")
    return rows.select(
        *lines.columns, number(e["times"][0]).alias("start_time"), number(e["times"][1]).alias("end_time"), utterance.alias("utterance_id"), F.lower(e["label"]).alias("emotion_raw_label"), emotion.alias("categorical_emotion"),
        F.struct(*(number(e["values"][i]).alias(n) for i, n in enumerate(("valence", "arousal", "dominance"))), F.lit("majority_vote").alias("annotator_id")).alias("vad"),
        gender.alias("gender"), dialog.alias("dialog_id"),
    )


def parse_spoken_lines(lines: DataFrame, order: list[str], line: str = "value") -> DataFrame:
    """``(utterance_id, transcript)`` of transcript lines; comments are dropped, the last of several wins."""
    t = strip(line)
    said = _spoken(t)
    hit = lines.where(said["fine"] & ~t.startswith(";")).select(said["utterance"].alias("utterance_id"), said["text"].alias("transcript"), F.struct(*order).alias("o"))
    return hit.groupBy("utterance_id").agg(F.max_by("transcript", "o").alias("transcript"))


def _lines(spark: SparkSession, glob: str) -> DataFrame:
    """Text lines with file and place in it. A large file is read in blocks: a block's start and the order of reading within it give the place."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(glob).select("value", F.col("_metadata.file_path").alias("path"), place.alias("line"))


def read_dyadic(spark: SparkSession, root: str, split: str = "train", sessions: list[int] | None = None, include_scripted: bool = True, include_improvised: bool = True, emotions: list[str] | None = None, merge_excited: bool = True, max_samples: int | None = None, parity: bool = False) -> DataFrame:
    """The dyadic corpus; splits are by session. The emotion filter comes after context."""
    parts = []
    for s in sessions or SESSION_SPLITS.get(split, (1, 2, 3, 4)):
        base = f"{root}/Session{s}"
        if not paths.exists(spark, f"{base}/dialog/EmoEvaluation"):
            continue
        rows = parse_evaluations(_lines(spark, f"{base}/dialog/EmoEvaluation/*.txt"), merge_excited=merge_excited, parity=parity)
        stem = F.regexp_extract("path", r"([^/]*)\.txt$", 1)
        if not include_improvised:
            rows = rows.where(~stem.contains("impro"))
        if not include_scripted:
            rows = rows.where(~stem.contains("script"))
        rows = rows.withColumn("speaker_id", F.format_string(f"S{s:02d}_%s", "gender"))
        if paths.exists(spark, f"{base}/dialog/transcriptions"):
            rows = rows.join(parse_spoken_lines(_lines(spark, f"{base}/dialog/transcriptions/*.txt"), ["path", "line"]), "utterance_id", "left")
        else:
            rows = rows.withColumn("transcript", F.lit(""))
        rows = rows.withColumn("transcript", F.coalesce("transcript", F.lit("")))
        rows = context_turns(rows, "path", ["start_time", "line"], "speaker_id", "transcript")
        parts.append(rows.withColumn("session", F.lit(s)).withColumn("audio_path", F.format_string(f"{base}/sentences/wav/%s/%s.wav", "dialog_id", "utterance_id")))
    if not parts:
        return spark.createDataFrame([], SAMPLE)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if emotions:
        out = out.where(F.col("categorical_emotion").isin(emotions))
    kind = F.when(F.col("dialog_id").contains("impro"), "improvised").otherwise("scripted")
    meta = F.create_map(*(x for n, c in (("session", F.col("session")), ("dialog_id", F.col("dialog_id")), ("start_time", F.col("start_time")), ("end_time", F.col("end_time")), ("dialog_type", kind)) for x in (F.lit(n), c.cast("string"))))
    out = out.orderBy("session", "path", "start_time", "line").select(
        "*", meta.alias("metadata"), F.lit("iemocap").alias("dataset_name"), F.lit(split).alias("split"), (F.col("end_time") - F.col("start_time")).alias("duration_sec"), F.array("vad").alias("vad_annotations"), _ordinal().alias("ordinal")
    )
    return first_n(unified(out), max_samples, ["ordinal"])


# ---- podcast corpus: partitions, consensus and detailed labels ---------------------------


def parse_partitions(lines: DataFrame, order: list[str], line: str = "value") -> DataFrame:
    """``(utterance_id, partition)``: fields split by ``;``, else ``,``, else white space; the last of several wins."""
    t = strip(line)
    fields = F.when(t.contains(";"), F.split(t, ";")).when(t.contains(","), F.split(t, ",")).otherwise(F.split(t, r"\s+"))
    rows = lines.select(fields.alias("f"), F.struct(*order).alias("o")).where(F.size("f") >= 2)
    rows = rows.select(strip(F.col("f")[0]).alias("utterance_id"), strip(F.col("f")[1]).alias("partition"), "o")
    return rows.groupBy("utterance_id").agg(F.max_by("partition", "o").alias("partition"))


def _alias(df: DataFrame, *names: str, default: str = "") -> Column:
    """The first of the named columns that the file has."""
    held = next((n for n in names if n in df.columns), None)
    return F.coalesce(F.col(f"`{held}`"), F.lit(default)) if held else F.lit(default)


def parse_consensus(df: DataFrame) -> DataFrame:
    """One row per utterance of a consensus label file, whichever of its known headings it has; unreadable numbers are 4."""
    key = F.regexp_replace(strip(_alias(df, "FileName", "filename")), r"\.wav", "")
    score = lambda *n: number_or(_alias(df, *n), 4.0)
    return df.select(
        key.alias("utterance_id"), strip(_alias(df, "EmoClass", "emotion", default="O")).alias("emotion_raw_label"), score("Valence", "valence").alias("valence"), score("Arousal", "arousal").alias("arousal"),
        score("Dominance", "dominance").alias("dominance"), number_or(_alias(df, "NumAnnotators", "n_annotators"), 0.0).cast("int").alias("n_annotators"), strip(_alias(df, "SpkrID", "speaker_id")).alias("speaker_id"), strip(_alias(df, "Gender", "gender")).alias("gender"),
    ).where("utterance_id <> ''").dropDuplicates(["utterance_id"])


def parse_detailed(df: DataFrame, top: float = 7.0, normalize: bool = True) -> DataFrame:
    """``(utterance_id, details)``: the ratings of every person for an utterance."""
    fit = lambda c: rescale(c, top) if normalize else c
    key = F.regexp_replace(strip(_alias(df, "FileName")), r"\.wav", "")
    vad = F.struct(*(fit(number_or(_alias(df, n), 4.0)).alias(n.lower()) for n in ("Valence", "Arousal", "Dominance")), _alias(df, "WorkerID", "annotator").alias("annotator_id"))
    return df.select(key.alias("utterance_id"), vad.alias("vad")).where("utterance_id <> ''").groupBy("utterance_id").agg(F.collect_list("vad").alias("details"))


def rated_labels(annotations: DataFrame, order: list[str], top: float = 7.0, normalize: bool = True) -> DataFrame:
    """``(utterance_id, valence, arousal, dominance, n_annotators)``: mean ratings of every utterance.

    A rating counts if it has a person and its valence and arousal are on the scale; of several
    of a person for an utterance the last by ``order`` counts. Dominance is the mean of the
    counting ratings whose dominance is on the scale.
    """
    on = lambda c: F.col(c).between(1.0, top)
    person = person_name()
    rows = annotations.where(on("valence") & on("arousal") & F.col("utterance_id").isNotNull() & person.isNotNull())
    last = rows.groupBy("utterance_id", person.alias("person")).agg(F.max(F.struct(*order, "valence", "arousal", F.when(on("dominance"), F.col("dominance")).alias("dominance"))).alias("r"))
    fit = lambda c: rescale(c, top) if normalize else c
    return last.groupBy("utterance_id").agg(*(fit(F.avg(f"r.{n}")).alias(n) for n in ("valence", "arousal", "dominance")), F.count("*").alias("n_annotators"))


def podcast_samples(partitions: DataFrame, labels: DataFrame, details: DataFrame | None, split: str = "train", min_annotators: int = 3, normalize: bool = True, top: float = 7.0) -> DataFrame:
    """Partition rows of a split with consensus labels of enough annotators, and all ratings."""
    fit = lambda c: rescale(F.col(c), top) if normalize else F.col(c)
    own = F.struct(fit("valence").alias("valence"), fit("arousal").alias("arousal"), fit("dominance").alias("dominance"), F.lit("consensus").alias("annotator_id"))
    rows = partitions.where(F.col("partition").isin([*PARTITION_SPLITS.get(split, ())])).join(labels.where(F.col("n_annotators") >= min_annotators), "utterance_id")
    rows = rows.join(details, "utterance_id", "left") if details is not None else rows.withColumn("details", F.lit(None).cast(f"array<{VAD}>"))
    return rows.select(
        "*", F.concat(F.array(own), F.coalesce("details", F.array().cast(f"array<{VAD}>"))).alias("vad_annotations"), canonical_label(F.lit("msp_podcast"), F.col("emotion_raw_label")).alias("categorical_emotion"),
        F.create_map(F.lit("n_annotators"), F.col("n_annotators").cast("string"), F.lit("partition"), F.col("partition")).alias("metadata"),
    )


def read_podcast(spark: SparkSession, root: str, split: str = "train", normalize: bool = True, min_annotators: int = 3, detailed: bool = False, max_samples: int | None = None) -> DataFrame:
    """The podcast corpus. Without a partition or label file it is empty."""
    part = paths.first_existing(spark, [f"{root}/{p}" for p in ("Partitions/partition.txt", "Partitions/Partitions.txt", "partition.txt")])
    label = paths.first_existing(spark, [f"{root}/{p}" for p in ("Labels/labels_consensus.csv", "Labels/labels_consensus.tsv", "labels_consensus.csv")])
    if not part or not label:
        return spark.createDataFrame([], SAMPLE)
    read = lambda p: spark.read.csv(p, header=True, sep="\t" if p.endswith(".tsv") else ",")
    more = paths.first_existing(spark, [f"{root}/Labels/labels_detailed.{e}" for e in ("csv", "tsv")]) if detailed else None
    details = parse_detailed(read(more), normalize=normalize) if more else None
    rows = podcast_samples(parse_partitions(_lines(spark, part), ["line"]), parse_consensus(read(label)), details, split, min_annotators, normalize)
    rows = rows.orderBy("utterance_id").select("*", F.lit("msp_podcast").alias("dataset_name"), F.lit(split).alias("split"), F.format_string(f"{root}/Audios/%s.wav", "utterance_id").alias("audio_path"), _ordinal().alias("ordinal"))
    return first_n(unified(rows), max_samples, ["ordinal"])


# ---- multi-party corpus: one CSV of dialogue turns ----------------------------------------


def parse_dialogue_rows(df: DataFrame) -> DataFrame:
    """Typed turns of a dialogue table; rows without whole-number ids are dropped, an absent emotion is neutral."""
    whole = lambda n: F.when(strip(n).rlike(r"^[+-]?[0-9]+$"), strip(n).try_cast("long"))
    text = lambda n, d="": strip(F.coalesce(F.col(n), F.lit(d)))
    raw = F.lower(text("Emotion", "neutral"))
    return df.select(
        whole("Dialogue_ID").alias("dialogue_id"), whole("Utterance_ID").alias("turn"), text("Utterance").alias("transcript"), text("Speaker").alias("speaker_id"), raw.alias("emotion_raw_label"),
        canonical_label(F.lit("meld"), raw).alias("categorical_emotion"), F.lower(text("Sentiment")).alias("sentiment"),
        *(F.coalesce(c, F.lit("")).alias(n) for c, n in (("Season", "season"), ("Episode", "episode"), ("StartTime", "start_time"), ("EndTime", "end_time"))),
    ).where("dialogue_id is not null and turn is not null")


def read_multi_party(spark: SparkSession, root: str, split: str = "train", n_context: int = 3, emotions: list[str] | None = None, require_audio: bool = False, max_samples: int | None = None) -> DataFrame:
    """The multi-party corpus. Filters come after context, so dropped turns still serve as context."""
    folder = f"{root}/{DIALOGUE_DIRS[split]}"
    csv = paths.first_existing(spark, [f"{b}/{n}" for b in (folder, root) for n in DIALOGUE_FILES[split]])
    if not csv:
        return spark.createDataFrame([], SAMPLE)
    rows = parse_dialogue_rows(spark.read.csv(csv, header=True, multiLine=True, quote='"', escape='"'))
    rows = context_turns(rows, "dialogue_id", ["turn"], "speaker_id", "transcript", n_context)
    w = Window.partitionBy("dialogue_id")
    rows = rows.withColumn("n_speakers", F.size(F.collect_set("speaker_id").over(w))).withColumn("length", F.count("*").over(w))
    audio = paths.first_existing(spark, [f"{folder}/{n}" for n in DIALOGUE_AUDIO[split]]) or folder
    name = F.format_string("dia%d_utt%d.wav", "dialogue_id", "turn")
    if paths.exists(spark, audio):
        listed = paths.files(spark, audio, "*.wav").select(F.col("path").alias("audio_path"), F.col("name").alias("wav"))
        rows = rows.withColumn("wav", name).join(listed, "wav", "left").withColumn("audio_path", F.coalesce("audio_path", F.lit("")))
    else:
        rows = rows.withColumn("audio_path", F.lit(""))
    if require_audio:
        rows = rows.where("audio_path <> ''")
    if emotions:
        rows = rows.where(F.col("categorical_emotion").isin(emotions))
    meta = F.create_map(*(x for n in ("dialogue_id", "turn", "season", "episode", "start_time", "end_time", "n_speakers", "length") for x in (F.lit(n), F.col(n).cast("string"))))
    rows = rows.orderBy("dialogue_id", "turn").select("*", meta.alias("metadata"), F.lit("meld").alias("dataset_name"), F.lit(split).alias("split"), F.format_string("meld_dia%d_utt%d", "dialogue_id", "turn").alias("utterance_id"), _ordinal().alias("ordinal"))
    return first_n(unified(rows), max_samples, ["ordinal"])
