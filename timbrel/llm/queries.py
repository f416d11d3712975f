"""Named queries of the training-data operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from timbrel.llm import consensus, conversations, defects, leakage, overlaps, sampling, spans, splitting, tokens
from timbrel.llm.sql import SQL
from timbrel.session import table


def p1_found(spark, sf_dir):
    bad = conversations.broken_conversations(table(spark, sf_dir, "meld_utterances"), table(spark, sf_dir, "emotion_samples"))
    return bad.select(F.col("conv").alias("dialogue_id")).distinct()


def p1_reasons(spark, sf_dir):
    bad = conversations.broken_conversations(table(spark, sf_dir, "meld_utterances"), table(spark, sf_dir, "emotion_samples"))
    return bad.select(F.col("conv").alias("dialogue_id"), "reason")


def p1_conversations(spark, sf_dir):
    return conversations.conversations(table(spark, sf_dir, "meld_utterances"), table(spark, sf_dir, "emotion_samples"))


def p1_assembled(spark, sf_dir):
    """Conversations of the dialogue corpus' records out of what they quote, identifiers unseen."""
    return conversations.assemble_quoting(table(spark, sf_dir, "emotion_samples"))


def p2_found(spark, sf_dir):
    """Pairs that the repaired sample leaves short, as all their records are drawn and do not do."""
    return p2_report(spark, sf_dir).where("cause = 'records'").select("dataset_name", "categorical_emotion")


def p2_report(spark, sf_dir):
    return sampling.report(table(spark, sf_dir, "emotion_samples"), table(spark, sf_dir, "target_shares"))


def p2_sample(spark, sf_dir):
    return sampling.draw(table(spark, sf_dir, "emotion_samples"), table(spark, sf_dir, "target_shares"))


def p3_found(spark, sf_dir):
    return overlaps.overlap_pairs(overlaps.overlaps(table(spark, sf_dir, "emotion_samples")))


def p3_files(spark, sf_dir):
    """Records of audio files that stand in training and held-out splits alike: their file class and its records on the other side."""
    found = overlaps.file_classes(overlaps.records(table(spark, sf_dir, "emotion_samples")))
    return found.select("sample_id", F.col("corpus").alias("dataset_name"), "file", "n_links").distinct()


def p3_report(spark, sf_dir):
    return overlaps.overlap_report(table(spark, sf_dir, "emotion_samples"))


def p4_found(spark, sf_dir):
    return defects.first_defect(p4_all_types(spark, sf_dir))


def p4_all_types(spark, sf_dir):
    return defects.answer_defects(table(spark, sf_dir, "cot_samples"), table(spark, sf_dir, "inference_results"))


def p5_found(spark, sf_dir):
    return splitting.torn_speakers(table(spark, sf_dir, "emotion_samples")).select("dataset_name", "speaker_id")


def p5_split(spark, sf_dir):
    return splitting.assign(table(spark, sf_dir, "emotion_samples"), table(spark, sf_dir, "split_targets"))


def p5_split_linked(spark, sf_dir):
    """As p5_split, but records of one audio file are related too."""
    return splitting.assign(table(spark, sf_dir, "emotion_samples"), table(spark, sf_dir, "split_targets"), ["spelling", "speaker", "file"])


def p5_report(spark, sf_dir):
    targets = table(spark, sf_dir, "split_targets")
    return splitting.split_report(splitting.assign(table(spark, sf_dir, "emotion_samples"), targets), targets)


def p7_found(spark, sf_dir):
    return consensus.unreliable(consensus.agreement(table(spark, sf_dir, "vad_annotations")))


def p7_agreement(spark, sf_dir):
    """Every person's correlations with the others, out of the first product of the agreement matrix."""
    r = consensus.agreement(table(spark, sf_dir, "vad_annotations"))
    return r.select("annotator_id", "n_shared", *(F.round(c, 6).alias(c) for c in ("r_valence", "r_arousal")))


def p7_reliability(spark, sf_dir):
    r = consensus.reliability(table(spark, sf_dir, "vad_annotations"))
    return r.select("annotator_id", "n_shared", *(F.round(c, 6).alias(c) for c in ("r_valence", "r_arousal", "reliability")))


def p7_consensus(spark, sf_dir):
    return consensus.consensus(table(spark, sf_dir, "vad_annotations"))


def p8_ids(spark, sf_dir):
    return tokens.encode(table(spark, sf_dir, "documents"))


def p8_round_trip(spark, sf_dir):
    """Every text decoded from its ids."""
    return tokens.decode(tokens.encode(table(spark, sf_dir, "documents")))


def p8_offsets(spark, sf_dir):
    """Token ids of each document, and the code points that each token touches."""
    return tokens.encode_with_offsets(table(spark, sf_dir, "documents"))


def p9_found(spark, sf_dir):
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_report(spark, sf_dir):
    items = table(spark, sf_dir, "eval_items")
    return leakage.leak_report(leakage.find_leaks(table(spark, sf_dir, "documents"), items), items)


def p10_found(spark, sf_dir):
    return spans.document_pairs(table(spark, sf_dir, "documents"))


def p10_shared(spark, sf_dir):
    return spans.shared_share(table(spark, sf_dir, "documents"))


_ALL = (p1_found, p1_reasons, p1_conversations, p1_assembled, p2_found, p2_report, p2_sample, p3_found, p3_files, p3_report, p4_found, p4_all_types, p5_found, p5_split, p5_split_linked, p5_report, p7_found, p7_agreement, p7_reliability, p7_consensus, p8_ids, p8_round_trip, p8_offsets, p9_found, p9_report, p10_found, p10_shared)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return SQL
