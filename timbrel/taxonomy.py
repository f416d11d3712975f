"""Emotion labels, their corpus codes, corpus splits and the unified schemas."""

from __future__ import annotations

#: Canonical labels.
EMOTIONS = ("neutral", "happy", "sad", "angry", "fear", "disgust", "surprise", "excited", "frustrated", "calm", "other")
#: Label codes of each corpus.
LABELS = {
    "iemocap": {"neu": "neutral", "hap": "happy", "sad": "sad", "ang": "angry", "fru": "frustrated", "exc": "excited", "fea": "fear", "sur": "surprise", "dis": "disgust", "oth": "other", "xxx": "other"},
    "msp_podcast": {"N": "neutral", "H": "happy", "S": "sad", "A": "angry", "D": "disgust", "F": "fear", "U": "surprise", "C": "calm", "O": "other"},
    "ravdess": {"01": "neutral", "02": "calm", "03": "happy", "04": "sad", "05": "angry", "06": "fear", "07": "disgust", "08": "surprise"},
    "meld": {"neutral": "neutral", "joy": "happy", "sadness": "sad", "anger": "angry", "fear": "fear", "disgust": "disgust", "surprise": "surprise"},
}
#: Corpora by their names without case and separators, split names, and what stands for an unknown speaker.
CORPORA = {"iemocap": "iemocap", "meld": "meld", "msppodcast": "msp_podcast", "ravdess": "ravdess"}
SPLITS = {"train": "train", "val": "val", "validation": "val", "dev": "val", "development": "val", "test": "test", "test1": "test", "test2": "test"}
NO_SPEAKER = ["", "unknown", "n/a"]
#: What the file-name codes of the acted corpus stand for.
STATEMENTS = {"01": "Kids are talking by the door.", "02": "Dogs are sitting by the door."}
INTENSITIES = {"01": "normal", "02": "strong"}
#: Corpus splits.
ACTOR_SPLITS = {"train": range(1, 21), "val": (21, 22), "test": (23, 24)}
SESSION_SPLITS = {"train": (1, 2, 3, 4), "val": (5,), "test": (5,)}
PARTITION_SPLITS = {"train": ("Train",), "val": ("Validation", "Development"), "test": ("Test1", "Test2", "Test")}
DIALOGUE_FILES = {"train": ("train_sent_emo.csv", "train.csv"), "val": ("dev_sent_emo.csv", "dev.csv"), "test": ("test_sent_emo.csv", "test.csv")}
DIALOGUE_DIRS = {"train": "train", "val": "dev", "test": "test"}
DIALOGUE_AUDIO = {"train": ("train_splits", "train_audio", "audio"), "val": ("dev_splits_complete", "dev_splits", "dev_audio"), "test": ("test_splits_complete", "test_splits", "test_audio")}

VAD = "struct<valence:double,arousal:double,dominance:double,annotator_id:string>"
#: The unified utterance schema that every corpus reader returns; ``ordinal`` keeps the corpus' order.
SAMPLE = (
    "ordinal long, utterance_id string, dataset_name string, split string, audio_path string, sample_rate int, duration_sec double, "
    "speaker_id string, gender string, transcript string, context_turns array<string>, categorical_emotion string, "
    f"emotion_raw_label string, vad_annotations array<{VAD}>, sentiment string, emotion_intensity string, metadata map<string,string>"
)
#: Scalar features of an utterance, in order.
SCALARS = (
    "pitch_level_mean", "pitch_variation_mean", "pitch_slope_mean", "intensity_level_mean", "intensity_variation_mean", "duration_mean",
    "jitter", "shimmer", "hnr", "spectral_tilt", "speech_rate", "speech_rate_variation", "pause_duration_mean", "pause_frequency",
    "f1_mean", "f2_mean", "vowel_space_area",
)
BINS = ("very_low", "low", "medium", "high", "very_high")
