"""How the label columns of emotion_samples are read; see :mod:`timbrel.functions.columns`."""

from timbrel.functions.columns import category, outer, speaker_name
from timbrel.functions.columns import corpus_name as corpus
from timbrel.functions.columns import person_name as person
from timbrel.functions.columns import split_name as split

speaker = speaker_name
__all__ = ["category", "corpus", "outer", "person", "speaker", "split"]
