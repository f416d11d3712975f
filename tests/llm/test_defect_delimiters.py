import pytest

from timbrel.llm import defects as D

ASK = "Rate how well the voice carries the feeling of this line."
SCORES = "\n".join(f"d{i}: 3.5" for i in range(7))


def whole(reasoning, cue="a held pause"):
    return f"[EVIDENCE]\n## Valence Accuracy\nDetected Cues: {cue}\nIssues: N/A\n\n[REASONING]\n{reasoning}\n\n[SCORES]\n{SCORES}"


@pytest.mark.parametrize(
    "text",
    [
        "The tone falls (the voice drops at the end.", "The tone falls [the voice drops at the end.", "The tone falls {the voice drops at the end.", "The tone falls （the voice drops at the end.",
        "The line “not again is calm. The tone falls.", "The line „not again is calm. The tone falls.", "The line «not again is calm. The tone falls.", "The line »not again is calm. The tone falls.",
        "The tone falls.\n```\npitch = 3\nThe voice drops.", "The tone falls.\n~~~\npitch = 3\nThe voice drops.", "The tone (which is [low) falls.", "(The tone falls. The voice drops. It is calm and even. Nothing else is heard.",
    ],
)
def test_unclosed(text):
    assert D.field_defects(text, ASK, False) == {"truncated"} and D.field_defects(whole(text), ASK, True) == {"truncated"}


def test_unclosed_in_the_evidence():
    assert D.field_defects(whole("The tone falls.", "a pause (held"), ASK, True) == {"truncated"}


@pytest.mark.parametrize(
    "text",
    [
        "The tone (the [low] {voice}) falls.", "Two points: a) the tone falls. b) It is calm.", "The tone is bright :( and falls.", "The pitch is in [0, 5) and falls.", "The line “not again” and «no» and „so“ and »yes« falls.",
        "The line “not again (he said” falls.", "“The tone falls.\n“It is calm.”", "```\nf(x\n```\nThe tone falls.", "The mark `(` is heard.", "The tone falls ] here.",
    ],
)
def test_closed(text):
    assert D.field_defects(text, ASK, False) == set() and D.field_defects(whole(text), ASK, True) == set()
