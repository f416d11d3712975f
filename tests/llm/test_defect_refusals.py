import pytest

from timbrel.llm import defects as D

ASK = "Rate how well the voice carries the feeling of this line."
WHY = " ".join(["The recording holds the voice of a person whose state of mind nobody outside the room can know from a sound file alone."] * 6)
SEEN = " ".join(["The pitch falls over the second half and the breath stays audible while the pauses grow longer."] * 7)


@pytest.mark.parametrize(
    "text",
    [
        "I must decline to rate this clip. " + WHY, WHY + " For this reason I cannot rate the clip.", "Hello! I am unable to assess the clip on a scale of 1 to 5. " + WHY, "I can't judge whether the tone fits the line. " + WHY,
        "I must decline. Scores from 1 to 5 need a listener. " + WHY, "Es tut mir leid, aber ich kann diese Aufnahme nicht bewerten. " + WHY, "Prefiero no responder a esta petición. " + WHY, "Je refuse cette demande. " + WHY,
        "I cannot rate the breath. I rate the tone 3 of 5, and then I must decline the rest of the task. " + WHY,
    ],
)
def test_refusal_of_any_length(text):
    assert len(D.words(text)) > 80 and "refusal" in D.field_defects(text, None, False)


@pytest.mark.parametrize(
    "text",
    [
        SEEN + " I cannot assess the room noise, but the tone fits the sad line.", "I cannot judge the breath at the start. " + SEEN + " This fits the sad line.", "I am unable to rate the shimmer. " + SEEN + " I rate the line 3.5 of 5.",
        SEEN + " I cannot hear any tremor in the question at the end.", "I cannot assess the room noise, but the tone fits the sad line.",
    ],
)
def test_details_declined_before_a_verdict(text):
    assert "refusal" not in D.field_defects(text, ASK, False)
