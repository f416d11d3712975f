import pytest

from timbrel.llm import defects as D

ASK = 'Rate how well the voice carries the feeling of this line.\nLine: "Not again, said the tired old painter."\nVoice measures: pause count 124 (medium), breath noise 235 (low)'
SOUND = "The pitch falls near the end, and this fits the sad reading of the line."
SCORES = "\n".join(f"d{i}: 3.5" for i in range(7))


def whole(reasoning, scores=SCORES):
    return f"[EVIDENCE]\n## Valence Accuracy\nDetected Cues: a held pause\nIssues: N/A\n\n[REASONING]\n{reasoning}\n\n[SCORES]\n{scores}"


@pytest.mark.parametrize("text", [None, "", "  \n", "N/A", "null", "...", "-", "[]", "​", "[EVIDENCE]\n\n[REASONING]\n\n[SCORES]\n", "## Valence Accuracy\nIssues: N/A", "TODO"])
def test_empty(text):
    assert D.field_defects(text, ASK, False) == {"empty"} and D.field_defects(text, ASK, True) == {"empty"}


@pytest.mark.parametrize(
    "text",
    [
        "I'm sorry, but I can't rate this clip.", "Hello! It would not be appropriate for me to judge how this person feels.", "You asked about the jitter of this clip. I must decline the request.",
        "As a text model I have no way to listen to the audio; please ask a human rater instead.", "Es tut mir leid, aber ich kann diese Aufnahme nicht bewerten.", "Ich möchte diese Bewertung nicht vornehmen und bitte um Verständnis.",
        "Lo siento, pero no puedo evaluar esta grabación.", "Prefiero no responder a esta petición de puntuación.", "Je suis désolé, mais je ne peux pas évaluer cet enregistrement.", "Je préfère ne pas répondre à cette demande de notation.",
        "Unfortunately I am unable to assess the shimmer here, so no scores will be given.", "There is nothing I can offer on this clip; evaluation of voices is not a service I provide. Is there anything else you need?",
    ],
)
def test_refusal(text):
    assert "refusal" in D.field_defects(text, None, False)


@pytest.mark.parametrize(
    "text",
    [
        SOUND, "Sorry as the words may sound, the creak is lively.", "I cannot hear any tremor in the question at the end, and no sign of strain either.", "The speaker is unable to hide an audible sigh!",
        'The line "I cannot rate this" is spoken in a calm way, and the pitch fits it.', 'The tone is flat. One listener wrote: "Se oye en la segunda mitad que la voz resulta alegre, y el aliento suena triste."', "- The pitch rises.\n- The tone fits.", "Flat delivery, calm fits.",
        'The line "Not again, said the tired old painter." is spoken in a angry way.',
    ],
)
def test_sound_answers(text):
    assert D.field_defects(text, ASK, False) == set() and D.field_defects(whole(text), ASK, True) == set()


@pytest.mark.parametrize("text", [ASK, "> " + ASK, "You asked: " + ASK, ASK.lower().replace("\n", " "), ASK + "\nRate how well the voice carries the feeling of this line.", ASK.split("\n", 1)[1]])
def test_copy(text):
    assert "copy" in D.field_defects(text, ASK, False) and "copy" in D.field_defects(whole(text), ASK, True)


def test_language():
    de = "Die Stimme klingt während der langen Pause ruhig, und der Atem wird am Ende noch immer müde."
    assert D.field_defects(de, ASK, False) == {"language"}
    assert D.field_defects(de, "Bewerte, wie gut die Stimme das Gefühl dieser Zeile trägt, und begründe die Wertung auf Deutsch.", False) == set()
    assert D.field_defects("声音很平静，语气合适。", ASK, False) == {"language"}
    assert D.field_defects(de, None, False) == D.field_defects(de, " ", False) == set()


def test_truncated():
    assert D.field_defects(SOUND[:-12], ASK, False) == {"truncated"}
    assert D.field_defects(whole(SOUND, "d0: 3.5\nd1:"), ASK, True) == {"truncated"}
    assert D.field_defects(whole(SOUND).split("[SCORES]")[0] + "[SCO", ASK, True) == {"truncated"}
    assert D.field_defects('The tone falls after "the sturdy.', ASK, False) == {"truncated"}


def test_tables(spark):
    cot = spark.createDataFrame([(1, ASK, SOUND, whole(SOUND), "x"), (2, ASK, None, whole(SOUND[:-9]), "x"), (2, ASK, None, whole(SOUND[:-9]), "x"), (3, None, SOUND, whole(SOUND + " word." * 50_000), "x")], "cot_id long, prompt string, reasoning string, target_output string, defect string")
    inf = spark.createDataFrame([(1, ASK, ASK)], "result_id long, prompt string, reasoning string")
    every = D.answer_defects(cot, inf)
    assert {tuple(r)[:3] for r in every.collect()} == {("cot_samples", 2, "empty"), ("cot_samples", 2, "truncated"), ("inference_results", 1, "copy"), ("inference_results", 1, "truncated")}
    assert {tuple(r) for r in D.first_defect(every).collect()} == {("cot_samples", 2, "empty"), ("inference_results", 1, "copy")}
    assert D.answer_defects(cot.limit(0), inf.limit(0)).count() == 0
