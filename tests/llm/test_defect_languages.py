import pytest

from timbrel.llm import defects as D

EN = "Rate how well the voice carries the feeling of this line.\nLine: \"Not again.\""


@pytest.mark.parametrize(
    "prompt",
    [
        "请根据录音评价说话人的语气，并说明理由。", "Оцените, насколько голос передаёт чувство этой фразы.", "Line: \"Not again.\"\nBewerte, wie gut die Stimme das Gefühl dieser Zeile trägt, und begründe die Wertung.",
        "Hinweis: kurz.\n\nBitte höre dir die Aufnahme an.\nBewerte, wie gut die Stimme das Gefühl dieser Zeile trägt, und begründe das.",
    ],
)
def test_english_answers_to_prompts_of_other_languages(prompt):
    assert D.field_defects("The pitch falls near the end, and this fits the sad reading of the line.", prompt, False) == {"language"}


@pytest.mark.parametrize(
    "text", ["Il tono della voce è calmo e non si alza, il che si adatta alla tristezza della frase.", "A voz não sobe e o tom é calmo, o que combina com a tristeza da frase.", "Het tempo van de stem is laag en dat past niet bij het gevoel van deze zin.", "Голос звучит спокойно."]
)
def test_other_answers_to_english_prompts(text):
    assert D.field_defects(text, EN, False) == {"language"}


@pytest.mark.parametrize("text", ["Mi dispiace, ma non posso valutare questa registrazione.", "Lamento, mas não posso avaliar esta gravação.", "Het spijt me, maar ik kan deze opname niet beoordelen.", "抱歉，我无法对这段录音进行评分。"])
def test_refusals_of_further_languages(text):
    assert "refusal" in D.field_defects(text, None, False)


@pytest.mark.parametrize(
    "text",
    ["The speaker says he is unable to help the caller.", "The man tells her that I cannot help him, and his voice drops.", "This speaker is not able to rate her own mood, so the tone wavers.", "He sounds unable to answer the question at the end."],
)
def test_reported_speech_is_no_refusal(text):
    assert D.field_defects(text, EN, False) == set()


def test_a_refusal_beside_reported_speech_counts():
    assert D.field_defects("The speaker says he is unable to help. I am unable to rate that.", EN, False) == {"refusal"}
