"""Problem 4: prompt and answer pairs that are broken, with every type of defect found.

Rules in order: ``empty``, ``refusal``, ``copy``, ``language``, ``truncated``. Each field of an
answer is looked at by itself; a sectioned field by its reasoning section, and a score
section must reach its last score. All rules that trigger are returned; the first is
the answer's type.

* ``empty``: nothing but headings, labels and placeholders.
* ``refusal``: a sentence outside quotations in which the writer, not one reported of,
  declines, in English, German, Spanish, French, Italian, Portuguese, Dutch or Chinese, at any
  length of the field, unless a rating or verdict follows: what was declined then was a detail.
* ``copy``: the words are those of the prompt, at least half of it, with next to
  nothing added.
* ``language``: most function words are of another language (of those but Chinese) than the
  prompt's instruction, which is all of the prompt but quotations and labelled lines, or if that
  is too short for a language all but quotations; else most letters are of another script.
  Quotations, headings and score lines of the answer are left out.
* ``truncated``: the text ends without the end of a sentence, an opened quotation,
  bracket or code fence is not closed anywhere in the field, or scores are missing.

Defined cases: a null field is empty; with a null or blank prompt neither ``copy`` nor
``language`` can hold; a repeated record comes out once per type; an empty table gives
an empty result; whole texts are read, whatever their length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.llm.words import words

ORDER = ("empty", "refusal", "copy", "language", "truncated")
SCORES = 7

#: What stands for no answer.
PLACEHOLDERS = {"n/a", "na", "n.a.", "null", "none", "nil", "nan", "tbd", "todo", "empty", "blank", "undefined", "unknown", "no answer", "not available", "placeholder", "string", "text"}

#: Function words that mark one of the four languages among them.
FUNCTION_WORDS = {
    "en": "the of and is are was were that this with which there it its an on for to but not near into would over while a in by who what how we hear".split(),
    "de": "der die das und ist sind war dass mit nicht ein eine einen dem den des wird bleibt klingt wirkt noch immer auf im am zu aber weil während man wir hört wie gut sondern dort eher obwohl sodass und um bei".split(),
    "es": "el los las y es que con una un del se por para más pero como mientras aunque porque muy todavía está queda resulta suena oye creemos hacia durante poco antes sino toda parece vuelve modo".split(),
    "fr": "le les des et est que avec une un du se pour plus mais comme tandis dans sur nous pensons reste devient semble paraît encore au aux pendant avant après demeure ne pas alors si bien parce qu entend l".split(),
}
#: Words that mark a further language and are not among those above.
FURTHER_WORDS = {
    "it": "il lo gli di che è non sono della dello delle nella nel questa questo anche più molto alla allo perché dal dalla come ed degli sul sulla".split(),
    "pt": "não uma com do da dos das ao à pelo pela mais muito é são também isso esta seu numa num mas ou nos às".split(),
    "nl": "het een van niet dat met op zijn wordt maar ook naar bij deze dit voor aan door heel nog waarin klinkt omdat".split(),
}
_LANGUAGE = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _w in _list:
        _LANGUAGE.setdefault(_w, set()).add(_lang)
for _lang, _list in FURTHER_WORDS.items():
    for _w in _list:
        if not any(x in FUNCTION_WORDS for x in _LANGUAGE.get(_w, ())):
            _LANGUAGE.setdefault(_w, set()).add(_lang)
#: Words of one language only.
_LANGUAGE = {w: next(iter(x)) for w, x in _LANGUAGE.items() if len(x) == 1}

_QUOTED = re.compile(r'"[^"\n]*"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]')
_HEADING = re.compile(r"^\s*(?:\[[A-Za-z _]*\]?|#{1,6}\s.*)\s*$", re.M)
_LABEL = re.compile(r"^\s*(?:Detected Cues|Issues|Strengths|Emotional Context|Alignment Assessment)\s*:", re.M)
_SCORE = re.compile(r"^\s*[-*\d.]*\s*\w+\s*:\s*-?\d+(?:\.\d*)?\s*$", re.M)
_SCORE_NAME = re.compile(r"^\s*\w+\s*:\s*$", re.M)
_REASONING = re.compile(r"^\[REASONING\]\s*$(.*?)(?=^\[(?:S(?:C(?:O(?:R(?:E(?:S\]?)?)?)?)?)?)?\s*$|\Z)", re.M | re.S)
_MARKS = re.compile(r"^[\s>*\-•]+", re.M)
_FENCE = re.compile(r"^[ \t>*\-•]*(`{3,}|~{3,})", re.M)
_CODE = re.compile(r"`[^`\n]+`")
#: Not brackets: smileys and half-open intervals.
_NO_BRACKET = re.compile(r"[:;=]['’]?-?[(\[{]|[\[\](]\s*[-+]?\d[\d.]*\s*[,;]\s*[-+]?\d[\d.]*\s*[\])\[]")
_CLOSES = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "「": "」", "『": "』", "《": "》", "“": "”", "„": "“”", "«": "»", "»": "«"}
_DELIMITER = re.compile(r"[()\[\]{}（）【】「」『』《》“”„«»]")
_END = re.compile(r"""[.!?…。！？]["'”»’)\]]*\s*$""")

# What is declined (to judge, answer, ...) and by which turn of phrase; whole words, quotations removed.
_TASK = r"(?:rat(?:e|ing)|scor(?:e|es|ing)|assess(?:ment|ing)?|evaluat(?:e|ion|ing)|judg(?:e|ing|e?ment)|answer(?:ing)?|comment(?:ing)?|help(?:ing)?|provide|assist|respond|analy[sz]e|infer(?:ring)?|grade|opinion)"
_ENGLISH = [
    rf"\bI(?: am|'m)? ?(?:cannot|can't|can not|could not|couldn't|won't|will not|do not|don't|am unable to|'m unable to|unable to|not able to|am not able to|'m not able to)(?: be able to)?(?: \w+){{0,3}} {_TASK}\b",
    rf"\b(?:not (?:be )?able|unable) to (?:\w+ ){{0,2}}{_TASK}\b",
    r"\bI(?:'d| would| must| have to| need to)? ?(?:rather not|prefer not|decline|refuse|pass on)\b",
    rf"\bI must (?:\w+ )?(?:decline|refuse)\b|\b(?:not|no) (?:be )?appropriate for me to {_TASK}\b",
    rf"\bno (?:{_TASK}|ratings|scores) (?:is|are|will be|can be)(?: \w+)? ?(?:possible|given|provided|available)?\b",
    rf"\b{_TASK}(?: \w+)? (?:has|have) been (?:skipped|omitted|declined|withheld)\b",
    r"\b(?:no way|not possible for me|impossible for me) to (?:listen|hear|judge|rate|know|assess)\b",
    r"\bgoes beyond what I\b|\b(?:outside|beyond) (?:of )?my (?:remit|scope|abilities|capabilities)\b",
    r"\bnot for me to (?:say|judge|rate|decide)\b|\bleave the (?:scores|fields|ratings?)\b",
    r"\bnot a (?:service|task|thing) I (?:provide|offer|do)\b|\bnothing I can (?:offer|say|do|provide)\b",
    r"\bcontent I (?:don't|do not|cannot|can't) \w+\b|\bdo not answer such\b|\bI do not answer\b",
    rf"\b(?:guidelines|policy|policies|rules|instructions) (?:do not|don't|does not|doesn't|forbid|prohibit|prevent)\b",
    r"\bask a human rater\b|\bsomething I(?:'d| would) (?:rather|prefer) not\b",
]
_GERMAN = [
    r"\b(?:kann|darf|möchte|will|werde|könnte) (?:ich )?(?:\w+ ){0,8}(?:nicht|keine?n?) (?:\w+ ){0,3}(?:bewerten|beurteilen|einschätzen|vornehmen|abgeben|beantworten|einschätzung|bewertung|geben|helfen)\b",
    r"\bich lehne\b|\bes tut mir leid\b.*\bnicht\b|\bbitte um verständnis\b|\bnicht in der lage\b.*\b(?:bewerten|beurteilen)\b",
]
_SPANISH = [
    r"\bno (?:puedo|podré|podría|quiero|debo|es posible|me es posible|me está permitido|se me permite)\b(?: \w+){0,3} (?:evaluar|calificar|puntuar|opinar|juzgar|responder|valorar|ayudar|dar)\b",
    r"\bprefiero no (?:responder|evaluar|opinar|contestar|juzgar|puntuar|calificar)\b|\bme niego a\b",
]
_FRENCH = [
    r"\bje ne (?:peux|puis|suis|veux|souhaite|saurais|pourrai|dois)\b(?: pas)?(?: \w+){0,4} (?:évaluer|noter|juger|répondre|commenter|aider|donner)\b",
    r"\bne m'est pas (?:permis|possible)\b|\bje préfère ne pas\b|\bje refuse\b",
]
_ITALIAN = [
    r"\bnon (?:posso|potrei|voglio|intendo|riesco a|mi è possibile|sono in grado di)\b(?: \w+){0,4} (?:valutare|giudicare|rispondere|assegnare|commentare|aiutar\w*|dare|esprimere)\b|\bpreferisco non\b|\bmi rifiuto\b",
]
_PORTUGUESE = [
    r"\bnão (?:posso|consigo|vou|quero|devo|me é possível)\b(?: \w+){0,4} (?:avaliar|julgar|responder|pontuar|comentar|ajudar|dar)\b|\bprefiro não\b|\brecuso-me\b|\bme recuso\b",
]
_DUTCH = [
    r"\bik (?:kan|mag|wil|zal)\b(?: \w+){0,6} (?:niet|geen)\b(?: \w+){0,3} (?:beoordelen|beantwoorden|geven|helpen|inschatten)\b|\bik weiger\b",
]
_CHINESE = [
    r"(?:无法|不能|不便|拒绝|不予)[^。！？\n]{0,12}(?:评分|评价|回答|判断|评估|打分)",
]
#: Each language's phrases, with parts of which every phrase has one, so that most texts need no search.
_REFUSALS = [
    (parts.split("|"), re.compile("|".join(f"(?:{x})" for x in phrases), re.I))
    for parts, phrases in (
        ("not|n't|unable|decline|refuse|pass on|appropriate|no |been |impossible|beyond|outside|leave the|nothing|content i|answer|guidelines|polic|rules|instructions|human rater|something i", _ENGLISH),
        ("kann|darf|möchte|will|werde|könnte|ich lehne|leid|verständnis|in der lage", _GERMAN), ("no |prefiero no|me niego", _SPANISH), ("je ne|m'est pas|je préfère|je refuse", _FRENCH),
        ("non|mi rifiuto", _ITALIAN), ("não |recus", _PORTUGUESE), ("ik ", _DUTCH), ("无法|不能|不便|拒绝|不予", _CHINESE),
    )
]
#: What turns a clause into something told of another, or of what another says.
_REPORTED = re.compile(
    r"\b(?:he|she|they|who|(?:the|this|that|a|his|her) (?:\w+ )?(?:speaker|caller|voice|actor|actress|man|woman|person|listener|narrator|character))(?:'s)?\b"
    r"|\b(?:says?|said|claims?|claimed|tells?|told|states?|replie[sd]|sagt|meint|behauptet|dice|dijo|afirma|dit|affirme)\b",
    re.I,
)
_FIRST_PERSON = re.compile(r"\b(?:I|I'm|me|my|we|our)\b", re.I)
_SAYING = re.compile(r"\b(?:says?|said|claims?|claimed|tells?|told|states?|replie[sd]|sagt|meint|behauptet|dice|dijo|afirma|dit|affirme)\b(?: (?:to )?(?:him|her|me|us|them|(?:the|a) \w+))?(?:,? (?:that|dass|que))?\W*$", re.I)
_SENTENCE = re.compile(r"[.!?;\n。！？]")
# What a writer who does rate says after declining a detail: a number, or that the voice fits or fails to.
_SCALE = re.compile(r"\b[0-7]\s*(?:to|-|–|bis|a|à|and|und|y|et)\s*\d\b", re.I)
_VERDICT = re.compile(
    r"\b(?:rat(?:e|ed|es|ing)|scor(?:e|es|ed|ing)|grade[ds]?|marks?|bewerte\w*|wertung|note[zr]?|punt\w+|califi\w+)\b\W+(?:\w+\W+){0,5}?[0-7](?:[.,]\d+)?\b|\b[0-7](?:[.,]\d+)?\s*(?:/|out of|von|de|sur)\s*[57]\b"
    r"|\b(?:fits?|suits?|matches|match|agrees?|corresponds?|passt|passen|entspricht|encaja|concuerda|corresponde|convient|correspond)\b",
    re.I,
)
#: Clauses with these assert nothing.
_HEDGE = re.compile(r"\b(?:whether|if|unless|would|could|might|nicht|keine?n?|ob|wenn|würde|könnte|ni|si|sin|podría|pas|sans|pourrait)\b|\b(?:cannot|can't|won't|unable)\b|\bno (?:ratings?|scores?|grades?|marks?)\b|\bhow (?:well|far|much)\b", re.I)
_CLAUSE = re.compile(r"[!?;\n]+|\.(?!\d)")


def _plain(text: str) -> str:
    """Text without headings, labels and score lines."""
    return _LABEL.sub("", _SCORE.sub("", _HEADING.sub("", text)))


def _is_empty(text: str | None) -> bool:
    if text is None:
        return True
    for line in _plain(text).splitlines():
        line = line.strip().strip("​‌‍⁠﻿­").strip()
        if line and line.lower() not in PLACEHOLDERS and any(c.isalnum() for c in line) and not _SCORE_NAME.match(line):
            return False
    return True


def language(tokens: list[str]) -> str | None:
    """One of the seven languages, by at least three function words and a clear lead; else None."""
    count: dict[str, int] = {}
    for x in map(_LANGUAGE.get, tokens):
        if x:
            count[x] = count.get(x, 0) + 1
    if not count:
        return None
    best, n = max(count.items(), key=lambda x: x[1])
    return best if n >= 3 and n >= 1.5 * (sum(count.values()) - n) else None


def script(text: str) -> str | None:
    """The script of most letters, by the first word of their Unicode names; None without letters."""
    count: dict[str, int] = {}
    for c in text:
        if c.isalpha():
            s = "LATIN" if c < "ʰ" else unicodedata.name(c, "?").split(" ")[0]
            count[s] = count.get(s, 0) + 1
    return max(count, key=count.get) if count else None


#: Lines that are material of a prompt and not its instruction.
_MATERIAL = re.compile(r"^\s*\w[\w ]{0,30}:.*$", re.M)


class Prompt:
    """What the rules need of a prompt, worked out once for all fields of its answer."""

    def __init__(self, text: str | None):
        self.text = text if text and text.strip() else ""
        said = _QUOTED.sub(" ", self.text)
        instruction = _MATERIAL.sub("", said)
        self.words = words(self.text)
        self.known = set(self.words)
        self.language = language(words(instruction)) or language(words(said))
        self.script = script(instruction) or script(said)
        self._runs: set | None = None

    @property
    def runs(self) -> set:
        if self._runs is None:
            w = self.words
            self._runs = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        return self._runs


def _is_copy(answer: list[str], prompt: Prompt) -> bool:
    """Whether nearly all words of the answer stand in three-word runs of the prompt, and half of the prompt in it."""
    if len(answer) < 3 or len(prompt.words) < 3:
        return False
    most = max(4, len(answer) // 20)
    strange = 0
    for w in answer:  # a word that the prompt lacks is in no run of it
        if w not in prompt.known:
            strange += 1
            if strange > most:
                return False
    own = [True] * len(answer)
    got = set()
    for i in range(len(answer) - 2):
        g = tuple(answer[i : i + 3])
        if g in prompt.runs:
            own[i] = own[i + 1] = own[i + 2] = False
            got.add(g)
    added = sum(own)
    return added <= most and added < len(answer) // 2 and 2 * len(got) >= len(prompt.runs)


def _is_reported(text: str, found: re.Match) -> bool:
    """Whether what declines is told of another: no first person does it, or it follows a verb of saying."""
    start = max((m.end() for m in _SENTENCE.finditer(text, 0, found.start())), default=0)
    before = text[start : found.start()]
    return bool(_SAYING.search(before)) or bool(_REPORTED.search(before)) and not _FIRST_PERSON.search(before + found.group())


def _refuses(text: str) -> bool:
    """Whether the writer declines in some sentence and neither rates nor judges after the last such one."""
    last, low = None, text.lower()
    for parts, phrases in _REFUSALS:
        if any(x in low for x in parts):
            for found in phrases.finditer(text):
                if (last is None or found.end() > last.end()) and not _is_reported(text, found):
                    last = found
    if last is None:
        return False
    return not any(_VERDICT.search(_SCALE.sub(" ", x)) and not _HEDGE.search(x) for x in _CLAUSE.split(text[last.end() :]))


def _closes_fences(text: str) -> tuple[bool, str]:
    """Whether every code fence is closed, and the text without fenced and inline code."""
    out, mark = [], None
    for line in text.splitlines():
        found = _FENCE.match(line)
        if found and mark is None:
            mark = found.group(1)
        elif found and found.group(1).startswith(mark):
            mark = None
        elif mark is None:
            out.append(line)
    return mark is None, _CODE.sub(" ", "\n".join(out))


def _open_delimiters(text: str) -> bool:
    """Whether a bracket or paired quotation mark is opened and never closed; closing ones alone do not count."""
    stack = []
    for m in _DELIMITER.finditer(_NO_BRACKET.sub(" ", text)):
        c, at, within = m.group(), m.start(), m.string
        held = next((i for i in range(len(stack) - 1, -1, -1) if c in _CLOSES[stack[i]]), None)
        if held is not None:
            del stack[held]
        elif c == "»":  # opens where it stands before a word
            if (not at or within[at - 1].isspace() or within[at - 1] in "(„“") and within[at + 1 : at + 2].isalnum():
                stack.append(c)
        elif c == "“" and "“" in stack and (not at or within[at - 1] == "\n"):
            continue  # a quotation opens anew at each of its paragraphs
        elif c in _CLOSES:
            stack.append(c)
    return bool(stack)


def _is_open(text: str) -> bool:
    """Whether a fence, bracket or quotation of the text is not closed; what stands within quotations is not the writer's."""
    closed, prose = _closes_fences(text) if "`" in text or "~~~" in text else (True, text)
    return not closed or bool(_DELIMITER.search(prose)) and _open_delimiters(prose) and _open_delimiters(_QUOTED.sub(" ", prose))


def field_defects(text: str | None, prompt: str | Prompt | None, sectioned: bool) -> set[str]:
    """All defect types of one field of an answer."""
    if _is_empty(text):
        return {"empty"}
    prompt = prompt if isinstance(prompt, Prompt) else Prompt(prompt)
    out = set()
    body = text
    if sectioned:
        section = _REASONING.search(text)
        if section:
            body = section.group(1)
            if _is_empty(body) and _SCORE.search(text):
                return {"empty"}
    plain = _MARKS.sub("", _plain(body)).strip()
    unquoted = _QUOTED.sub(" ", plain)
    said = words(unquoted)
    if _refuses(unquoted.replace("’", "'")):
        out.add("refusal")
    if prompt.text:
        if _is_copy(words(body), prompt):
            out.add("copy")
        given = language(said)
        if prompt.language and given:
            if prompt.language != given:
                out.add("language")
        elif prompt.script and not (prompt.script == "LATIN" and unquoted.isascii()) and script(unquoted) not in (None, "?", prompt.script):
            out.add("language")
    if sectioned and len(_SCORE.findall(text.rpartition("[SCORES]")[2] if "[SCORES]" in text else "")) < SCORES:
        out.add("truncated")
    if plain and (not _END.search(plain[-20:]) or plain.count('"') % 2 or _is_open(_plain(text))):
        out.add("truncated")
    return out


def defects(df: DataFrame, id_col: str, fields: dict[str, bool], prompt_col: str = "prompt") -> DataFrame:
    """``(rec_id, defect, rank)``: a row for every type that triggers on one of ``fields``.

    ``fields`` maps each field's name to whether it has sections and scores. ``rank``
    is the type's place in the order of the rules.
    """
    names, sectioned = list(fields), list(fields.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kinds, ranks = [], [], []
            for key, prompt, *texts in zip(*(c.to_pylist() for c in b.columns)):
                prompt = Prompt(prompt)
                found = set().union(*(field_defects(t, prompt, s) for t, s in zip(texts, sectioned)))
                for k in sorted(found, key=ORDER.index):
                    ids.append(key)
                    kinds.append(k)
                    ranks.append(ORDER.index(k))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(ranks, pa.int32())], names=["rec_id", "defect", "rank"])

    picked = df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(prompt_col).cast("string").alias("p"), *(F.col(n).cast("string").alias(f"f{i}") for i, n in enumerate(names)))
    return picked.mapInArrow(run, "rec_id long, defect string, rank int").distinct()


def answer_defects(cot: DataFrame, inference: DataFrame) -> DataFrame:
    """``(rec_table, rec_id, defect, rank)`` of both answer tables, all types."""
    a = defects(cot, "cot_id", {"target_output": True, "reasoning": False}).select(F.lit("cot_samples").alias("rec_table"), "*")
    b = defects(inference, "result_id", {"reasoning": False}).select(F.lit("inference_results").alias("rec_table"), "*")
    return a.union(b)


def first_defect(all_types: DataFrame) -> DataFrame:
    """``(rec_table, rec_id, defect)``: each defective answer with the first type in rule order."""
    return (
        all_types.groupBy("rec_table", "rec_id")
        .agg(F.min_by("defect", "rank").alias("defect"))
        .select("rec_table", "rec_id", "defect")
    )
