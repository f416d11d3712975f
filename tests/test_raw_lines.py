import csv
import io
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from timbrel.sources import raw_lines as R

SCHEMA = "line_id long, file_name string, line_no int, raw_text string, reason string, kind int"
GOOD = '1,2,"He said ""hi"", twice\nand left",Ann,Joy,positive,1,2,"00:00:01,000","00:00:02,000"'


def judged(text):
    return R._dialogue(text)[1]


@pytest.mark.parametrize(
    "text, reason",
    [
        (GOOD, None),
        (" 7 ,08,hello,Ann, ANGER ,neutral,1,2,x,y", None),
        ('1,2,"He said "hi" twice",Ann,joy,n,1,2,x,y', "quoting"),
        ('1,2, "hello",Ann,joy,n,1,2,x,y', "quoting"),
        ('1,2,"hello,Ann,joy,n,1,2,x,y', "quoting"),
        ('1,2,"hello" there,Ann,joy,n,1,2,x', "quoting"),
        ("1,2,hello,Ann,joy,n,1,2,x", "column_count"),
        ("1,2,hello,Ann,joy,n,1,2,x,y,z", "column_count"),
        ("", "column_count"),
        ("   ", "column_count"),
        ("x,2,hello,Ann,joy,n,1,2,x,y", "invalid_value"),
        ("-1,2,hello,Ann,joy,n,1,2,x,y", "invalid_value"),
        ("1,2, ,Ann,joy,n,1,2,x,y", "invalid_value"),
        ("1,2,hel�lo,Ann,joy,n,1,2,x,y", "invalid_value"),
        ("1,2,hel\x07lo,Ann,joy,n,1,2,x,y", "invalid_value"),
        ("1,2,hel\tlo,Ann,joy,n,1,2,x,y", None),
        ("1,2,hello,Ann,happy,n,1,2,x,y", "invalid_value"),
    ],
)
def test_dialogue_reasons(text, reason):
    assert judged(text) == reason


@pytest.mark.parametrize(
    "text, reason",
    [("a;Train", None), ("a, Test1", None), ("a\tTest2", None), ("  a   Development ", None), ("a;Train;1", "column_count"), ("aTrain", "column_count"), ("", "column_count"), ('"a;Train', "quoting"), ("a;train", "invalid_value"), ("a;Train,x", "invalid_value")],
)
def test_partition_reasons(text, reason):
    assert R._partition(text)[1] == reason


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00\r"), max_size=8), min_size=10, max_size=10))
def test_written_records_parse_to_themselves(fields):
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(fields)
    got, reason, cost, _ = R._dialogue(out.getvalue())
    assert reason in (None, "invalid_value") and cost == 0
    assert got == fields


_FIELD = r'(?:"[^"]*(?:""[^"]*)*"|[^",]*)'
RECORD, FIELDS = re.compile(f"{_FIELD}(?:,{_FIELD})*"), re.compile(f",({_FIELD})")


def plain(text, width):
    """The reason by the grammar alone."""
    if not RECORD.fullmatch(text):
        return "quoting"
    return None if len(FIELDS.findall("," + text)) == width else "column_count"


@settings(max_examples=400, deadline=None)
@given(st.text('",ab\n', max_size=30))
def test_the_edits_say_what_the_grammar_says(text):
    cost, edits, fields = R.repair(text, 4)
    assert len(fields) == 4 and cost == len(edits)
    assert R._reason(edits, True) == plain(text, 4)


ROWS = st.lists(st.text('",a1 ;\n\t\x01\u00a0', max_size=12), max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a_sent_emo_b.csv", "partition_0.txt"]), st.one_of(st.text('",a1; \n\t\x1c\x01\u00a0', max_size=14), ROWS.map(",".join), st.just(GOOD), st.just(GOOD.replace("Ann", '"A,"'))), st.sampled_from(["", ";Train", " Test", ",x"])), min_size=40, max_size=40))
def test_rows_of_the_jvm_are_those_of_the_programme(spark, rows):
    rows = [(i, name, 1, text + tail, None, 0) for i, (name, text, tail) in enumerate(rows)]
    for r in R.parse_records(spark.createDataFrame(rows, SCHEMA)).collect():
        fields, reason, cost, edits = (R._dialogue if r.kind == "dialogue" else R._partition)(rows[r.line_id][3])
        assert (r.fields, r.reason, r.edit_cost, r.edits) == (fields, reason, cost, edits)


def test_reasons_come_from_the_edits(spark, monkeypatch):
    rows = [(1, "a_sent_emo_1.csv", 1, "1,2", None, 0), (2, "a_sent_emo_1.csv", 1, '"' + GOOD, None, 0)]
    assert [R._dialogue(r[3])[1] for r in rows] == ["column_count", "quoting"]
    monkeypatch.setattr(R, "repair", lambda text, width: (0, [], [""] * width))
    assert [R._dialogue(r[3])[1] for r in rows] == ["invalid_value", "invalid_value"]


def test_delimiters_never_excuse_quotes_nor_the_reverse():
    assert R.repair('ab"cd",e', 3)[1] != ["insert_delimiter@2"]
    alternating = ",".join(['"a"', "b"] * 6)  # no two neighbours can be written as one field
    assert R._reason(R.repair(alternating, 10)[1], True) == "column_count"
    assert R.repair("1,2,Well, yes, no,Ann,joy,n,1,2,x,y", 10)[2][2:4] == ["Well yes no", "Ann"]


def test_a_lone_quote_costs_one_edit():
    assert R.repair('1,"b,c', 3)[0] == 1


def test_a_very_long_record_is_linear():
    text = "1,2," + '"' + 'x""' * 20_000 + '",A,joy,n,1,2,x,y'
    assert judged(text) is None
    assert judged(text + '"') == "quoting"
    fields, reason, cost, edits = R._dialogue('x"y' * 30_000)
    assert reason == "quoting" and len(fields) == 10 and cost == len(edits)


def test_a_record_of_any_length_is_repaired_the_same_way(monkeypatch):
    part, n = ',"x"y, z', 5_000  # as many quotes edited as the grammar needs, and no delimiter besides
    cost, edits, fields = R.repair('1,2,"a, b' + part * n, 10)
    assert cost == len(edits) == 2 * n + 1 and len(fields) == 10 and all("quote" in x for x in edits)
    for text in ('1,2,"a, b' + part * 4, 'x"y,' * 9, '"a,b""c' * 5 + ",d,e"):
        want = R.repair(text, 10)
        for stretch in (1, 2, 7):
            with monkeypatch.context() as m:
                m.setattr(R, "STRETCH", stretch)
                assert R.repair(text, 10) == want


def test_surplus_quoted_fields_beside_an_edited_quote():
    edits, fields = R.repair('x"y' + ',"a",b' * 6, 10)[1:]
    assert [x.split("@")[0] for x in edits] == ["delete_quote"] + ["delete_delimiter"] * 3 and len(fields) == 10


def test_spark_table(spark):
    rows = [(1, "a_sent_emo_1.csv", 1, GOOD, "clash", 0), (1, "a_sent_emo_1.csv", 1, GOOD, None, 0), (2, "partition_1.txt", 2, None, None, 0), (None, None, None, "x", None, 0), (3, "d/partition_2.txt", 1, "p;Test", None, 0)]
    parsed = R.parse_records(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.line_id or 0, r.reason) for r in R.rejects(parsed).collect()) == [(0, "unknown_file"), (2, "column_count")]
    d = R.valid_dialogue_rows(parsed).collect()
    assert len(d) == 2 and d[0].utterance == 'He said "hi", twice\nand left' and d[0].emotion == "joy" and d[0].dialogue_id == 1
    assert [tuple(r) for r in R.valid_partition_rows(parsed).select("utterance_id", "partition").collect()] == [("p", "Test")]


def test_empty_table(spark):
    assert R.parse_records(spark.createDataFrame([], SCHEMA)).count() == 0
