import functools
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from timbrel.llm import tokens as K

PATH = f"{K.DEFAULT_DIR}/byte_bpe_50k.json"
shared = functools.cache(lambda: (K.Encoder(PATH), K.token_bytes(PATH)))
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


@pytest.fixture(scope="module")
def enc():
    return K.Encoder(PATH)


def whole(enc, texts):
    return [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]


def test_every_basic_plane_character_is_split_as_the_library_does(enc):
    probe = [f"a{chr(c)}1 {chr(c)}{chr(c)} b" for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF]
    assert enc(probe) == whole(enc, probe)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_ids_are_the_librarys_and_decode_to_the_text(texts):
    enc, table = shared()
    ids = enc(texts)
    assert ids == whole(enc, texts)
    assert [b"".join(table[i] for i in row).decode() for row in ids] == texts


def test_the_table_may_be_forgotten(enc, monkeypatch):
    monkeypatch.setattr(K, "MAX_CACHE", 3)
    fresh = K.Encoder(PATH)
    texts = ["one two three four five", "six seven", "one two"]
    assert [fresh([t])[0] for t in texts] == whole(fresh, texts)


def test_tables(spark):
    rows = [(1, "Hello <|endoftext|> wörld 你好", "x"), (2, "", "x"), (3, None, "x"), (1, "again", "x"), (None, " \n\t", "x"), (4, "ab " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = K.encode(df).collect()
    assert len(got) == 6 and [r.ids for r in got if r.doc_id in (2, 3)] == [[], []]
    assert 50256 not in got[0].ids
    back = {(r.doc_id, r.text) for r in K.decode(K.encode(df)).collect()}
    assert back == {(a, b or "") for a, b, _ in rows}
    assert K.encode(df.limit(0)).count() == 0 and K.decode(K.encode(df.limit(0))).count() == 0


def test_offsets_cover_split_characters(spark):
    text = "a 𝔘🙂é x"
    r = K.encode_with_offsets(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[1].ids == [] and r[1].starts == []
    covered = set()
    for s, e in zip(r[0].starts, r[0].ends):
        assert 0 <= s < e <= len(text)
        covered |= set(range(s, e))
    assert covered == set(range(len(text))) and r[0].starts == sorted(r[0].starts)


def test_a_cut_id_list_decodes_to_replacement_characters(spark):
    enc = K.Encoder(PATH)
    ids = enc(["🙂"])[0]
    df = spark.createDataFrame([(1, ids[:1]), (2, None), (3, ids)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in K.decode(df).collect()}
    assert "�" in got[1] and got[2] == "" and got[3] == "🙂"


def test_other_vocabularies_are_encoded_whole(spark):
    from tokenizers import Tokenizer

    texts = ["Cafe\u0301 noir", "É  X", "", "It's 12"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tok = Tokenizer.from_file("/opt/tokenizers/word_bpe_49k.json")
    want = {i: tok.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids for r in K.encode(df, tokenizer="word_bpe_49k").collect()} == want
    with pytest.raises(Exception, match="changes texts"):
        K.decode(K.encode(df, tokenizer="word_bpe_49k"), tokenizer="word_bpe_49k").collect()
