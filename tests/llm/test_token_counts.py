"""Counts against the library on whole texts."""

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from perioda.llm import token_counts as tc

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "\n", "a", " a", "  a", "a  ", "a\nOf", "\n\n x", "a\tb", "x" * 5000, "</s> <unk> <0x41>", "a▁b ▁▁", "　x",
    "é é ﬁ", "名前 は\r\n", "😀 😀", "word. word, (word)", " \n \n ", "a\x00b",
]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def counts(model):
    assert tc.cuts_are_safe(model)
    return tc.UnitCounts(model, tc.whole_tokens(model))


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(model, counts, text):
    assert counts.of_text(text) == len(model.encode(text))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t▁.,aeThé<>/s"), st.characters(blacklist_categories=["Cs"])), max_size=60))
def test_any_text(text):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    counts = tc.UnitCounts(model, frozenset())
    assert counts.of_text(text) == len(model.encode(text))


def test_proved_strings_are_single_tokens(model):
    proved = tc.whole_tokens(model)
    assert " the" in proved and "\n" not in proved
    assert all(tc.count_unit(model, unit) == 1 for unit in list(proved)[:2000])


def test_memory_of_merged_units_is_bounded(model, monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED_UNITS", 3)
    counts = tc.UnitCounts(model, frozenset())
    text = " ".join(f"zqx{i}" for i in range(50))
    assert counts.of_text(text) == len(model.encode(text)) and len(counts) <= 4


def test_rows_nulls_and_clashing_names(make):
    docs = make([(1, None, 7), (1, None, 7), (2, "a b", 8), (None, "", 9)], "doc_id long, text string, N_Tokens int")
    found = tc.count_tokens(docs, PATH, limit=1)
    assert found.columns == ["doc_id", "text", "N_Tokens", "n_bytes", "n_tokens_", "over_limit"]
    assert sorted(map(tuple, found.select("doc_id", "N_Tokens", "n_bytes", "n_tokens_", "over_limit").collect()), key=repr) == [
        (1, 7, 0, 0, False), (1, 7, 0, 0, False), (2, 8, 3, 2, True), (None, 9, 0, 0, False)]
    assert tc.count_tokens(docs.limit(0), PATH).count() == 0


def test_whole_table(spark, model):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = {r["doc_id"]: r["n_tokens"] for r in tc.count_tokens(docs, PATH).collect()}
    assert found == {r["doc_id"]: len(model.encode(r["text"])) for r in docs.collect()}
