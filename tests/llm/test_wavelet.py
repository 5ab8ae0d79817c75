"""The file format round trips, and answers like a list of tokens."""

import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
from hypothesis import given, settings, strategies as st

from perioda.llm import wavelet as wv

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=300))
def test_matrix(ids):
    matrix = wv.WaveletMatrix(wv.WaveletMatrix.build(np.array(ids, np.uint32)))
    assert matrix.ids().tolist() == ids
    for i, token in enumerate(ids[:20]):
        assert matrix.access(i) == token and matrix.rank(token, i) == ids[:i].count(token)
    for token in [*ids[:5], 3, 99_999, 1 << 40]:
        assert matrix.count(token) == ids.count(token)
        assert matrix.occurrences(token) == [i for i, own in enumerate(ids) if own == token]


def test_long_matrix_and_its_size():
    ids = np.random.default_rng(0).integers(0, 49_408, 200_000).astype(np.uint32)
    image = wv.WaveletMatrix.build(ids)
    matrix = wv.WaveletMatrix(image)
    assert (matrix.ids() == ids).all() and len(image) < 0.55 * ids.nbytes
    token = int(ids[77])
    where = np.flatnonzero(ids == token).tolist()
    assert matrix.occurrences(token) == where and matrix.rank(token, 150_000) == sum(p < 150_000 for p in where)
    with pytest.raises(IndexError):
        matrix.access(len(ids))
    with pytest.raises(IndexError):
        matrix.select(token, len(where))
    with pytest.raises(ValueError):
        wv.WaveletMatrix(b"nothing")


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r.'sdéÉ́Σ  \x1c<|1"), st.characters(blacklist_categories=["Cs"])), max_size=50))
def test_pieces_make_the_whole_text(text):
    whole = tokenizers.Tokenizer.from_file(PATH) if not hasattr(test_pieces_make_the_whole_text, "t") else test_pieces_make_the_whole_text.t
    test_pieces_make_the_whole_text.t = whole
    definition = open(PATH, encoding="utf-8").read()
    assert wv.crosses_no_white_space(definition)
    pieces = getattr(test_pieces_make_the_whole_text, "p", None) or wv.PieceIds(definition)
    test_pieces_make_the_whole_text.p = pieces
    ids, ends = pieces.of_texts(pa.array([text, "", text]))
    own = whole.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == own * 2 and ends.tolist() == [len(own), len(own), 2 * len(own)]


def expected(rows, tokenizer):
    start, found = 0, []
    for name, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        found.append((name, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


def test_files_hold_all_rows_in_order(spark, make, tokenizer, tmp_path):
    rows = [(None, "no id"), (1, None), (2, ""), (3, "a<|endoftext|>b " * 400), (4, "x " * 20_000), (9, "same"), (9, "same")]
    docs = make([(i, t, "c") for i, t in reversed(rows)], "doc_id long, text string, ids string")
    path = f"file://{tmp_path}/ids"
    wv.write_files(docs, PATH, path, shard_tokens=500)
    found = sorted((tuple(r) for r in wv.documents_in(spark, path).collect()), key=lambda r: r[1])
    assert found == expected(rows, tokenizer)
    files = spark.read.parquet(path).collect()
    assert len(files) > 2 and all(len(f["doc_ids"]) == len(f["ends"]) for f in files)
    matrix = wv.WaveletMatrix(bytes(next(f["matrix"] for f in files if 4 in f["doc_ids"])))
    assert matrix.count(1) >= 1


def test_empty_table(make):
    assert wv.round_trip(make([], "doc_id long, text string"), PATH).count() == 0


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    found = sorted((tuple(r) for r in wv.round_trip(docs, PATH).collect()), key=lambda r: r[1])
    assert found == expected(rows, tokenizer)


def test_letters_with_marks(tokenizer):
    """Some letters have a composed form as small letters only."""
    marks = [chr(c) for c in range(0x300, 0x110000) if unicodedata.category(chr(c)) in ("Mn", "Mc", "Me")]
    texts = [f"{letter}{mark}ello" for letter in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for mark in marks]
    pieces = wv.PieceIds(open(PATH, encoding="utf-8").read())
    ids, ends = pieces.of_texts(pa.array(texts))
    found = np.split(ids, ends[:-1])
    wrong = [t for t, own, e in zip(texts, found, tokenizer.encode_batch(texts, add_special_tokens=False)) if own.tolist() != e.ids]
    assert not wrong
