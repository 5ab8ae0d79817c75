"""Survivors are chosen by class, whatever the ids are."""

from perioda.llm import simhash as sh

ONE = "the quick brown fox jumps over the lazy dog and runs far away from here"
TWO = "other words entirely in this one text about ships and the cold sea in winter"
THREE = "a third text that has nothing at all to do with foxes or with ships or the sea"


def test_null_ids_of_different_classes_all_stay(make):
    docs = make([(None, ONE), (None, TWO), (None, TWO), (4, THREE), (None, THREE)], "doc_id long, text string")
    found = sorted(((r["doc_id"], r["text"]) for r in sh.keep_one(docs).collect()), key=repr)
    assert found == sorted([(None, ONE), (None, TWO), (4, THREE)], key=repr)


def test_one_id_with_two_texts_keeps_both(make):
    docs = make([(1, ONE), (1, TWO), (2, TWO)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in sh.keep_one(docs).collect()) == sorted([(1, ONE), (1, TWO)])
