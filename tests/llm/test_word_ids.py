"""Ids of words across batches: each plain word goes to the model once, what is kept is bounded, ids stay the library's."""

import public_tokenizers
import pyarrow as pa
import pytest

from assayloom.llm import encoding

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Straße reading, READING thtionble", "größe! ßx xß̈ ä Übeen", None, "", "reading straße |", "'s it's don't 7up 42 K ẞ STRASSE ß"]


def asked(enc, monkeypatch):
    """The words that go to the model, and the strings that go to the whole tokenizer, from now on."""
    model, whole, plain, other = enc._model, enc._encode, [], []
    monkeypatch.setattr(enc, "_model", lambda word: plain.append(word) or model(word))
    monkeypatch.setattr(enc, "_encode", lambda strings: other.extend(strings) or whole(strings))
    return plain, other


def ids_of(enc, texts):
    ids, starts = enc.texts(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(starts, starts[1:])]


@pytest.fixture
def enc():
    return encoding.Encoder(PATH)


def library(enc, texts):
    return [enc.tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_words_of_earlier_batches_are_not_encoded_again(enc, monkeypatch):
    plain, other = asked(enc, monkeypatch)
    first = ids_of(enc, TEXTS)
    assert sorted(plain) == sorted(set(plain)) and {"straße", "größe", "ß"} <= set(plain) and not {"Straße", "straße"} & set(other)
    plain.clear()
    assert ids_of(enc, TEXTS[::-1]) == first[::-1] and plain == []
    assert first == library(enc, TEXTS)


@pytest.mark.parametrize("most", [0, 2])
def test_kept_words_are_bounded(enc, monkeypatch, most):
    monkeypatch.setattr(encoding, "KEPT_WORDS", most)
    for _ in range(2):
        assert ids_of(enc, TEXTS) == library(enc, TEXTS) and len(enc.kept) == most


def test_long_words_are_not_kept(enc):
    texts = ["a" * 32 + " " + "acgt" * 50_000, "ß" * 33 + ", " + "acgt" * 50_000]
    assert ids_of(enc, texts) == library(enc, texts) and list(enc.kept) == ["a" * 32]


def test_sharp_s_in_every_place(enc):
    texts = [" ".join(a + "ß" + b + c for a in ("", "a", "ö", "ßß") for b in ("", "s", "é", "ß") for c in ("", ".", ",!", "|", "-", "'s", "̈"))]
    assert ids_of(enc, texts) == library(enc, texts)
