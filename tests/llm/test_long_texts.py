"""Texts of millions of characters are read whole and in bounded memory."""

import time
from pathlib import Path

import numpy as np
import pytest

from lodestrata.llm import bpe, langmix, leakage, queries, residue, setsketch
from tests.llm.test_languages import TEXTS, model  # noqa: F401

LONG = (TEXTS["en"] + " ") * 20_000  # over 3 million characters


def test_languages(model):  # noqa: F811
    rows = langmix.label_texts([LONG, TEXTS["fr"]], model)
    assert rows[0][0][:2] == (0, "en") and rows[0][0][3] == len(LONG.split()) and rows[1][0][:2] == (0, "fr")
    endless = LONG.replace(". ", " ")
    assert langmix.label_texts([endless], model)[0][0][:2] == (0, "en")
    one = model.scores(langmix.code_points([endless[:900_000]]), np.array([0]))
    assert one.argmax() == model.languages.index("en")


def test_words(monkeypatch):
    text = LONG[:1_000_000] + "\u00e9" * 500_000 + " end"
    whole = leakage._hashes([leakage.plain(text)])
    parts = leakage.word_hashes([text, "a b"])
    assert (parts[0][: len(whole[0])] == whole[0]).all() and parts[1].tolist() == [len(whole[0]), 2]


def test_sets_and_residue():
    assert setsketch.tokens(LONG) == setsketch.tokens(TEXTS["en"])
    start = time.perf_counter()
    assert residue.find_residue(LONG + "\n{{x}}")[2] == ["template"]
    assert residue.find_residue("{" * 200_000 + "[" * 200_000 + "_" * 200_000 + "%a" * 100_000)[2] == []
    assert residue.find_residue("page not found. " * 50_000 + "{{" * 50_000)[2] == ["error"]
    assert time.perf_counter() - start < 30


@pytest.mark.skipif(not Path(queries.VOCABULARY).exists(), reason="no vocabulary here")
def test_encoding():
    encoder = bpe.Encoder(bpe.read_ranks(Path(queries.VOCABULARY).read_bytes()))
    ids = encoder.encode(LONG)
    assert bpe.decode(ids, encoder.ranks) == LONG
