from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import bpe, queries

VOCABULARY = Path(queries.VOCABULARY)
pytestmark = pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(VOCABULARY.read_bytes()))


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(str(VOCABULARY.with_suffix(".json")))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "Hello  world", "<|endoftext|>", "don't DON'T I'll", "a 　b \n\n c", "😀😀 日本語 ÄÖÜ ß", "՘x꟎", "x" * 5000, "ab" * 3000 + " 12345678"])
def test_equals_library(encoder, library, text):
    assert encoder.encode(text) == library(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_equals_library_and_decodes(encoder, library, text):
    ids = encoder.encode(text)
    assert ids == library(text) and bpe.decode(ids, encoder.ranks) == text


def naive(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abetinsor ", min_size=1, max_size=40))
def test_segment_tree_equals_naive_merging(encoder, text):
    piece = text.encode()
    assert bpe.merge(piece, encoder.ranks) == naive(piece, encoder.ranks)


def test_column(spark):
    df = spark.createDataFrame([(1, None, "n"), (2, "", "n"), (3, "Hello world", "n"), (3, "Hello world", "n"), (None, "Hello", "n")], "doc_id bigint, text string, ids string")
    rows = sorted(((r["doc_id"] or 0, r["ids"]) for r in bpe.encode(df, "text", ["doc_id"], str(VOCABULARY)).collect()), key=str)
    assert rows == [(0, [15496]), (1, []), (2, []), (3, [15496, 995]), (3, [15496, 995])]
    assert bpe.encode(df.limit(0), "text", ["doc_id"], str(VOCABULARY)).count() == 0
