"""Ids held against the library's own encode."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from leadloom.llm import sentencepiece as sp  # noqa: E402
from leadloom.llm.entries import tokenizer_path  # noqa: E402

TEXTS = ["des Elle", "a  b", "  a", " ", "\n", "\n\n a", "a \n\n  b  ", "▁a b", "a▁▁b\n▁", "x\xa0y", "日本 語", "a\0b", "<s> </s>",
         "x" * 300, " " * 120, "ab" + "c" * 900 + " d" * 40, "ﬁ é é", "\t", None, ""]


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def test_ids_are_those_of_the_library(spark, library):
    path = tokenizer_path("piece_bpe_32k.model")
    texts = TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "n long, text string").repartition(3)
    for chunk_chars in (50, 1 << 15):
        found = {r.n: r.ids for r in sp.encode(df, path, keep=["n"], chunk_chars=chunk_chars).collect()}
        assert found == {n: library.encode(t or "") for n, t in enumerate(texts)}


def test_chunks_end_at_unit_borders(library):
    model, rng = sp.Merges(tokenizer_path("piece_bpe_32k.model"), 50), random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice("ab  \n▁éx日the") for _ in range(rng.randint(1, 60)))
        chunks = list(sp.chunks_at_units(sp.BLANK + text.replace(" ", sp.BLANK), 7))
        ids = np.frombuffer(b"".join(map(model.cut_ids, chunks)), "<i4").tolist()
        assert ids == np.frombuffer(model.ids(text), "<i4").tolist() == library.encode(text)


def test_decoding_joins_the_pieces_of_every_row(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    texts, rng = sp.pieces_of(path).texts, random.Random(5)
    rows = [[rng.randrange(len(texts)) for _ in range(rng.choice([0, 0, 1, 40]))] for _ in range(1300)] + [[0, 1, 2], [], None]
    df = spark.createDataFrame(list(enumerate(rows)), "n long, ids array<int>").coalesce(1)
    found = {r.n: r.text for r in sp.decode(df, path, keep=["n"]).collect()}
    joined = [b"".join(texts[i] for i in r or []) for r in rows]
    assert found == {n: (b[1:] if b[:1] == b" " else b).decode("utf-8", "replace") for n, b in enumerate(joined)}


def test_kept_units_are_bounded_by_their_length_too(library):
    """Every text has new units, some of them long; ids are the library's, and little is kept."""
    model, rng = sp.Merges(tokenizer_path("piece_bpe_32k.model")), random.Random(8)
    most = 0
    for _ in range(60):
        texts = [" ".join("".join(rng.choices("abcdefghijk", k=rng.choice([9, 9, 9, 20_000]))) for _ in range(8)) for _ in range(20)]
        found = model.all_ids(texts)
        assert np.frombuffer(found[0], "<i4").tolist() == library.encode(texts[0])
        most = max(most, sum(map(len, model.known)) + sum(map(len, model.known.older)))
    assert 64 * sp.MOST_UNITS < 10_000_000 and most < 3 * 64 * sp.MOST_UNITS
