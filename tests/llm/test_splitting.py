"""Pieces: limits, overlap, whole coverage, natural cuts."""

import random

import pytest

from chartloom.llm.splitting import split_oversized, split_text


def texts():
    r = random.Random(4)
    words = ["fever", "rash,", "today.", "Then", "zinc\n", "scan;", "ok.\n\n", "ผู้ป่วย", "痛みがある。"]
    for n in (10, 300, 700, 3000):
        yield " ".join(r.choice(words) for _ in range(n))
    yield "x" * 5000
    yield "กำ" * 2000
    yield "a b " * 2000


@pytest.mark.parametrize("text", list(texts()))
@pytest.mark.parametrize("size, overlap", [(1500, 150), (200, 0), (100, 40)])
def test_pieces(text, size, overlap):
    pieces = split_text(text, size, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 < b - a <= size for a, b in pieces)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert a < c <= b < d
        if overlap and len(text) > size:
            assert abs((b - c) - overlap) <= max(45, overlap)


def test_cuts_are_natural():
    text = "\n\n".join("This is a sentence of some length. " * 12 for _ in range(8))
    for _, b in split_text(text)[:-1]:
        assert text[:b].rstrip().endswith(".")


def test_table(spark):
    long = "One two three. " * 200
    df = spark.createDataFrame([(1, long), (1, long), (2, "short"), (3, None), (4, "")], "section_id bigint, section_text string")
    rows = split_oversized(df, "section_id", "section_text").orderBy("piece_no").collect()
    assert {r.section_id for r in rows} == {1} and [r.piece_no for r in rows] == list(range(len(rows)))
    assert all(long[r.piece_start : r.piece_end] == r.piece_text and len(r.piece_text) <= 1500 for r in rows)
