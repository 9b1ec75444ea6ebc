"""Sections, sentences and codes."""

import random
import re

from chartloom import schemas
from chartloom.operators import notes


def sections(spark, *rows):
    df = spark.createDataFrame([(1, 1, str(i), k, t) for i, (k, t) in enumerate(rows)], schemas.NOTES)
    out = notes.segment_sections(df).orderBy("note_id", "section_ord").collect()
    return [(r.note_id, r.section_name, r.section_text) for r in out]


def test_section_traps(spark):
    got = sections(
        spark,
        ("radiology", "FINDINGS: mass\nnodule"),
        ("radiology", "Findings:\nA\nFindings:\n \nImpression:\nB"),
        ("radiology", "Findings:\nA\nFindings:\nImpression:\nB"),
        ("other", "free\ntext"),
        ("discharge", None),
        ("Discharge ", "pre\nHPI\nx"),
    )
    assert got == [("0", "Findings", "nodule"), ("1", "Impression", "B"), ("2", "Findings", "A"), ("2", "Impression", "B"), ("3", "full_text", "free\ntext"), ("5", "full_text", "pre"), ("5", "HPI", "x")]


def fold(text):
    out, name, body = {}, "full_text", []
    for line in text.split("\n"):
        m = re.match(r"(?i)(findings)|(impression|conclusions)|(indication|reason for exam)", line.strip())
        if m:
            if body:
                out[name] = "\n".join(body).strip()
            name, body = ("Findings", "Impression", "Indication")[m.lastindex - 1], []
        else:
            body.append(line)
    if body:
        out[name] = "\n".join(body).strip()
    return {k: v for k, v in out.items() if v}


def test_sections_equal_a_fold_on_random_notes(spark):
    r = random.Random(3)
    texts = ["\n".join(r.choice(["Findings:", "IMPRESSION", "Indication: x", "", " ", "a", "b c"]) for _ in range(r.randrange(12))) for _ in range(300)]
    got: dict = {}
    for i, name, body in sections(spark, *[("radiology", t) for t in texts]):
        got.setdefault(i, {})[name] = body
    assert got == {str(i): f for i, t in enumerate(texts) if (f := fold(t))}


def test_sentences_keep_gaps(spark):
    df = spark.createDataFrame([(1, "Ok. A. Two words! Last"), (2, None), (3, "")], "id int, t string")
    assert [(r.id, r.sentence_index, r.sentence_text) for r in notes.split_sentences(df, ["id"], "t").orderBy("id", "sentence_index").collect()] == [(1, 0, "Ok."), (1, 2, "Two words!"), (1, 3, "Last")]


def test_icd_versions(spark):
    d = spark.createDataFrame([(1, 1, 1, "4280", "8"), (1, 1, 2, " 4019 ", "9"), (1, 1, 3, "1", "9"), (1, 1, 4, "I10", "10"), (1, None, 5, None, None)], schemas.DIAGNOSES)
    g = spark.createDataFrame([("4019", "X"), ("4019", "I10")], schemas.CROSSWALK).coalesce(1)
    got = [(r.icd_code, r.icd_version, r.is_unmapped) for r in notes.icd_map(d, g).orderBy("seq_num").collect()]
    assert got == [("4280", "8", True), ("I10", "10", False), ("1", "9", True), ("I10", "10", False), (None, None, True)]


def test_empty_tables_keep_their_columns(spark):
    empty = spark.createDataFrame([], schemas.NOTES)
    assert notes.segment_sections(empty).columns == ["note_id", "section_name", "section_ord", "section_text"]
    assert notes.segment_sections(empty).count() == 0
