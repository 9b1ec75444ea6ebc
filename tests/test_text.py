"""Literal cases of the text functions, traps included."""

import pytest
from pyspark.sql import functions as F

from chartloom.functions import text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("Sodium: 140\nHPI:\nfoo", "LABTEST Sodium: 140 HPI:\nfoo"),
        ("BP: 120/80 mmHg", "LABTEST BP: 120 /80 mmHg"),
        ("pt with HTN, s/p fall", "patient with hypertension, status post fall"),
        ("Name: ___ [**2101-1-1**] x", "Name: x"),
        (None, ""),
        ("", ""),
        ("    ", ""),
    ],
)
def test_clean_text(spark, given, wanted):
    assert one(spark, given, text.clean_text) == wanted


def test_clean_is_idempotent_without_labs(spark):
    once = one(spark, "pt   seen ___ today", text.clean_text)
    assert one(spark, once, text.clean_text) == once


def test_legacy_rules_are_sequential(spark):
    assert one(spark, "id-t2dm", lambda c: text.expand(c, text.LEGACY_ABBREVIATIONS)) == "id-type 2 diabetes mellitus"


@pytest.mark.parametrize("given, wanted", [("x-ray", "x - ray"), ("Meds:\n- aspirin", "Meds: - aspirin"), ("ﬁne­ ly", "fine ly"), (None, "")])
def test_ocr_normalize(spark, given, wanted):
    df = spark.createDataFrame([(given,)], "t string")
    assert text.ocr_normalize(df, "t").first()["t"] == wanted


def test_abnormal_reads_as_normal(spark):
    assert one(spark, "abnormal mass", lambda c: text.severity(F.lit(""), c)) == "normal"
    assert one(spark, "a mass", lambda c: text.severity(c, F.lit(None))) == "abnormal"
    assert one(spark, None, lambda c: text.severity(c, c)) == "uncertain"


def test_causes_beat_treats(spark):
    assert one(spark, "started on x, rash due to x", lambda c: text.keyword_relation(c)[0]) == "CAUSES"
    assert one(spark, "started on x, rash due to x", lambda c: text.keyword_relation(c)[1]) == 0.68


def test_measurements_offsets(spark):
    t = "Mass 2.5 x 3 cm and 4x5x6 MM; 3 mm in diameter."
    rows = text.measurements(spark.createDataFrame([(1, t), (2, None), (3, "")], "id int, t string"), "id", "t").collect()
    assert {(r.measurement, r.dim_3, r.unit) for r in rows} == {("2.5 x 3 cm", None, "cm"), ("4x5x6 MM", "6", "MM"), ("3 mm in diameter", None, "mm")}
    assert all(t[r.start : r.end_] == r.measurement for r in rows)


def test_negations(spark):
    t = "No evidence of fracture. Negative for clot, normal heart"
    rows = text.negations(spark.createDataFrame([(1, t)], "id int, t string"), "id", "t").collect()
    assert {(r.finding, t[r.start : r.end_] == r.full_text) for r in rows} == {("fracture", True), ("clot", True), ("heart", True)}


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r.x for r in df.select(text.cosine(F.col("a"), F.col("b")).alias("x")).collect()] == [1.0, 0.0, 0.0, 0.0]
