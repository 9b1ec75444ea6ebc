"""Quantities: reading, converting, resolving unknown spellings, defined results of dirty rows."""

from fractions import Fraction

import pytest

from chartloom.operators import units

REF = [("lesion size", "length", "mm", None), ("glucose", "concentration", "mmol/L", 180.0), ("temperature", "temperature", "degC", None), ("body weight", "weight", "kg", None), ("infusion time", "duration", "min", None)]
REF_SCHEMA = "measured string, quantity string, common_unit string, grams_per_mol double"
SCHEMA = "meas_id bigint, measured string, measurement string, unit string"


@pytest.mark.parametrize(
    "quantity, text, column, wanted",
    [
        ("length", "5,2 by 5,4 cm", None, [("5.2", "cm"), ("5.4", "cm")]),
        ("length", "1¾ in diameter", "inch", [("1.75", "in")]),
        ("length", "12 in diameter", "mm", [("12", "mm")]),
        ("length", "1-3/4inch", None, [("1.75", "in")]),
        ("length", "58 mm × 8.2 cm", "cm", [("58", "mm"), ("8.2", "cm")]),
        ("length", "10xtwox80 MM", "", [("10", "mm"), ("2", "mm"), ("80", "mm")]),
        ("length", "4.7 cmx23 mmx10.1 cm", None, [("4.7", "cm"), ("23", "mm"), ("10.1", "cm")]),
        ("length", "six mm", None, [("6", "mm")]),
        ("length", "fourmm x tenmillimeters", None, [("4", "mm"), ("10", "mm")]),
        ("duration", "0.5 hrs", None, [("0.5", "h")]),
        ("volume", "1,040 ML", "L", [("1040", "mL")]),
        ("volume", ".6–1.9 L", None, [("0.6", "L"), ("1.9", "L")]),
        ("duration", "5 h 10 min", "h", [(Fraction(31, 6), "h")]),
        ("duration", "6:51 h", None, [(Fraction(411, 60), "h")]),
        ("weight", "17 pounds, 6 ounces", "mixed", [("17.375", "lb")]),
        ("temperature", "39.8ºC", "F", [("39.8", "degC")]),
        ("concentration", "5.9", "mM ", [("5.9", "mmol/L")]),
        ("length", "--", "mm", []),
        ("length", None, "mm", []),
        ("length", "16", "unk", [("16", "")]),
    ],
)
def test_reading(quantity, text, column, wanted):
    assert units.read_quantities(quantity, text, column) == [(Fraction(v), u) for v, u in wanted]


def test_convert_and_report(spark):
    rows = [(1, "lesion size", "2 in", None), (1, "lesion size", "2 in", None), (2, "glucose", "180 mg/dL", "mmol/L"), (3, "temperature", "212 F", None), (4, "body weight", None, "kg"), (5, "body weight", "9", "?"), (6, "nothing", "1 cm", None), (7, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    ref = spark.createDataFrame(REF, REF_SCHEMA)
    assert {(r.meas_id, round(r.value, 6)) for r in units.convert(df, ref).collect()} == {(1, 50.8), (2, 10.0), (3, 100.0)}
    assert {(r.meas_id, r.reason) for r in units.unconverted(df, ref).collect()} == {(4, "no text"), (5, "no usable unit"), (6, "not in the reference"), (7, "not in the reference")}


def test_unknown_spelling_is_estimated(spark):
    rows = [(i, "lesion size", str(20 + i % 30), "mm") for i in range(200)] + [(1000 + i, "lesion size", f"{2 + (i % 30) / 10:.1f}", "zentim") for i in range(60)]
    got = units.convert(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(REF, REF_SCHEMA)).where("unit = 'zentim'").collect()
    assert len(got) == 60 and {(r.as_unit, r.origin) for r in got} == {("cm", "estimated")}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert units.convert(empty, spark.createDataFrame(REF, REF_SCHEMA)).count() == 0


@pytest.mark.parametrize("rows", [1, 29, 30, 300])
def test_results_do_not_hang_on_the_number_of_rows(spark, rows):
    base = [(i, "lesion size", str(20 + i % 30), "mm") for i in range(200)]
    new = [(1000 + i, "lesion size", f"{2 + (i % 30) / 10:.1f} centimetr", None) for i in range(rows)]
    stray = [(2000 + i, "lesion size", f"{20 + i % 30} anterior", None) for i in range(rows)]  # values as in mm, but no unit
    df, ref = spark.createDataFrame(base + new + stray, SCHEMA), spark.createDataFrame(REF, REF_SCHEMA)
    got = {r.meas_id: r.as_unit for r in units.convert(df, ref).where("meas_id >= 1000").collect()}
    assert got == {i: "cm" for i, *_ in new}
    assert {r.meas_id for r in units.unconverted(df, ref).collect()} == {i for i, *_ in stray}


def test_check_reports_contradictions_and_proposals(spark):
    rows = [(i, "lesion size", str(20 + i % 30), "mm") for i in range(90)] + [(100 + i, "lesion size", f"{2 + i / 13:.1f}", "cm") for i in range(40)]
    rows += [(200 + i, "lesion size", str(20 + i), "m") for i in range(30)] + [(300 + i, "lesion size", f"{2.5 + i / 2}", "ctr") for i in range(5)]
    rows += [(400 + i, "temperature", str(35 + i / 10), "C") for i in range(30)] + [(500 + i, "temperature", str(95 + i * 0.27), "F") for i in range(20)]
    got = {(r.measured, r.unit): r for r in units.spelling_check(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(REF, REF_SCHEMA)).collect()}
    assert {u: r.verdict for (_, u), r in got.items()} == {"mm": "agrees", "cm": "agrees", "m": "contradicts", "ctr": "proposed", "degC": "agrees", "degF": "agrees"}
    assert got["lesion size", "m"].nearest == "mm" and got["lesion size", "ctr"].as_unit is None and abs(got["lesion size", "cm"].est_scale - 10) < 1
    assert abs(got["temperature", "degF"].est_scale - 5 / 9) < 0.2


@pytest.mark.parametrize(
    "quantity, text, wanted",
    [
        ("weight", "one hundred and five kg", [(105.0, "kg")]),
        ("length", "two hundred mm", [(200.0, "mm")]),
        ("length", "a hundred by sixty-five mm", [(100.0, "mm"), (65.0, "mm")]),
        ("volume", "one thousand two hundred ml", [(1200.0, "mL")]),
        ("weight", "two point five kg", [(2.5, "kg")]),
        ("duration", "one and a half hours", [(1.5, "h")]),
        ("temperature", "-3.5 C", [(-3.5, "degC")]),
        ("temperature", "36-38 C", [(36.0, "degC"), (38.0, "degC")]),
        ("length", "5 -10 mm", [(5.0, "mm"), (10.0, "mm")]),
        ("volume", "1.234,5 ml", [(1234.5, "mL")]),
        ("volume", "1,234.5 ml", [(1234.5, "mL")]),
        ("volume", "1.234.567 ml", [(1234567.0, "mL")]),
        ("volume", "1.5e3 ml", [(1500.0, "mL")]),
        ("volume", "1.5 x 10^3 ml", [(1500.0, "mL")]),
        ("volume", "2 ×10³ ml", [(2000.0, "mL")]),
        ("volume", "two dozen ml", []),
        ("volume", "half a litre", []),
        ("volume", "3 million ml", []),
    ],
)
def test_number_words_signs_and_powers(quantity, text, wanted):
    assert [(float(v), u) for v, u in units.read_quantities(quantity, text, None)] == wanted


def test_a_spelling_without_resemblance_goes_through_the_graph(spark):
    rows = [(i, "body weight", f"{60 + i % 50}", "kg") for i in range(150)] + [(200 + i, "body weight", f"{135 + i % 110}", "lb") for i in range(150)]
    rows += [(400 + i, "body weight", f"{61 + i % 49}", "qz") for i in range(120)]
    rows += [(600 + i, "temperature", str(35.5 + i % 40 / 10), "C") for i in range(80)] + [(700 + i, "temperature", str(96 + i % 72 / 10), "F") for i in range(80)] + [(800 + i, "temperature", str(96.1 + i % 70 / 10), "ff") for i in range(60)]
    rows += [(900 + i, "body weight", f"{60 + i % 50} today", None) for i in range(60)]  # a stray word: in no unit column
    rows += [(1000, "body weight", "122", "xx")]  # a value between two units
    got = units.convert(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(REF, REF_SCHEMA))
    by = {(r.unit, r.as_unit, r.origin): r["count"] for r in got.groupBy("unit", "as_unit", "origin").count().collect()}
    assert by == {("kg", "kg", "known"): 150, ("lb", "lb", "known"): 150, ("qz", "kg", "graph"): 120, ("degC", "degC", "known"): 80, ("degF", "degF", "known"): 80, ("ff", "degF", "graph"): 60}
