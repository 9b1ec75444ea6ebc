"""Personal data: spans, placeholders, surrogates."""

import pytest

from chartloom.llm import pii


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("Pt Maelis Zelzandt-Vannolt (SSN 000 55 2296) was moved.", [("NAME", "Maelis Zelzandt-Vannolt"), ("ID", "000 55 2296")]),
        ("HULSANDRE, HOLLIS lives at 491 Sable Lane, Oxmere 00871.", [("NAME", "HULSANDRE, HOLLIS"), ("ADDRESS", "491 Sable Lane, Oxmere 00871")]),
        ("Home visit booked for Flat 1b, 802 Lindfold Road, Hathmoor, call 318-555-0176 first.", [("ADDRESS", "Flat 1b, 802 Lindfold Road, Hathmoor"), ("PHONE", "318-555-0176")]),
        ("Seen by runa hulnolt and Mrs. Northule together.", [("NAME", "runa hulnolt"), ("NAME", "Northule")]),
        ("The caller gave 505 555 0193 ext. 31 and a.b at example dot org for replies.", [("PHONE", "505 555 0193 ext. 31"), ("EMAIL", "a.b at example dot org")]),
        ("Letter cc I. Q. Fosvaar; passport no. HZ3758539.", [("NAME", "I. Q. Fosvaar"), ("ID", "HZ3758539")]),
        ("health number 999 303 4710 was checked. Call 999 303 4710.", [("ID", "999 303 4710"), ("PHONE", "999 303 4710")]),
        ("Orla F. Lunsandre wohnt in der Am Lindfoldweg 161, 00891 Marrowick.", [("NAME", "Orla F. Lunsandre"), ("ADDRESS", "Am Lindfoldweg 161, 00891 Marrowick")]),
        ("Mme Weymund a laissé le numéro 01.99.00.12.58.", [("NAME", "Weymund"), ("PHONE", "01.99.00.12.58")]),
        ("P. Luntresk vive en Calle Harth, 642, 2.º B, 00556 Lindquell.", [("NAME", "P. Luntresk"), ("ADDRESS", "Calle Harth, 642, 2.º B, 00556 Lindquell")]),
        ("报告已发送至ivka-x (at) ward7.test。家属电话：(897) 555-0187。", [("EMAIL", "ivka-x (at) ward7.test"), ("PHONE", "(897) 555-0187")]),
        ("Dr. on call, Foley catheter, Glasgow score 12, Lot 256-103, Two tabs @ 4:23, 7.8 x 8.1 cm, pt seen on Monday.", []),
        ("La Sra. del cuarto 339, M. le voisin, Frau im Zimmer 3.", []),
        ("", []),
    ],
)
def test_spans(text, wanted):
    assert [(k, text[a:b]) for k, a, b in pii.find_pii(text)] == wanted


def test_long_text_is_read_whole():
    text = "word " * 40_000 + "Mail a.b@example.org now."
    assert [k for k, *_ in pii.find_pii(text)] == ["EMAIL"]


def test_permutation_is_one_to_one_and_keeps_the_format():
    made = {pii.permute(f"A{n:03d}-{k}", b"k") for n in range(1000) for k in range(10)}
    assert len(made) == 10_000 and all(m[0].isupper() and m[4] == "-" and m[1:4].isdigit() for m in made)
    assert pii.permute("123", b"k") != pii.permute("123", b"other") or pii.permute("456", b"k") != pii.permute("456", b"other")


ROWS = [(1, "Pt Runa Hulnolt (SSN 000-12-3456) left. Contact is HULNOLT, RUNA on 318-555-0176."), (2, "Seen by Runa Hulnolt and Mrs. Northule together. Call (318) 555-0176 first."), (3, None), (4, ""), (1, "Pt Runa Hulnolt (SSN 000-12-3456) left. Contact is HULNOLT, RUNA on 318-555-0176.")]


def test_redacted(spark):
    df = spark.createDataFrame(ROWS, "section_id bigint, section_text string")
    got = {r.section_id: r.clean_text for r in pii.redact(df, "section_id", "section_text").collect()}
    assert got == {1: "Pt [NAME] (SSN [ID]) left. Contact is [NAME] on [PHONE].", 2: "Seen by [NAME] and Mrs. [NAME] together. Call [PHONE] first.", 3: None, 4: ""}


def test_surrogates_agree_and_differ(spark):
    df = spark.createDataFrame(ROWS, "section_id bigint, section_text string")
    got = {r.section_id: r.surrogate_text for r in pii.surrogates(df, "section_id", "section_text", "key").collect()}
    assert got[3] is None and got[4] == "" and not any(w in got[1] + got[2] for w in ("Hulnolt", "HULNOLT", "555-0176", "Northule", "000-12-3456"))
    name = got[1].split(" (")[0].removeprefix("Pt ")
    first, last = name.split(" ")
    assert f"{last.upper()}, {first.upper()}" in got[1] and name in got[2]
    assert first in pii.FEMALE
    digits = lambda s: "".join(c for c in s if c.isdigit())
    assert digits(got[1].rsplit(" on ", 1)[1]) == digits(got[2].split("Call ")[1])


def test_colliding_entities_stay_distinct(spark, monkeypatch):
    monkeypatch.setattr(pii, "stand_in", lambda kind, value, key, attempt: f"same{attempt // 9}")
    df = spark.createDataFrame([("NAME", f"n{k}") for k in range(20)], "pii_type string, entity string")
    made = [r.made for r in pii.surrogate_map(df, "k").collect()]
    assert len(made) == len(set(made)) == 20


def test_tables(spark):
    empty = spark.createDataFrame([], "section_id bigint, section_text string")
    assert pii.pii_spans(empty, "section_id", "section_text").count() == 0
    assert pii.surrogates(empty, "section_id", "section_text", "key").count() == 0


def _put(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "section_id bigint, section_text string")
    return [r.surrogate_text for r in pii.surrogates(df, "section_id", "section_text", "key", **more).orderBy("section_id").collect()]


def test_one_person_keeps_surname_initial_and_gender_in_both_tables(spark):
    texts = ["Seen by Runa Northule.", "Mrs. Northule left.", "Seen by R. Northule.", "Mr. Ona Hulnolt left.", "Seen by Ona Hulnolt."]
    sentences = spark.createDataFrame([(7, "Contact is NORTHULE, RUNA on 318-555-0176."), (8, "Mr. Ola Dravaar left."), (9, None)], "sentence_id bigint, sentence_text string")
    sections = spark.createDataFrame([*enumerate(texts), (5, "Seen by Ola Dravaar.")], "section_id bigint, section_text string")
    full, title, short, titled, plain, other = _put(spark, [*texts, "Seen by Ola Dravaar."], also=((sentences, "sentence_id", "sentence_text"),))
    first, last = full.removeprefix("Seen by ").strip(".").split(" ")
    assert title == f"Mrs. {last} left." and short == f"Seen by {first[0]}. {last}." and "Northule" not in full
    assert titled == "Mr. " + plain.removeprefix("Seen by ").strip(".") + " left." and plain.split(" ")[2] in pii.MALE
    assert other.split(" ")[2] in pii.MALE  # the title stands in the other table only
    got = {r.sentence_id: r.surrogate_text for r in pii.surrogates(sentences, "sentence_id", "sentence_text", "key", also=((sections, "section_id", "section_text"),)).collect()}
    assert got[7].startswith(f"Contact is {last.upper()}, {first.upper()} on ") and got[9] is None


def test_addresses_keep_their_format_and_names_their_script(spark):
    english, german, spanish, name = _put(spark, ["Runa Hulnolt lives at Flat 1b, 802 Lindfold Road, Hathmoor.", "Orla Hulnolt wohnt in der Am Lindfoldweg 161, 00891 Hathmoor.", "P. Hulnolt vive en Calle Harth, 642, 2.º B, 00556 Lindquell.", "Kontakt: Анна Петрова."])
    import re

    e = re.fullmatch(r"\w+ (\w+) lives at Flat \d[a-z], \d{3} ([A-Z]\w+) Road, ([A-Z]\w+)\.", english)
    g = re.fullmatch(r"\w+ (\w+) wohnt in der Am ([A-Z]\w+)weg \d{3}, \d{5} ([A-Z]\w+)\.", german)
    assert e and g and e.groups() == g.groups() and "Lindfold" not in english
    assert re.fullmatch(r"[A-Z]\. \w+ vive en Calle [A-Z]\w+, \d{3}, \d\.º B, \d{5} [A-Z]\w+\.", spanish)
    assert re.fullmatch(r"Kontakt: [А-Я][а-я]+ [А-Я][а-я]+\.", name) and "Петрова" not in name


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("I spoke with Maria Gonzalez yesterday", [("NAME", "Maria Gonzalez")]),
        ("The patient, Robert Brown, came in.", [("NAME", "Robert Brown")]),
        ("联系人：王芳 电话 13812345678", [("NAME", "王芳"), ("PHONE", "13812345678")]),
        ("住址：北京市朝阳区建国路88号3号楼1201室。", [("ADDRESS", "北京市朝阳区建国路88号3号楼1201室")]),
        ("東京都新宿区西新宿2丁目8番1号に住む", [("ADDRESS", "東京都新宿区西新宿2丁目8番1号")]),
        ("患者の山田太郎さんは", [("NAME", "山田太郎")]),
        ("زار السيد محمد علي العيادة", [("NAME", "محمد علي")]),
        ("डॉ. रमेश शर्मा ने सलाह दी", [("NAME", "रमेश शर्मा")]),
        ("डॉ. ने सलाह दी।", []),
        ("นาย สมชาย ใจดี มาพบแพทย์", [("NAME", "สมชาย ใจดี")]),
        ("Paul Bunnell score 3 and Foley catheter.", []),
        ("Mail " + "a" * 300 + "@" + "b" * 200 + ".example.org now.", [("EMAIL", "a" * 300 + "@" + "b" * 200 + ".example.org")]),
        ("At 12 " + "Very" * 40 + " Long Street, " + "Spring" * 20 + " 12345 today.", [("ADDRESS", "12 " + "Very" * 40 + " Long Street, " + "Spring" * 20 + " 12345")]),
    ],
)
def test_spans_in_other_scripts_and_of_any_length(text, wanted):
    assert [(k, text[a:b]) for k, a, b in pii.find_pii(text)] == wanted


def test_labels_of_extensions_stay(spark):
    made = _put(spark, ["Call 505 555 0193 ext. 12 or 505-555-0194 x99."])[0]
    import re

    assert re.fullmatch(r"Call \d{3} \d{3} \d{4} ext\. \d\d or \d{3}-\d{3}-\d{4} x\d\d\.", made) and "555 0193" not in made


def test_middle_initials_tell_persons_apart(spark):
    a, b = _put(spark, ["Seen by John A. Hulnolt.", "Seen by John B. Hulnolt."])
    assert a != b and a.split()[2] == b.split()[2] and a.split()[-1] == b.split()[-1]


def test_a_map_is_carried_from_run_to_run(spark):
    one = spark.createDataFrame([("NAME", f"n{k}") for k in range(300)], "pii_type string, entity string")
    two = spark.createDataFrame([("NAME", f"n{k}") for k in range(250, 900)], "pii_type string, entity string")
    first = pii.surrogate_map(one, "k")
    both = pii.surrogate_map(two, "k", known=first)
    kept = {r.entity: r.made for r in first.collect()}
    got = {r.entity: r.made for r in both.collect()}
    assert len(got) == 900 == len(set(got.values())) and all(got[e] == m for e, m in kept.items())
    assert pii.surrogate_check(both).first().collisions == 0
