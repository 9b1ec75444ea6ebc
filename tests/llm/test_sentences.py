"""Sentence boundaries: literal cases in nine languages, layouts, defined results."""

import pytest

from chartloom.llm.sentences import WordLattice, segment, split_sentences

CASES = [
    ["Dr. on call gave aspirin at 4:26 a.m. around midnight and left.", "pt seen on Monday."],
    ["Given p.o. aspirin at 7:15 p.m.", "pt seen late."],
    ["Given p.o. aspirin at 7:15 p.m.", "Bilateral effusion vs. oedema was debated, e.g. because zinc stayed at 7.0."],
    ['The man said "it was thirst. Then came a rash." at rest and left.', "He slept."],
    ["(Zinc fell to 31.3 on day 3.)", "The U.S. clinic chose it."],
    ["He was well until the visit... then thirst set in.", "will book a scan in 2010.", "Fig. 119 and no. 136 show it."],
    ["Follow-up:", "2) aspirin 155 mg p.o.", "Meds on arrival", "Two tabs were missed;\nthen none: so be it."],
    ["Was it held twice?!", "the nurse left!"],
    ["Am 136. Tag bestand Durst.", "Der Patient sagte: „Fieber ist weg. Jetzt kommt Durst.“ und nahm z. B. nichts."],
    ["Le patient a dit « j'ai un prurit. Je veux une visite. » ce soir.", "M. le voisin dort, c.-à-d. bien.", "Est-ce vrai ?"],
    ["La Sra. del cuarto 3 dijo «tengo fiebre. Quiero agua.» al ingreso.", "¡Mejoró, p. ej. por la tarde!"],
    ["患者说：“干咳已经三天了。现在还有干咳。”周一家访一次。", "Aspirin是否引起口渴？"],
    ["男性は「空咳がある。耳鳴りもつらい。」と回診時に話した。", "動悸が悪化！"],
    ['महिला ने कहा "मुझे प्यास है। घबराहट भी है।" और सो गया।', "डॉ. ने सलाह दी।"],
    ["قال الشاب «عندي حمى. أريد الراحة.» ثم نام.", "نصح د. المناوب صباحا بالراحة.", "هل سبب aspirin عطش؟"],
    ["ผู้ป่วยได้รับยา aspirin 21.2 mg วันจันทร์เพราะปวดไต", "พบก้อนกลมขนาด 5.3 cm ที่สะโพกขวา", "ก่อนตรวจหยุดยา aspirin เพราะมีเวียนหัว"],
]


def own_line(wanted):
    """Headings, and items without a full stop, need lines of their own."""
    return any(x.endswith((":", "arrival", "p.o.")) for x in wanted)


@pytest.mark.parametrize("wanted, join", [(w, j) for w in CASES for j in (" ", "\n", "\n\n") if j != " " or not own_line(w)])
def test_sentences(wanted, join):
    text = "  " + join.join(wanted) + " \n"
    assert [text[a:b] for a, b in segment(text)] == wanted


def test_missing_blank_and_wrapped_lines():
    text = "She felt\nhot flushes.After 3 doses it ended"
    assert [text[a:b] for a, b in segment(text)] == ["She felt\nhot flushes.", "After 3 doses it ended"]


def test_lattice_prefers_known_words():
    assert WordLattice(["ab", "abc", "cd"]).split("abcd") == ["ab", "cd"]


@pytest.mark.parametrize("text", ["", " \n\t", "...", "?!", '"', "(", "a" * 100_000, "x. " * 20_000, "(" * 3000, "“" * 3000])
def test_edges(text):
    spans = segment(text)
    assert all(0 <= a < b <= len(text) and text[a:b] == text[a:b].strip() for a, b in spans)
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_table(spark):
    df = spark.createDataFrame([(1, "A bee. See it.", "x"), (1, "A bee. See it.", "y"), (2, None, "z"), (3, " ", "z"), (None, "Quiet.", "z")], "section_id bigint, section_text string, spans string")
    got = split_sentences(df, "section_id", "section_text").collect()
    assert sorted((r.section_id or 0, r.sent_no, r.sent_start, r.sent_end) for r in got) == [(0, 0, 0, 6), (1, 0, 0, 6), (1, 1, 7, 14)]


@pytest.mark.parametrize(
    "wanted",
    [
        ["患者夜间诉头痛", "周一复查血常规正常", "医生建议继续服用aspirin"],
        ["女性はめまいを訴えている", "吐き気が検査前に悪化", "肝臓に結節を認める。", "今朝は安定した"],
        ["患者诉 头痛和 恶心"],  # blanks within a statement
        ["患者因 心悸停用aspirin 并 观察尿量"],
        ["男性は 食後から かゆみを 訴えている"],
        ["患者说：“头痛已经三天了 现在还有干咳。”"],
    ],
)
@pytest.mark.parametrize("blank", [" ", "\u3000"])
def test_blanks_between_chinese_and_japanese_statements(wanted, blank):
    text = blank.join(wanted)
    assert [text[a:b] for a, b in segment(text)] == wanted


@pytest.mark.parametrize(
    "wanted",
    [
        ["We met at 5 p.m. yesterday.", "She left at 6 p.m. quietly and slept."],
        ["She works at Acme Inc.", "He does not.", "Acme Inc. Boston sent it."],
        ["患者は頭痛を訴えた", "熱はなかった", "帰宅した"],
        ["今天天气很好", "我去散步", "然后回家"],
    ],
)
def test_what_surrounds_a_terminator_decides(wanted):
    text = " ".join(wanted)
    assert [text[a:b] for a, b in segment(text)] == wanted


def test_the_best_path_beats_any_other():
    """Against all paths through the nodes of short texts."""
    import itertools

    from chartloom.llm.sentences import _LONE_MARKER, W, best_path, nodes

    for text in ["1. Take it. 2. Leave it. 3 4. Go.", "He (well. now) slept. 2. pt ran! 3. 4. Oh.", "A. b. c! D... e? 5. F"]:
        places = nodes(text)

        def total(path):
            stop, out = 0, 0.0
            for n in path:
                if n.at < stop:
                    return -1e9
                out += n.score + (W["marker"] if _LONE_MARKER.fullmatch(text[stop : n.at]) else 0)
                stop = n.stop
            return out

        most = max(total(c) for r in range(len(places) + 1) for c in itertools.combinations(places, r))
        assert total(best_path(text, places)) == most


def test_quotations_and_words_of_any_length():
    long = "„" + "Es ist warm. " * 300 + "Gut.“"
    text = f"Er sagte: {long} und ging. Sie blieb."
    assert [text[a:b] for a, b in segment(text)] == [f"Er sagte: {long} und ging.", "Sie blieb."]
