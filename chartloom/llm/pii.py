"""Personal information in free text: spans, typed placeholders and keyed surrogates.

Detection finds email addresses, phone numbers, identity numbers, postal addresses and names of persons by their written
form and by the words around them, in nine languages. ``redact`` puts typed placeholders in their place. ``surrogates``
puts keyed, type-consistent stand-ins there: digits and letters of numbers go through a keyed permutation that keeps the
format; names get names of the same gender (by title, else by the given name's last letter), script and case; addresses
keep all but their proper words and numbers. Surnames, given names and words of addresses have stand-ins of their own, so
that one person or place keeps its stand-in however it is written and in whichever table.

Defined results: null or empty text gives no span and stays as it is; repeated ids give one result; texts are processed
whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartloom.runtime import cut_lineage, shuffle_parts

TYPES = ("EMAIL", "PHONE", "ID", "ADDRESS", "NAME")

_EMAIL = re.compile(
    r"(?<![\w.+%-])[a-z0-9](?:[a-z0-9._%+-]*[a-z0-9_])?"
    r"(?:\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?|\sat\s(?=[\w.-]+(?:\s|\s?[\[(])dot\b))"
    r"(?:[a-z0-9-]+(?:\.|\sdot\s|\s?[\[(]dot[\])]\s?))+[a-z]{2,24}(?![\w-])",
    re.I | re.A,
)
# Words that label an identity number.
_ID = re.compile(
    r"(?:(?<![\w/+])(?:ssn|social security(?: number| no\.?)?|mrn|medical record (?:number|no\.?)|nhs (?:number|no\.?)|national id(?: number| no\.?)?|health number|"
    r"health card(?: number| no\.?)?|passport(?: number| no\.?)?|driver'?s? licen[cs]e(?: number| no\.?)?|insurance (?:id|number|no\.?)|policy (?:number|no\.?)|"
    r"tax id|nif|nie|dni|tarjeta sanitaria|versicherten(?:nummer|-nr\.?)|ausweisnummer|personalausweis|steuer-?id|"
    r"numéro de sécurité sociale|n[°º] (?:de )?sécu(?:rité sociale)?|nir|passeport|carte d'identité)|身份证号?|病历号|医保号|患者番号|保険証番号|患者id)"
    r"[\s#:№°.]*(?:(?:no|nr|n[°º])\.?\s*)?[:#]?\s*"
    r"((?:[a-z]{1,4}[- ]?)?\d[\da-z]*(?:[- ]\d[\da-z]*){0,4}(?:-[a-z](?![a-z]))?)",
    re.I,
)
_PHONE = re.compile(
    r"(?<![\w@.+/-])(?:"
    r"(?:\+?1[-. ])?(?:\(\d{3}\)[ ]?|\d{3}[-. ])\d{3}[-. ]\d{4}"
    r"|\+\d{1,3}[-. ]?(?:\(\d{1,4}\)[-. ]?)?\d{1,5}(?:[-. /]\d{2,7}){1,5}"
    r"|\(0\d{1,4}\)[ ]?\d{3,8}(?:[- ]\d{1,6}){0,2}"
    r"|0\d{2,4}/[ ]?\d{5,9}"
    r"|0\d{3,4}[ ]\d{6}"
    r"|0\d(?:[. ]\d\d){4}"
    r"|0\d{9}|[2-9]\d{9}|1[3-9]\d{9}"
    r"|\d{3}-\d{4}"
    r")(?:,?[ ]?(?:x|ext\.?|poste|durchwahl)[ ]?\d{1,6})?(?![\w]|[-./]\d|,\d)",
    re.I,
)
# Words before a number that is no phone number.
_NOT_PHONE = re.compile(r"(?:\blots?|\bbatch|\bserial|\bs/n|\bref\.?|\bmodel|\bdevice|\bcatalog(?:ue)?|\bcharge|\blote|\bno\.|#)\s*[:#]?\s*$", re.I)

_TOWN = r"[^\W\d_][^\W\d_'’-]{2,}(?:[ -](?-i:[A-ZÀ-Þ])[^\W\d_]+(?=,?\s(?:[a-z]{2}\s)?\d{4}))?"
_STREET_WORD = r"[^\W\d_][\w'’.-]*"
_ADDRESS = re.compile(
    # house, street, town and code of English-speaking countries
    rf"(?<![\w-])(?:(?:flat|apt|apartment|unit|suite|room)\.?\s[\w-]{{1,5}},\s)?\d{{1,5}}[a-z]?\s(?:[nsew]\.?\s)?(?:{_STREET_WORD}\s){{1,3}}?"
    rf"(?:street|st|road|rd|lane|ln|avenue|ave|drive|close|way|court|ct|boulevard|blvd|place|terrace|square|crescent|row)\b\.?"
    rf"(?:,\s{_TOWN}(?:,?\s(?:[a-z]{{2}}\s)?\d{{4,6}}(?!\d))?)"
    rf"|(?<![\w.])p\.?\s?o\.?\sbox\s\d+,\s{_TOWN}(?:,?\s(?:[a-z]{{2}}\s)?\d{{4,6}}(?!\d))?"
    # German
    rf"|(?<![\w-])(?:(?:am|an der|im|zum|zur|auf dem|auf der)\s)?(?:[A-ZÄÖÜ]\w+\s)?[A-ZÄÖÜ]\w*(?:str\.|straße|strasse|weg|gasse|platz|allee|ring|ufer|damm)\s\d{{1,4}}[a-z]?,\s\d{{5}}\s{_TOWN}"
    # French
    rf"|(?<![\w-])\d{{1,4}}(?:\s(?:bis|ter|quater))?,?\s(?:rue|av\.|avenue|bd\.?|boulevard|place|chemin|allée|impasse|quai|route)\s(?:{_STREET_WORD}\s?){{1,4}},\s\d{{5}}\s{_TOWN}"
    # Spanish
    rf"|(?<![\w-])(?:calle|c/|avda\.|avenida|av\.|plaza|pza\.|paseo|camino)\s(?:{_STREET_WORD}\s?){{1,4}},?\s\d{{1,4}}(?:,\s\d{{1,2}}\.?[ºª]\s?\w{{1,2}})?,\s\d{{5}}\s{_TOWN}",
    re.I,
)
_W = r"[^\W\d_][^\W\d_'’]+"
_SUR = rf"{_W}(?:-{_W})?"
_INI = r"[^\W\d_]\."
_FULL = rf"(?:{_SUR},\s{_W}(?:\s{_INI})?|(?:{_INI}\s?){{1,3}}{_SUR}|{_W}(?:\s{_INI}){{0,2}}\s{_SUR})"
# Words before the name of a person.
_LEAD = re.compile(
    rf"(?<!\w)(?:pt|signed(?: by)?:?|seen by|letter cc|cc|next of kin|contact is|contact\s?:|please write to|reach the \w+,|angehörige:|kontakt:|"
    rf"contacto:|firmado por|signé(?: par)?|unterschrieben von|联系人[:：]|連絡先[:：])\s*({_FULL})",
    re.I,
)
_TITLES = r"(?<!\w)(?:dr|mr|mrs|ms|prof|frau|herrn?|mme|mlle|sra|sr|srta|dra)(?:\.\s?|\s)"
_TITLE = re.compile(rf"{_TITLES}({_FULL}|{_SUR})(?![\w@])", re.I)
_TITLE_SHORT = re.compile(rf"{_TITLES}({_SUR})(?![\w@])", re.I)
_TRAIL = re.compile(rf"(?<![\w@.-])({_FULL})(?=\s(?:lives at|lives in|resides|habite|wohnt|vive en)(?!\w))", re.I)
_BARE = re.compile(
    rf"\A\s*({_SUR})(?=\s(?:by phone\s\(|together\.|dejó el número|a laissé le numéro|geprüft\.|lives at|habite|wohnt in|vive en|\((?:ssn|mrn|passport|national id|driver|health|insurance)))", re.I
)
# Words before the full name of a person in running text.
_SAID_AT = (
    "spoke with ", "spoke to ", "speaking with ", "speaking to ", "talked to ", "talked with ", "met with ", "discussed with ", "reviewed with ", "accompanied by ", "escorted by ", "referred by ", "examined by ",
    "cared for by ", "reported by ", "according to ", "patient, ", "husband, ", "wife, ", "son, ", "daughter, ", "mother, ", "father, ", "brother, ", "sister, ", "neighbor, ", "neighbour, ", "partner, ",
    "caregiver, ", "surgeon, ", "physician, ", "nurse, ", "named ", "name is ", "name: ", "patient: ", "attending: ", "physician: ", "surgeon: ", "gesprochen mit ", "begleitet von ", "patientin, ",
    "habló con ", "acompañado por ", "acompañada por ", "acompañado de ", "acompañada de ", "paciente, ", "nombre: ", "parlé avec ", "parlé à ", "accompagné de ", "accompagnée de ", "accompagné par ", "accompagnée par ", "patiente, ", "nom : ",
)
_SAID = re.compile(rf"({_W}(?:\s{_INI}){{0,2}}\s{_SUR})(?!\w)")
# Common given names in several languages; one of them with a capitalised word after it is a person.
_GIVEN = frozenset(
    """James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Paul Andrew Kevin Brian George Edward Peter Henry Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah
    Karen Nancy Margaret Lisa Emily Emma Laura Helen Ruth Anna Maria José Juan Carlos Luis Miguel Javier Pedro Pablo Antonio Francisco Carmen Isabel Ana Lucía Elena Rosa Pilar Hans Klaus Jürgen Wolfgang Stefan Andreas Uwe Dieter
    Ursula Monika Petra Sabine Heike Ingrid Jean Pierre Michel Philippe Jacques Louis Marie Nathalie Isabelle Sophie Céline Mohammed Ahmed Fatima Aisha Ali Omar Hassan Raj Priya Amit Sunita Ravi Anil Yuki Hiroshi Kenji Wei Ming Li""".split()
)
_GIVEN_NAME = re.compile(rf"(?<![\w@.-])({'|'.join(sorted(_GIVEN, key=len, reverse=True))})((?:\s{_INI}){{0,2}}\s[A-ZÀ-Þ][^\W\d_]+(?:-[A-ZÀ-Þ][^\W\d_]+)?)(?![\w@]|\s(?:score|scale|sign|test|syndrome|disease|criteria|catheter|classification|staging|index))")
# Common Chinese and Japanese surnames, and the words before or after a name in other scripts.
_CHINESE = "欧阳|司马|上官|诸葛|[王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文]"
_JAPANESE = "佐藤|鈴木|高橋|田中|伊藤|渡辺|山本|中村|小林|加藤|吉田|山田|佐々木|山口|松本|井上|木村|林|斎藤|清水|山崎|森|池田|橋本|阿部|石川|山下|中島|石井|小川|前田|岡田|長谷川|藤田|後藤|近藤|村上|遠藤|青木|坂本"
_OTHER_NAMES = [
    re.compile(rf"(?:联系人|患者姓名|病人姓名|姓名|家属姓名|签名|医师签名|主治医师)\s*[:：]\s*((?:{_CHINESE})[一-鿿]{{1,2}})(?![一-鿿])"),
    re.compile(rf"(?<![一-鿿])((?:{_CHINESE})[一-鿿]{{1,2}})(?=先生|女士|小姐|医生|医师|护士长|主任|教授)"),
    re.compile(rf"(?:氏名|患者名|連絡先|担当医|署名)\s*[:：]\s*((?:{_JAPANESE})[ 　]?[一-鿿ぁ-んァ-ヶ]{{1,4}})(?![一-鿿])"),
    re.compile(rf"(?<![一-鿿])((?:{_JAPANESE})(?:[ 　]?[一-鿿]{{1,3}})?)(?=さん|様|氏(?![名])|先生|医師|看護師)"),
    re.compile(r"(?<![\u0621-\u064a])(?:السيدة|السيد|الدكتورة|الدكتور|الأستاذة|الأستاذ|الاسم\s*[:：]|اسم المريض\s*[:：]|اسم المريضة\s*[:：])\s+((?!ال)[\u0621-\u064a]{2,}(?:\s(?:بن|بنت|أبو|عبد)?\s?[\u0621-\u064a]{2,})?)"),
    re.compile(r"(?<![\u0900-\u097f])(?:श्रीमती|श्री|कुमारी|डॉ\.?|नाम\s*[:：]|रोगी का नाम\s*[:：])\s+((?!(?:ने|को|का|की|के|से|में|पर|और)(?![\u0900-\u097f]))[\u0900-\u097f]{2,}(?:\s(?!(?:ने|को|का|की|के|से|में|पर|और|है|थे|था|थी)(?![\u0900-\u097f]))[\u0900-\u097f]{2,})?)"),
    re.compile(r"(?<![ก-๙])(?:นางสาว|นาง|นาย|ด\.ช\.|ด\.ญ\.|ชื่อ\s*[:：])\s?((?!แพทย์|จ้าง)[ก-๙]{2,}\s[ก-๙]{2,})"),
]
_OTHER_ADDRESSES = [
    re.compile(r"(?:[一-鿿]{2,6}(?:省|自治区))?[一-鿿]{2,6}市(?:[一-鿿]{1,6}(?:区|县|镇))?[一-鿿]{1,12}?(?:大道|路|街|巷|弄|胡同)\s?\d+\s?(?:弄\s?\d+\s?)?号(?:院)?(?:\s?\d+\s?(?:号楼|栋|幢|单元|层|楼|室))*"),
    re.compile(r"(?:〒\s?\d{3}-?\d{4}\s*)?(?:東京都|北海道|(?:京都|大阪)府|[一-鿿]{2,3}県)[一-鿿ぁ-んァ-ヶー]{1,10}?(?:市|区|町|村|郡)[一-鿿ぁ-んァ-ヶー]{0,12}?[0-9０-９一二三四五六七八九十]+(?:丁目|番地|番|号|[-－ー−の][0-9０-９]+)+(?:[0-9０-９]+(?:番|号|[-－ー−][0-9０-９]+)*)*"),
]
_HAN, _NOT_LATIN = re.compile("[\u4e00-\u9fff]"), re.compile("[\u0600-\u06ff\u0900-\u097f\u0e00-\u0e7f\u4e00-\u9fff]")
# A text of one capitalised word and a full stop: a surname that a splitter cut off from its title.
_CUT_OFF = re.compile(r"\s*([A-ZÀ-Þ][a-zà-ÿ]{4,}(?:-[A-ZÀ-Þ][a-zà-ÿ]+)?)\.\s*")
# Small words that are never part of a name.
_STOP = frozenset(
    """on in of the le la les de del der die das dem den im am aus du des und and with for at by was is has had will who were are seen reports reported
    from to or our my his her their this that le voisin voisine señora garde guardia dienst zimmer chambre cuarto call duty patient said not no cc pt signed contact
    der aide-soignant un une une el los las con que qui que se va mit bei zu von vom par pour por para given denies refuses stable well nurse doctor team staff clinic service
    phone asked came went feels felt stopped started""".split()
)
_SAFE_AFTER = re.compile(
    r"\s\((?:ssn|mrn|passport|national|driver|health|insurance|dni)|,\s(?:staff|phone|by mail|tel|tél|tel\.)|\sand\s(?:mrs|mr)|\son\s[\d+(]|;|,\s(?:\d|flat|apt|p\.)|\.|\sby phone|\stogether|\s(?:lives|habite|wohnt|vive)",
    re.I,
)
# Literal anchors in lower case; the patterns above are only tried around them.
_EMAIL_AT = ("@", "(at)", "[at]", "( at )", "[ at ]")
_ID_AT = (
    "ssn", "social sec", "mrn", "medical rec", "nhs ", "national id", "health ", "passport", "driver", "insurance ", "policy ", "tax id", "nif", "nie", "dni",
    "tarjeta", "versicherten", "ausweis", "personalausweis", "steuer", "numéro de", "sécu", "nir ", "passeport", "carte d", "身份证", "病历号", "医保号", "患者番号", "保険証番号", "患者id",
)
_ADDRESS_AT = (
    "street,", " st,", " st.,", " road,", " rd,", " rd.,", " lane,", " ln,", " avenue,", " ave,", " ave.,", " drive,", " close,", " way,", " court,", " ct,", "boulevard", " blvd",
    " place", " terrace,", " square,", " crescent,", " row,", " box ", "str. ", "straße ", "strasse ", "weg ", "gasse ", "platz ", "allee ", "ring ", "ufer ", "damm ", " rue ",
    " av. ", " bd ", "chemin ", "allée ", "impasse ", "quai ", "route ", "calle ", "c/ ", "avda. ", "avenida ", "plaza ", "pza. ", "paseo ", "camino ", "avenue ",
)
_LEAD_AT = ("pt ", "signed", "seen by ", "letter cc ", "next of kin ", "contact is ", "contact :", "contact:", "please write to ", "reach the ", "angehörige:", "kontakt:", "contacto:", "firmado por ", "signé", "unterschrieben von ", "联系人", "連絡先")
_TITLE_AT = ("dr. ", "dr ", "mr. ", "mr ", "mrs. ", "mrs ", "ms. ", "ms ", "prof. ", "prof ", "frau ", "herr ", "herrn ", "mme ", "mme. ", "mlle ", "sra. ", "sr. ", "srta. ", "dra. ")
_TRAIL_AT = (" lives ", " resides", " habite ", " wohnt ", " vive en ")
_BARE_AT = re.compile(rf"\s*{_SUR}\s(?:by phone|together\.|dejó|a laissé|geprüft|lives at|habite|wohnt|vive|\()", re.I)


#: Words of a text that lie before and after the anchor of an address, a name or a number at most, by the patterns above.
_BEFORE, _AFTER = 10, 16
_LOCAL = re.compile(r"[a-z0-9._%+-]", re.I | re.A)


@lru_cache(maxsize=1)
def _automaton():
    """All anchors at once: (kinds of anchor, length) of each."""
    kinds: dict[str, list[str]] = {}
    for kind, anchors in (("email", _EMAIL_AT), ("id", _ID_AT), ("address", _ADDRESS_AT), ("lead", _LEAD_AT), ("title", _TITLE_AT), ("trail", _TRAIL_AT), ("said", _SAID_AT)):
        for a in anchors:
            kinds.setdefault(a, []).append(kind)
    found = ahocorasick.Automaton()
    for a, k in kinds.items():
        found.add_word(a, (k, len(a)))
    found.make_automaton()
    return found


def _spots(low: str) -> dict[str, list[tuple[int, int]]]:
    """(start, end) of the anchors of each kind, by their end; one pass over the text."""
    out: dict[str, list[tuple[int, int]]] = {}
    for end, (kinds, n) in _automaton().iter(low):
        for k in kinds:
            out.setdefault(k, []).append((end + 1 - n, end + 1))
    return out


def _back(text: str, i: int, words: int) -> int:
    """Where the ``words``-th word before a place begins, however long the words are."""
    for _ in range(words):
        while i > 0 and text[i - 1].isspace():
            i -= 1
        while i > 0 and not text[i - 1].isspace():
            i -= 1
    return i


_AHEAD = re.compile(rf"(?:\S*\s+){{0,{_AFTER}}}\S*")


def _emails(text: str, low: str, spots: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Addresses around each sign: the name before it is read back to its first letter, the rest by the pattern."""
    done = -1
    spelt = [m.start() for m in re.finditer(" at ", low)] if "dot" in low else []
    for i in sorted([*(x for x, _ in spots), *spelt]):
        j = i
        while j > 0 and text[j - 1] == " " and i - j < 1:
            j -= 1
        end = j
        while j > done + 1 and j > 0 and _LOCAL.match(text[j - 1]):
            j -= 1
        while j < end:
            m = _EMAIL.match(text, j)
            if m:
                yield m.span()
                done = m.end() - 1
                break
            while j < end and text[j] not in "._%+-":
                j += 1
            j += 1


def _name_ok(text: str, a: int, b: int, full: bool) -> bool:
    name = text[a:b]
    words = [w for w in re.split(r"[\s,.-]+", name) if w]
    if any(w.lower() in _STOP for w in words):
        return False
    long = [w for w in words if len(w) > 1]
    if not long:
        return False
    if all(w[0].isupper() for w in long):
        return True
    if any(w[0].isupper() for w in long) and not (len(long) == 2 and long[1][0].islower() and full):
        return full and bool(_SAFE_AFTER.match(text, b))
    return all(w.islower() for w in long) and bool(_SAFE_AFTER.match(text, b)) and (full or len(long[0]) > 4)


def find_pii(text: str) -> list[tuple[str, int, int]]:
    """(type, start, end) of each item, in text order and without overlaps."""
    out: list[tuple[str, int, int]] = []
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer: positions would shift
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)

    def add(kind: str, a: int, b: int) -> None:
        k = bisect_right(out, a, key=lambda x: x[1])
        if (not k or out[k - 1][2] <= a) and (k == len(out) or b <= out[k][1]):
            out.insert(k, (kind, a, b))

    spots = _spots(low)
    for a, b in _emails(text, low, spots.get("email", [])):
        add("EMAIL", a, b)
    for i, _ in spots.get("id", ()):
        m = _ID.match(text, i)
        if m and sum(c.isdigit() for c in m.group(1)) >= 5:
            add("ID", *m.span(1))
    for i in sorted({x for x, _ in spots.get("address", ())}):
        lo, hi = _back(text, i, _BEFORE), _AHEAD.match(text, i).end()
        for m in _ADDRESS.finditer(text, lo, hi):
            if (m.start() > lo or not lo) and (m.end() < hi or hi == len(text)):  # else another anchor sees more of it
                add("ADDRESS", *m.span())
    for m in _PHONE.finditer(text):
        a, b = m.span()
        if not _NOT_PHONE.search(text, _back(text, a, 3), a):
            add("PHONE", a, b)
    for i, _ in spots.get("lead", ()):
        m = _LEAD.match(text, i)
        if m and _name_ok(text, *m.span(1), True):
            add("NAME", *m.span(1))
    for i, _ in spots.get("trail", ()):
        for m in _TRAIL.finditer(text, _back(text, i, _BEFORE), i + 12):
            if _name_ok(text, *m.span(1), True):
                add("NAME", *m.span(1))
    for i, _ in spots.get("title", ()):
        m = _TITLE.match(text, i)
        if m and not _name_ok(text, *m.span(1), False):
            m = _TITLE_SHORT.match(text, i)
        if m and _name_ok(text, *m.span(1), False):
            add("NAME", *m.span(1))
    if (m := _CUT_OFF.fullmatch(text)) and _name_ok(text, *m.span(1), False):
        add("NAME", *m.span(1))
    elif _BARE_AT.match(text) and (m := _BARE.match(text)) and _name_ok(text, *m.span(1), False):
        add("NAME", *m.span(1))
    for i, j in spots.get("said", ()):
        m = _SAID.match(text, j) if not text[i - 1 : i].isalnum() else None
        if m and _name_ok(text, *m.span(1), True) and text[m.start(1)].isupper():
            add("NAME", *m.span(1))
    if not _GIVEN.isdisjoint(text.split()):
        for m in _GIVEN_NAME.finditer(text):
            if _name_ok(text, *m.span(), True):
                add("NAME", *m.span())
    if _NOT_LATIN.search(text):
        for kind, patterns in (("ADDRESS", _OTHER_ADDRESSES), ("NAME", _OTHER_NAMES)):
            for pattern in patterns:
                for m in pattern.finditer(text):
                    add(kind, *m.span(1 if kind == "NAME" else 0))
    return out


_SPANS = "array<struct<pii_type:string,start_pos:int,end_pos:int>>"
_SPANS_ARROW = pa.list_(pa.struct([("pii_type", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32())]))


def pii_spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per item: ``row_id``, ``pii_type``, ``start_pos``, ``end_pos`` (characters, end exclusive)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[dict(zip(("pii_type", "start_pos", "end_pos"), x)) for x in find_pii(t)] if t else None for t in b.column(1).to_pylist()]
            keep = [i for i, s in enumerate(spans) if s]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([spans[i] for i in keep], _SPANS_ARROW)], names=["row_id", "spans"])

    found = df.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull()).mapInArrow(run, f"row_id {kind}, spans {_SPANS}")
    one = found.groupBy("row_id").agg(F.first("spans").alias("spans"))
    return one.select("row_id", F.explode("spans").alias("s")).select("row_id", "s.*")


def redact(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` and ``clean_text``: each item replaced by its type in square brackets. Null text stays null."""
    kind = df.schema[id_col].dataType.simpleString()

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        parts, at = [], 0
        for k, a, b in find_pii(t):
            parts += [t[at:a], f"[{k}]"]
            at = b
        return "".join(parts) + t[at:] if at else t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([clean(t) for t in b.column(1).to_pylist()], pa.string())], names=["id", "clean_text"])

    found = df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, clean_text string")
    return found.groupBy("id").agg(F.max("clean_text").alias("clean_text")).withColumnRenamed("id", id_col)


# ---------------------------------------------------------------- surrogates

# Given names by gender, one for each initial letter, and syllables of surnames and streets.
FEMALE = "Alma Berta Carla Dina Elsa Flora Greta Hanna Ida Jana Karla Lena Mara Nora Olga Paula Quirina Rita Sara Tina Ursula Vera Wanda Xenia Yvonne Zoe".split()
MALE = "Albert Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Max Nils Otto Paul Quentin Robert Simon Tom Ulrich Viktor Werner Xaver Yannick Zeno".split()
ONSETS = "Al Bar Ber Bor Cal Cor Dal Del Dor Fal Fen Gar Hal Har Hol Jar Kar Lam Lar Mal Mar Mor Nel Ol Par Pel Ral Ren Sal Sel Tal Tor Ul Var Vel Wal".split()
CODAS = "ben berg by dahl den der don ette feld gard grove hall ham heim holt ley lin low man mark mere mond nes ner rick ridge rose son sted ston ter ton vale ville wick worth".split()


def _mac(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest()[:12], "big")


def permute(value: str, key: bytes) -> str:
    """A keyed permutation of all strings of one format: digits stay digits, letters letters, the rest stays. Different
    values of one format get different results, as each of the eight rounds is one-to-one."""
    where = [i for i, c in enumerate(value) if c.isdigit() or ("a" <= c.lower() <= "z")]
    sizes = [10 if value[i].isdigit() else 26 for i in where]
    nums = [int(value[i]) if value[i].isdigit() else ord(value[i].lower()) - 97 for i in where]
    shape = "".join("9" if s == 10 else "A" for s in sizes)
    half = len(nums) // 2
    spans = ((0, half), (half, len(nums)))
    for r in range(8):
        (a, b), (c, d) = spans[r % 2], spans[1 - r % 2]
        n = _mac(key, "fpe", shape, r, nums[c:d])
        for i in range(a, b):  # add n in mixed radix, modulo the half's size
            n, nums[i] = divmod(n + nums[i], sizes[i])
    out = list(value)
    for i, s, x in zip(where, sizes, nums):
        out[i] = str(x) if s == 10 else (chr(97 + x).upper() if value[i].isupper() else chr(97 + x))
    return "".join(out)


# Per script, syllables that open and close a surname, and given names (women's, men's).
SCRIPTS = {
    "CYRILLIC": ("Бар Вел Гор Дан Зар Кор Лад Мар Нов Рад Сав Тар".split(), "анов енко ецкий ин ич ов овский ук".split(), "Анна Вера Дарья Нина".split(), "Борис Виктор Глеб Олег".split()),
    "GREEK": ("Αλ Βαρ Γερ Δημ Καρ Λαμ Μαρ Νικ Παν Ροδ Σαμ Θεο".split(), "άκης ίδης όπουλος άτος έας ινός".split(), "Άννα Ελένη Μαρία Σοφία".split(), "Άρης Ηλίας Νίκος Πέτρος".split()),
    "ARABIC": ("بد جم حس رش سل شر طه عم فر كم مر نص".split(), "ان اوي ين ور يل ام ير اد".split(), "أمل سلمى ليلى هدى".split(), "أحمد خالد سامي عمر".split()),
    "HEBREW": ("אל בר גל דר הר כר לב מר נב סל רם תל".split(), "וני מן סקי ברג יאל ון".split(), "דנה מיכל נועה רות".split(), "אורי דוד יואב רון".split()),
    "DEVANAGARI": ("अग बन चन दे गु जो कु मे ना पा रा शा".split(), "र्मा वाल कर नी रिया ठी ल्ला न्दन".split(), "अनीता गीता रेखा सीमा".split(), "अजय राजेश विजय सुरेश".split()),
    "THAI": ("บุญ ชัย ดวง แก้ว มณี พงษ์ รัตน์ ศรี ทอง วงศ์".split(), "กุล ชัย เดช ธรรม พันธ์ วัฒน์ สุข".split(), "กานดา นารี มาลี สุดา".split(), "ชาติ ประสิทธิ์ วิชัย สมชาย".split()),
    "HANGUL": ("김 이 박 최 정 강 조 윤 장 임".split(), "가람 나루 다온 새봄 한결 해솔".split(), "미영 서연 수진 지은".split(), "민수 성호 준영 현우".split()),
    "CJK": ("王 李 张 刘 陈 杨 赵 黄 周 吴 徐 孙".split(), "安 博 诚 德 光 海 建 乐 明 宁 平 文".split(), "丽 芳 静 梅".split(), "刚 军 强 伟".split()),
    "KATAKANA": ("アオ イシ ウエ オカ カワ キム サト タカ ナカ ハヤ マツ ヤマ".split(), "ダ ベ ノ ムラ モト タニ サワ シマ".split(), "アヤ ナナ ハナ ユミ".split(), "ケン タロウ ヒロ リョウ".split()),
    "HIRAGANA": ("あお いし うえ おか かわ きむ さと たか なか はや まつ やま".split(), "だ べ の むら もと たに さわ しま".split(), "あや なな はな ゆみ".split(), "けん たろう ひろ りょう".split()),
}
# Titles by gender, words that an address keeps, and endings of German streets.
_FEMALE_TITLE = re.compile(r"(?<!\w)(?:mrs|ms|frau|mme|mlle|sra|srta|dra)(?:\.\s?|\s)$", re.I)
_MALE_TITLE = re.compile(r"(?<!\w)(?:mr|herrn?|sr)(?:\.\s?|\s)$", re.I)
_FORMAT = frozenset(
    """flat apt apartment unit suite room street st road rd lane ln avenue ave drive close way court ct boulevard blvd place terrace square crescent row p o po box n s e w
    am an der im zum zur auf dem bis ter quater rue av bd chemin allée impasse quai route de la le les du des d l calle c avda avenida plaza pza paseo camino el los las del
    str straße strasse weg gasse platz allee ring ufer damm""".split()
)
_GERMAN_END = re.compile(r"(?<=\w\w\w)(?:straße|strasse|str(?=\Z)|weg|gasse|platz|allee|ring|ufer|damm)\Z", re.I)
_ADDRESS_PART = re.compile(r"\w*\d\w*|[^\W\d_]+")


def script(value: str) -> str:
    """The script of the first letter, LATIN if it has no names here."""
    name = next((unicodedata.name(c, "") for c in value if c.isalpha()), "")
    return next((k for k in SCRIPTS if name.startswith(k)), "LATIN")


def canonical(kind: str, value: str) -> str:
    """What two spellings of one entity have in common."""
    v = re.sub(r"\s+", " ", value).strip().lower()
    if kind == "EMAIL":
        return re.sub(r"\s?[\[(]dot[\])]\s?|\sdot\s", ".", re.sub(r"\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?|\sat\s", "@", v))
    if kind == "PHONE":  # labels of an extension are no part of the number
        return re.sub(r"[^0-9]", "", v)
    if kind == "ID":
        return re.sub(r"[^0-9a-z]", "", v)
    return v


def name_parts(value: str) -> tuple[str, list[str]]:
    """The surname and the given names and initials (without full stop), in lower case."""
    v = re.sub(r"\s+", " ", value).strip().lower()
    last, comma, first = v.partition(",")
    if not comma:
        first, _, last = re.sub(r"\.(?=\w)", ". ", v).rpartition(" ")
    return last.strip(), [w.strip(".") for w in first.split() if w.strip(".")]


def address_parts(value: str) -> list[tuple[int, int, str]]:
    """(start, end, entity) of the parts of an address that are replaced: numbers, and words that are no format words."""
    out = []
    for m in _ADDRESS_PART.finditer(value):
        a, b = m.span()
        w = m.group()
        if any(c.isdigit() for c in w):
            out.append((a, b, ""))
        elif len(w) > 1 and w.lower() not in _FORMAT:
            if (e := _GERMAN_END.search(w)) and re.match(r"\.?\s\d", value[b:]):
                b = a + e.start()
            out.append((a, b, value[a:b].lower()))
    return out


def pieces(kind: str, original: str, before: str) -> list[dict]:
    """The entities whose stand-ins make up that of one span, and what is said of their gender (1 a woman's, -1 a man's)."""
    if kind == "NAME":
        last, given = name_parts(original)
        said = 1 if _FEMALE_TITLE.search(before) else -1 if _MALE_TITLE.search(before) else 0
        return [{"pii_type": "NAME", "entity": last, "gender": 0}] + [{"pii_type": "GIVEN", "entity": f"{last}|{g}", "gender": said} for g in given if len(g) > 1]
    if kind == "ADDRESS":
        return [{"pii_type": "PLACE", "entity": e, "gender": 0} for *_, e in address_parts(original) if e]
    return [{"pii_type": kind, "entity": canonical(kind, original), "gender": 0}]


def _initial(last: str, letter: str, key: bytes) -> int:
    """The place in the lists of given names of a surname's initial letter; different letters differ as far as they can."""
    order = sorted("abcdefghijklmnopqrstuvwxyz", key=lambda c: _mac(key, "initial", last, c))
    return order.index(letter) if letter in order else _mac(key, "initial", last, letter)


def stand_in(kind: str, value: str, key: bytes, attempt: int) -> str:
    """The surrogate of a canonical value; a later attempt draws another one. A given name is ``surname|name|gender``."""
    n = _mac(key, kind, value, attempt)
    onsets, codas, female, male = SCRIPTS.get(script(value), (ONSETS, CODAS, FEMALE, MALE))
    tail = "".join(onsets[(n >> (40 + 6 * i)) % len(onsets)].lower() for i in range(min(attempt, 6)))
    if kind == "GIVEN":
        last, first, gender = value.split("|")
        onsets, codas, female, male = SCRIPTS.get(script(first), (ONSETS, CODAS, FEMALE, MALE))
        tail = "".join(onsets[(n >> (40 + 6 * i)) % len(onsets)].lower() for i in range(min(attempt, 6)))
        names = female if gender == "f" or not gender and first[-1] in "aeiyаяηα" else male
        return names[_initial(last, first[0], key) % len(names)] + tail
    if kind in ("NAME", "PLACE"):
        made = onsets[n % len(onsets)] + codas[(n >> 8) % len(codas)] + tail
        if "-" in value and kind == "NAME":
            made += "-" + onsets[(n >> 16) % len(onsets)] + codas[(n >> 24) % len(codas)]
        return made
    if kind == "EMAIL":
        return f"{(ONSETS[n % len(ONSETS)] + CODAS[(n >> 8) % len(CODAS)] + tail).lower()}{(n >> 16) % 9000 + 1000}@mail.example"
    return permute(value, key)


def _cased(original: str, made: str) -> str:
    return made.upper() if original.isupper() and len(original) > 1 else made.lower() if original.islower() else made


def dress(kind: str, original: str, made: list[str], key: bytes) -> str:
    """The surrogate in the written form of the original: order, initials, case, separators and format of an address.
    ``made`` has the stand-ins of ``pieces``."""
    if kind in ("PHONE", "ID"):
        chars = iter(made[0])
        own = (lambda c: c.isdigit()) if kind == "PHONE" else (lambda c: c.isalnum() and c.isascii())
        return "".join((c2.upper() if c.isupper() else c2) if own(c) and (c2 := next(chars, c)) else c for c in original)
    if kind == "NAME":
        last, given = name_parts(original)
        left = iter(made[1:])
        firsts = [next(left) if len(g) > 1 else FEMALE[_initial(last, g, key) % len(FEMALE)][0] + "." for g in given]
        text = f"{made[0]}, {' '.join(firsts)}" if "," in original else " ".join([*firsts, made[0]])
        return _cased(original, text)
    if kind == "ADDRESS":
        out, at, left = [], 0, iter(made)
        for a, b, entity in address_parts(original):
            part = original[a:b]
            out += [original[at:a], _cased(part, next(left)) if entity else permute(part, key)]
            at = b
        return "".join(out) + original[at:]
    return _cased(original, made[0])


def surrogate_map(spans: DataFrame, key: str, rounds: int = 3, known: DataFrame | None = None) -> DataFrame:
    """``pii_type, entity, made`` for all distinct entities of ``spans`` (pii_type, entity, and gender if known).

    The draws of an entity hang on the key and the entity alone. Entities that draw the same stand-in are told apart (given
    names within their surname): all but the first take their next draw, a longer form, up to ``rounds`` times; at last the
    rank is appended, so that distinct entities always stay distinct. Only such collisions hang on which entities there are;
    ``known``, the map of an earlier run, keeps its stand-ins and is added to the result, so that runs agree."""
    secret = key.encode()
    said = F.sum("gender") if "gender" in spans.columns else F.sum(F.lit(0))
    new = spans.groupBy("pii_type", "entity").agg(said.alias("said"))
    if known is not None:
        new = new.join(known.select("pii_type", "entity"), ["pii_type", "entity"], "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, values, genders = (b.column(k).to_pylist() for k in range(3))
            full = [f"{v}|{'f' if g > 0 else 'm' if g < 0 else ''}" if k == "GIVEN" else v for k, v, g in zip(kinds, values, genders)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[stand_in(k, v, secret, a) for a in range(rounds + 1)] for k, v in zip(kinds, full)], pa.list_(pa.string()))], names=["pii_type", "entity", "draws"])

    width = shuffle_parts(spans.sparkSession)
    dealt = new.repartitionById(width, F.pmod(F.xxhash64("pii_type", "entity"), F.lit(width)).cast("int"))  # never merged to few tasks
    todo = cut_lineage(dealt.mapInArrow(run, "pii_type string, entity string, draws array<string>")).withColumn("attempt", F.lit(0))
    if known is not None:
        todo = todo.unionByName(known.select("pii_type", "entity", F.array("made").alias("draws"), F.lit(-1).alias("attempt")))
    todo = todo.withColumn("scope", F.when(F.col("pii_type") == "GIVEN", F.substring_index("entity", "|", 1)).otherwise(""))
    made = F.get("draws", F.greatest("attempt", F.lit(0)))
    for _ in range(rounds):
        rank = Window.partitionBy("pii_type", "scope", made).orderBy("attempt", "entity")
        todo = todo.withColumn("n", F.row_number().over(rank)).withColumn("attempt", F.when((F.col("n") > 1) & (F.col("attempt") >= 0), F.col("attempt") + 1).otherwise(F.col("attempt")))
    todo = todo.withColumn("made", made)
    todo = todo.withColumn("n", F.row_number().over(Window.partitionBy("pii_type", "scope", "made").orderBy("attempt", "entity")))
    return todo.select("pii_type", "entity", F.when((F.col("n") > 1) & (F.col("attempt") >= 0), F.concat("made", F.lit("-"), F.col("n").cast("string"))).otherwise(F.col("made")).alias("made"))


def surrogate_check(made: DataFrame) -> DataFrame:
    """``pii_type, collisions, unchanged`` of a ``surrogate_map``: entities that share their stand-in with another one, and
    those that stand for themselves (given names aside, as theirs are taken from short lists)."""
    scope = F.when(F.col("pii_type") == "GIVEN", F.substring_index("entity", "|", 1)).otherwise("")
    same = F.count_if((F.col("pii_type") != "GIVEN") & (F.lower("made") == F.col("entity")))
    return made.groupBy("pii_type").agg((F.count("*") - F.count_distinct(scope, "made")).alias("collisions"), same.alias("unchanged"))


def known_entities(*tables: tuple[DataFrame, str, str]) -> DataFrame:
    """``pii_type, entity, gender`` of all items of the tables (each with its id and text column)."""
    out = None
    for t in tables:
        e = _entities(*t).select(F.explode("pieces").alias("p")).select("p.*")
        out = e if out is None else out.unionByName(e)
    return out


_ITEMS = "array<struct<pii_type:string,start_pos:int,end_pos:int,original:string,pieces:array<struct<pii_type:string,entity:string,gender:int>>>>"
_PIECES_ARROW = pa.list_(pa.struct([("pii_type", pa.string()), ("entity", pa.string()), ("gender", pa.int32())]))
_ITEMS_ARROW = pa.list_(pa.struct([("pii_type", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("original", pa.string()), ("pieces", _PIECES_ARROW)]))


def _entities(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The spans of each distinct row (row_id), with their text and ``pieces``; found once and written, as they are used twice."""
    kind = df.schema[id_col].dataType.simpleString()

    def items(t: str) -> list[dict]:
        return [{"pii_type": k, "start_pos": a, "end_pos": b, "original": t[a:b], "pieces": pieces(k, t[a:b], t[max(0, a - 8) : a])} for k, a, b in find_pii(t)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [items(t) if t else None for t in b.column(1).to_pylist()]
            keep = [i for i, x in enumerate(found) if x]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([found[i] for i in keep], _ITEMS_ARROW)], names=["row_id", "items"])

    found = df.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull()).mapInArrow(run, f"row_id {kind}, items {_ITEMS}")
    one = found.groupBy("row_id").agg(F.first("items").alias("items"))
    return cut_lineage(one.select("row_id", F.explode("items").alias("s")).select("row_id", "s.*"))


def surrogates(df: DataFrame, id_col: str, text_col: str, key: str, also: tuple[tuple[DataFrame, str, str], ...] = (), known: DataFrame | None = None) -> DataFrame:
    """``id_col`` and ``surrogate_text``: each item replaced by its stand-in under ``key``, which the caller keeps secret. The
    stand-ins are those of the entities of ``df`` and of the tables ``also`` (each with its id and text column) together, the
    same whichever of them is rewritten, and those of ``known``, the map of an earlier run. Whole texts cross the network
    once, to drop repeated ids and to meet their items."""
    secret = key.encode()
    base = df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("body")).dropDuplicates(["row_id"])
    spans = _entities(df, id_col, text_col)
    each = spans.select("row_id", "start_pos", F.posexplode_outer("pieces").alias("k", "p")).select("row_id", "start_pos", "k", "p.*")
    met = each.where("entity IS NOT NULL").select("pii_type", "entity", "gender")
    if also:
        met = met.unionByName(known_entities(*also))
    put = each.join(surrogate_map(met, key, known=known), ["pii_type", "entity"], "left").groupBy("row_id", "start_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "made"))), lambda x: x["made"]).alias("made"))
    dressed = spans.join(put, ["row_id", "start_pos"])
    dressed = dressed.withColumn("put", F.udf(lambda k, o, m: dress(k, o, list(m), secret), "string", useArrow=True)("pii_type", "original", "made"))
    per_row = dressed.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "put"))).alias("puts"))
    built = F.expr(
        "aggregate(puts, named_struct('at', 0, 'out', ''), (acc, x) -> named_struct('at', x.end_pos, 'out', concat(acc.out, substring(body, acc.at + 1, x.start_pos - acc.at), x.put)), acc -> concat(acc.out, substring(body, acc.at + 1)))"
    )
    return base.join(per_row, "row_id", "left").select(F.col("row_id").alias(id_col), F.when(F.col("puts").isNull(), F.col("body")).otherwise(built).alias("surrogate_text"))
