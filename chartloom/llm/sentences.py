"""Sentence boundaries in nine languages.

Spaced scripts: a lattice of terminators. Each terminator run, line break and (in spaceless scripts) blank is a node with a
score, the sum of the weights of what stands around it: the mark, the word before (abbreviation, title, initial, ordinal),
the word after (case, digit, what opens or continues a sentence), quotations and brackets that are open there. An edge
between two nodes is a sentence; edges that hold nothing but a list marker cost. The path of the greatest sum through nodes
and edges gives the sentences. Spaceless scripts (Thai, Chinese, Japanese): where no terminator stands, a dictionary word
lattice segments the text on both sides of a gap, and the gap's score comes from the words that end before it and open
after it (final particles, predicates, opening and connecting words).

Defined results: null or blank text gives no sentence; repeated ids give one result; texts of any length are processed
whole; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations before a name, number or word that belongs to them.
NEVER_FINAL = frozenset(
    """dr mr mrs ms prof st fig no nos temp resp approx vs e.g i.e u.s u.k ca env z.b d.h u.a c.-à-d p.ej ej p j sra sr
    sres aprox tel tél ext rd nr bzw ggf inkl evtl av avda c.f cf vol pp ref abb mme mlle hr fr
    d.ª dª núm pág art cap""".split()
)
# Abbreviations at the end of names of firms and persons; a word that opens a sentence ends one after them.
NAME_FINAL = frozenset("inc ltd co corp llc plc bros jr esq dept bd gmbh ag".split())
# Abbreviations that may end a sentence; the following word decides.
MAY_BE_FINAL = frozenset("etc p.o i.v s.c i.m t.i.d b.i.d q.i.d q.h.s p.r.n a.m p.m o.d q.d usw u.s.w".split())
# Capitalised words that open a sentence.
OPENERS = frozenset(
    """the a an he she it they we i you this that these those there his her its their our my your in on at by for from with when while after before since if as but and so no not
    er sie es wir ihr der die das ein eine dieser diese dieses il elle ils elles nous vous le la les un une ce cette ces el ella ellos ellas los las una este esta""".split()
)
# Persons that a sentence in lower case may begin with, even after a dose.
SUBJECTS = frozenset("pt pts patient he she they we".split())
# Words that carry a clause on after a clock time: prepositions, conjunctions, auxiliaries, adverbs of time
# and manner.
ADVERBIAL = re.compile(
    r"(?:on|at|after|before|following|between|since|last|within|overnight|by|during|around|in|late|early|the (?:next|previous|same|following)|for|as|with|without|against|under|over|from|to|into|near|"
    r"until|till|through|throughout|toward|towards|upon|via|per|twice|once|again|daily|nightly|today|yesterday|tomorrow|tonight|sharp|each|every|next|prior|then|and|but|or|nor|because|so|while|when|where|"
    r"which|who|whom|whose|although|though|unless|if|than|was|were|is|are|be|been|being|has|had|have|replaced|"
    r"an? (?:few|couple|fortnight|while|second|minute|hour|day|week|month|year)s?|[a-z]+ly)\b",
    re.I,
)
ARABIC_TITLES = frozenset(["د", "أ", "م"])
HINDI_TITLES = frozenset(["डॉ", "श्री"])
#: Weights of what stands around a terminator. A node of a sum above zero ends a sentence, unless an edge forbids it.
W = {
    "full stop": 2.0, "strong mark": 6.0, "ellipsis": 2.0, "end of text": 20.0, "no blank": -6.0, "no blank, new word": 8.0, "wide mark": 8.0, "long word": 4.0, "lower case": -8.0,
    "belongs to what follows": -8.0, "name ends": -4.0, "opening word": 5.0, "may end": -0.5, "number follows": -8.0, "subject follows": 8.0, "initial": -8.0, "ordinal": -8.0, "in quotation": -12.0,
    "line break": 4.0, "blank line": 20.0, "wrapped line": -4.0, "statement ends": 4.0, "statement goes on": -4.0, "pair closes": 4.0, "pair goes on": -4.0, "marker": -12.0,
}

THAI = "฀-๿"
CJK = "぀-ヿ㐀-鿿"
# Thai dictionary (function words, people, times, common clinical words).
THAI_WORDS = """ผู้ป่วย คนไข้ คุณ คุณยาย คุณตา คุณครู ชายหนุ่ม หญิงสาว ญาติ แพทย์ พยาบาล หมอ ครู ลูก สามี ภรรยา เด็ก ชาย หญิง คน เขา เธอ เรา
พบ มี ได้รับ ได้ รับ ยา หยุด หยุดยา เริ่ม เปลี่ยน แนะนำ ให้ ลด เพิ่ม งด เกลือ นอน ไม่ หลับ นอนไม่หลับ พัก ตรวจ ซ้ำ ผ้าพันแผล ผล เลือด ขนาด ก้อน กลม ก้อนกลม ถุงน้ำ บาง
รอยร้าว เก่า ที่ ใน บน ของ และ หรือ แต่ เพราะ เนื่องจาก โดย ว่า บอก กล่าว พูด ถาม แล้ว จึง จน เมื่อ เมื่อคืน เมื่อวาน วันนี้ วันจันทร์ วันอังคาร วันพุธ
วันพฤหัสบดี วันศุกร์ วันเสาร์ วันอาทิตย์ ตอนเช้า ตอนเย็น ตอนบ่าย ก่อน หลัง หลังอาหาร ก่อนอาหาร ก่อนตรวจ หลังตรวจ ก่อนนอน อาหาร สะโพก ขวา ซ้าย ไต ไหล่ ตับ
กระดูก กระดูกสันหลัง สันหลัง แผล กระเพาะ แผลในกระเพาะ ตา บวม ตาบวม ปวด ปวดไต เวียนหัว คลื่นไส้ ไอ แห้ง ไอแห้ง ใจสั่น คัน ผิวหนัง คันผิวหนัง ไข้ โทร โทรศัพท์ เบอร์
ติดต่อ ครับ ค่ะ คะ นะ จ้ะ เลย อีก อยู่ ไป มา เป็น คือ จะ ต้อง ควร อาจ กับ จาก ถึง ตั้งแต่ ระหว่าง วัน สัปดาห์ เดือน ปี ก่อนหน้า หมอนัด นัด อาการ ดีขึ้น แย่ลง ปกติ ทำให้
เกิด หรือไม่ ไหม อาการปวด ประวัติ แพ้ ผ่าตัด ล้ม หกล้ม หลังล้ม เข้า โรงพยาบาล เข้ารับการรักษา""".split()
# Thai words that carry a clause on after a gap, and time words that may do either.
THAI_CONTINUE = frozenset("ที่ ใน บน ของ และ หรือ แต่ เพราะ เนื่องจาก โดย ว่า แล้ว จึง จน กับ จาก ถึง ระหว่าง ทำให้ หรือไม่ ไหม ครับ ค่ะ คะ นะ จ้ะ เลย อีก".split())
THAI_TIME = frozenset(
    """เมื่อคืน เมื่อวาน วันนี้ วันจันทร์ วันอังคาร วันพุธ วันพฤหัสบดี วันศุกร์ วันเสาร์ วันอาทิตย์ ตอนเช้า ตอนเย็น ตอนบ่าย ก่อน หลัง
    หลังอาหาร ก่อนอาหาร ก่อนตรวจ หลังตรวจ ก่อนนอน หลังล้ม ตั้งแต่""".split()
)
THAI_CAUSE = frozenset("เพราะ เนื่องจาก".split())
# Thai words after which a clause cannot end.
THAI_OPEN_END = frozenset("ยา ขนาด ที่ ใน บน ของ และ หรือ แต่ เพราะ เนื่องจาก โดย ให้ ว่า เบอร์ โทร กับ จาก ถึง".split())
# Japanese and Chinese closing words and connecting words.
CJK_FINAL = frozenset("です ます ました でした だ た る い ない よ ね か 了 吗 呢 吧 啊 的 过 好 大 高 降 明".split())
CJK_CONTINUE = frozenset("は が を に で と へ も の や から まで より ため 并 和 但 而 且 因 由 在 的 与 及 或 后 时".split())
# Dictionary of the gaps between Chinese or Japanese words: closing words and predicates, words that want
# an object or carry a clause on, and other words that keep the lattice from cutting them.
JAPANESE_FINAL = frozenset(
    """です ます ました ません でした だ だった た ある いる ない なし なかった した する された される ている ていた である ください 認める 認めた 訴える 訴えた
    悪化 改善 軽快 消失 中止 継続 良好 安定 正常 陰性 陽性 よ ね か 帰宅 退院 入院 来院 受診 なかった だろう でしょう らしい ようだ そうだ 思う 思った 言う 言った 行く 行った 来る 来た 食べる 食べた 飲む 飲んだ 見る 見た
    寝る 寝た 起きる 起きた 痛い 痛む 痛んだ 高い 低い 多い 少ない 強い 弱い 良い 悪い""".split()
)
JAPANESE_CONTINUE = frozenset(
    """は が を に で と へ も の や から まで より ため ので のに けど けれど けれども ながら および 及び または 又は て し ば たら なら として について
    による により に対して""".split()
)
CHINESE_PREDICATES = frozenset(
    """是 为 有 无 没有 见 未见 可见 诉 主诉 否认 服用 口服 治疗 停用 停药 改为 观察 复查 检查 出现 加重 减轻 好转 恶化 缓解 消失 平稳 稳定 正常 异常 发现 提示 建议 给予 予 认为
    说 问 要求 拒绝 入院 出院 就诊 转诊 随访 发热 咳嗽 头痛 头晕 恶心 呕吐 腹痛 胸痛 疼痛 心悸 失眠 口渴 瘙痒 干咳 手抖 乏力 水肿 跌倒 升高 下降 增大 缩小 测得 显示 增加 减少
    开始 继续 需要 明显 良好 引起 导致 很好 不好 好 去 来 回家 回来 出去 进来 吃 喝 走 看 看见 看到 听 听见 做 写 买 卖 给 拿 带 住 坐 站 睡 睡觉 起床 休息 散步 工作 学习 上班 下班 回国 知道 觉得 喜欢 希望 担心
    害怕 感到 感觉 能 可以 应该 想 要 会 变 成为 成 死亡 痊愈 康复 手术 住院 接受 完成 结束 进行 存在 消退 复发 转移 流血 出血 发炎 肿胀 麻木 过敏 怀孕 呼吸 醒 哭 笑 高兴 难过 累 忙 痛 疼 冷 热 高 低 大 小 快 慢""".split()
)
CHINESE_OPEN_END = frozenset("是 为 有 无 没有 见 未见 可见 诉 主诉 否认 服用 口服 改为 出现 发现 提示 建议 给予 予 认为 说 问 要求 拒绝 测得 显示 开始 需要 引起 导致".split())
CHINESE_OPENERS = frozenset("然后 后来 接着 随后 我 你 他 她 它 我们 你们 他们 她们 患者 病人 医生 护士 今天 昨天 明天".split())
CHINESE_CONTINUE = frozenset("并 和 但 但是 而 而且 且 因 因为 由 由于 在 的 地 得 与 及 以及 或 或者 后 前 时 之后 之前 所以 因此 对 把 被 将 从 向 于 给 至 到 约 不 未 很 较 更 最".split())
_CJK_OTHER = """患者 病人 医生 护士 家属 男性 女性 老人 司机 教师 学生 今天 今早 昨天 昨晚 明天 夜间 早上 晚上 下午 周一 周二 周三 周四 周五 周六 周日 饭前 饭后 目前 现在 已经 病情 症状 血压
    体温 心率 血糖 血常规 尿量 积液 肿块 结节 大小 左侧 右侧 双侧 肝脏 肾脏 肺部 心脏 腹部 胸部 头部 患者さん 医師 看護師 家族 今朝 昨夜 昨日 今日 明日 夜間 月曜日 火曜日 水曜日 木曜日 金曜日
    土曜日 日曜日 食後 食前 回診時 検査前 検査後 転倒後 微熱 吐き気 頭痛 めまい 不眠 動悸 空咳 かゆみ 手の震え のど 渇き のどの渇き 声がれ 耳鳴り""".split()
# Headings that stand on a line of their own.
HEADING = re.compile(r"[^\W\d_][^\n.!?;,]{0,58}?(?:\s*:|\s+[-–—])?$")

_TERMINATORS = r"(?:[!?…।؟。！？]|\.(?!\d))[.!?…।؟。！？]*[)\]\"”“»」』）]*|\n\s*"
_CAND = re.compile(_TERMINATORS + rf"|[ \u00a0\u3000]+(?=[{THAI}{CJK}A-Za-z0-9])")
_CAND_NO_GAP = re.compile(_TERMINATORS)
_CJK_BLANK = rf"(?<=[{CJK}])[ \u00a0\u3000]+(?=[{CJK}])"
_CAND_CJK_GAP = re.compile(_TERMINATORS + "|" + _CJK_BLANK)
_HAS_CJK_BLANK = re.compile(_CJK_BLANK)
_CJK_RUN, _KANA = re.compile(rf"[{CJK}]+"), re.compile("[぀-ヿ]")
_OPENERS = re.compile("[«„“「『\"(\\[（]")
# What closes each opening quotation mark or bracket.
_CLOSERS = {"«": "»", "„": "“", "“": "”", "「": "」", "『": "』", '"': '"', "(": ")", "[": "]", "（": "）"}
_CLOSING = re.compile("[»“”」』\")\\]）]")
_DOTTED = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")
_LONE_MARKER = re.compile(r"\s*\d+\s*")
_ENDERS = re.compile(r"[.!?…।؟。！？]")
_ALNUM = re.compile(r"[^\W_]")
_MARKER = re.compile(r"(?:[-*•·–]|\d{1,3}[.)]|\(?[a-z]\)|[ivx]{1,4}[.)])[ \t ]+\S")
_NEXT = re.compile(r"[\s\"«„“”「『(\[¿¡'’*-]*")
_WORD = re.compile(r"[^\W_]+(?:\s+[^\W_]+)?")
_SPACELESS = re.compile(rf"[{THAI}{CJK}]")
_THAI = re.compile(rf"[{THAI}]")
_BLOB = re.compile(r"\S{40,}")
_STRONG = frozenset("!?।؟。！？")
_ORDINAL_LEAD = re.compile(r"(?<!\w)(?:am|vom|zum|beim|der|den|dem|des|die|das|im)\s+\d{1,3}$", re.I)


class WordLattice:
    """All dictionary words at all positions of a short text; the path with the fewest unknown characters, then the fewest
    words, is taken. Letters and digits of other scripts form one node each."""

    def __init__(self, words):
        self.words = frozenset(words)
        self.longest = max(map(len, self.words))

    def split(self, text: str) -> list[str]:
        n = len(text)
        best: list[tuple[int, int, int]] = [(0, 0, 0)] + [(1 << 30, 0, 0)] * n
        for i in range(n):
            unknown, count, _ = best[i]
            for j in range(i + 1, min(n, i + self.longest) + 1):
                known = text[i:j] in self.words
                if known or j == i + 1:
                    cost = (unknown + (0 if known else 1), count + 1, i)
                    if cost < best[j]:
                        best[j] = cost
        out, j = [], n
        while j:
            i = best[j][2]
            out.append(text[i:j])
            j = i
        return out[::-1]


@lru_cache(maxsize=1)
def _thai() -> WordLattice:
    return WordLattice(THAI_WORDS)


@lru_cache(maxsize=1)
def _cjk_words() -> WordLattice:
    return WordLattice(CJK_FINAL | CJK_CONTINUE | JAPANESE_FINAL | JAPANESE_CONTINUE | CHINESE_PREDICATES | CHINESE_CONTINUE | CHINESE_OPENERS | frozenset(_CJK_OTHER))


@lru_cache(maxsize=65536)
def _cjk_split(run: str) -> tuple[str, ...]:
    return tuple(_cjk_words().split(run))


@lru_cache(maxsize=65536)
def _thai_words(run: str) -> tuple[str, ...]:
    return tuple(_thai().split(run))


_THAI_RUN = re.compile(rf"[{THAI}]+")


def _thai_gap(text: str, at: int, after: int) -> bool:
    """Whether the gap text[at:after] ends a Thai statement."""
    left_thai = bool(_THAI.match(text[at - 1]))
    nxt = text[after]
    if not _THAI.match(nxt):
        if not left_thai:
            return False
        last = _thai_words(_tail(text, at))[-1]
        return not nxt.isdigit() and last not in THAI_OPEN_END and nxt.isupper()
    run = _THAI_RUN.match(text, after).group()
    words = _thai_words(run)
    first = words[0]
    if first in THAI_CONTINUE:
        return False
    if left_thai:
        return _thai_words(_tail(text, at))[-1] not in THAI_OPEN_END
    if first in THAI_TIME:  # after a dose: the time belongs to it, unless a clause of its own follows
        return not (len(words) == 1 or words[1] in THAI_CAUSE or words[1] in THAI_CONTINUE)
    return True


def _tail(text: str, at: int) -> str:
    """The run of Thai before a place."""
    i = at
    while i > 0 and "฀" <= text[i - 1] <= "๿":
        i -= 1
    return text[i:at]


def _cjk_tail(text: str, at: int) -> str:
    """The run of Chinese or Japanese before a place."""
    i = at
    while i > 0 and ("぀" <= text[i - 1] <= "ヿ" or "㐀" <= text[i - 1] <= "鿿"):
        i -= 1
    return text[i:at]


def _cjk_gap(text: str, at: int, after: int) -> bool:
    """Whether a line break between Chinese or Japanese text ends a statement."""
    left, right = _cjk_tail(text, at), _CJK_RUN.match(text, after)
    if not left:
        return False
    last, first = _cjk_split(left)[-1], _cjk_split(right.group())[0] if right else ""
    return (last in CJK_FINAL or last in JAPANESE_FINAL or last[-1] in CJK_FINAL) and last not in CJK_CONTINUE and first not in CJK_CONTINUE


def _statement(text: str, start: int, at: int) -> str:
    """The Chinese or Japanese statement before a place, blanks in it kept out."""
    return re.sub(rf"[^{CJK}]+", "", text[start:at])


def _cjk_blank(text: str, start: int, at: int, after: int) -> bool:
    """Whether the blanks text[at:after] between Chinese or Japanese characters end a statement that began at start."""
    left, right = _cjk_tail(text, at), _CJK_RUN.match(text, after).group()
    before, behind = _cjk_split(left), _cjk_split(right)
    if _KANA.search(left) or _KANA.search(right):
        ends = before[-1] in JAPANESE_FINAL or (len(before) > 1 and before[-1] in ("た", "だ", "る", "い"))
        return ends and before[-1] not in JAPANESE_CONTINUE and behind[0] not in JAPANESE_CONTINUE
    if before[-1] in CHINESE_CONTINUE or before[-1] in CHINESE_OPEN_END or behind[0] in CHINESE_CONTINUE:
        return False
    whole = before if any(w in CHINESE_PREDICATES for w in before) else _cjk_split(_statement(text, start, at))
    return any(w in CHINESE_PREDICATES for w in whole) and any(w in CHINESE_PREDICATES for w in behind)


# ---------------------------------------------------------------- nodes


def _terminator(text: str, lo: int, at: int, end: int, closers: bool) -> float:
    """The score of the terminator run text[at:end]; the sentence before it hardly begins before ``lo``."""
    n, mark = len(text), text[at]
    if end - at == 1 and mark == "." and end + 1 < n and text[end] == " " and text[end + 1].isupper():
        word = text[max(text.rfind(" ", lo, at) + 1, lo) : at]
        if len(word) > 6 and word.isalpha():
            return W["full stop"] + W["long word"]
    nx = _NEXT.match(text, end).end()
    if nx >= n:
        return W["end of text"]
    follower = text[nx]
    gap = text[end] in " \n\t\r\u00a0\u3000" if end < n else True
    cjk_next = bool(_SPACELESS.match(follower)) or bool(_SPACELESS.match(text[at - 1 : at] or " "))
    strong = mark in _STRONG or (mark == "." and any(c in _STRONG for c in text[at:end]))
    lower = follower.islower()
    if not gap:
        score = W["strong mark"] if strong else W["no blank"]
        if mark in "。！？":
            return W["wide mark"]
        if strong:
            return score + (0 if not follower.isalnum() or follower.isupper() or cjk_next else W["lower case"])
        left = text[max(lo, at - 5) : at]
        new = (
            mark == "."
            and end - at == 1
            and text[end].isupper()
            and text[end + 1 : end + 2].islower()
            and (len(left) >= 3 and left[-3:].isalpha() and left[-3:].islower() or left[-1:].isdigit() or left[-1:] == ")")
        )
        return score + (W["no blank, new word"] if new or closers and text[end].isupper() else 0)
    if strong:
        return W["strong mark"] + (W["lower case"] if closers and lower else 0)
    if mark == "…" or text.startswith("..", at):
        return W["ellipsis"] + (W["lower case"] if lower else 0)
    i = at
    while i > lo and not text[i - 1].isspace() and text[i - 1] not in "([\"«„“「":
        i -= 1
    word = text[i:at]
    key = word.lower().strip("([{'’")
    score = W["full stop"]
    if key in MAY_BE_FINAL or (closers and key.rstrip(".") in MAY_BE_FINAL):
        score += W["may end"]
        if follower.isdigit():
            return score + W["number follows"]
        if lower or (len(word) > 1 and word.isupper() and text[nx : nx + 4].isupper()):
            score += W["lower case"]
            opener = _WORD.match(text, nx)
            if opener and (key == "p.m" and not closers and not ADVERBIAL.match(text, nx) or opener.group().split()[0] in SUBJECTS and not ADVERBIAL.match(text, nx)):
                score += W["subject follows"]
        return score
    if key in NEVER_FINAL or key in ARABIC_TITLES or key in HINDI_TITLES:
        return score + W["belongs to what follows"]
    if key in NAME_FINAL:
        opener = _WORD.match(text, nx)
        opens = bool(opener) and follower.isupper() and opener.group().split()[0].lower() in OPENERS
        return score + W["name ends"] + (W["opening word"] if opens else 0)
    if len(key) == 1 and key.isalpha():
        return score + W["initial"]
    if key.isdigit() and len(key) <= 3 and follower.isupper() and _ORDINAL_LEAD.search(text, max(lo, at - 12), at):
        return score + W["ordinal"]
    if lower and (_DOTTED.fullmatch(key) or closers and text[end - 1] in "\"”“»」』"):
        return score + W["lower case"]
    if key.endswith("str") and follower.isdigit():
        return score + W["number follows"]
    return score


def _line_break(text: str, start: int, at: int, end: int) -> float:
    """The score of the line break text[at:end] in a sentence that began at start."""
    if end >= len(text) or text.count("\n", at, end) > 1:
        return W["blank line"]
    ls = text.rfind("\n", 0, at) + 1
    line = text[max(ls, start) : at].strip()
    if not line:
        return W["line break"]
    le = text.find("\n", end)
    nxt, after = text[end], text[end : le if le >= 0 else len(text)]
    if _MARKER.match(text, end) or _MARKER.match(line) and max(ls, start) <= start + 1:
        return W["line break"]
    if _BLOB.fullmatch(after.strip()) or _BLOB.fullmatch(line):
        return W["line break"]
    if nxt.islower():
        return W["line break"] if line.endswith(":") and len(line) < 40 and start >= ls else W["wrapped line"]
    if _SPACELESS.match(nxt) and _SPACELESS.match(line[-1]):
        ends = _thai_gap(text, at, end) if _THAI.match(nxt) else _cjk_gap(text, at, end) or bool(HEADING.fullmatch(line)) and len(line) < 8
        return W["statement ends"] if ends else W["wrapped line"]
    if line.isupper() and len(line) > 24 and after[:12].upper() == after[:12]:
        return W["wrapped line"]
    return W["line break"]


def _pairs(text: str) -> list[tuple[int, int]]:
    """Quotations and brackets that hold a terminator, outermost first; a mark without a partner in its paragraph is ignored."""
    where: dict[str, list[int]] = {}
    for m in _CLOSING.finditer(text):
        where.setdefault(m.group(), []).append(m.start())
    breaks = [m.start() for m in re.finditer("\n\n", text)]

    def first(mark: str, a: int, b: int) -> int:
        k = bisect_right(where.get(mark, ()), a)
        return where[mark][k] if k < len(where.get(mark, ())) and where[mark][k] < b else -1

    out: list[tuple[int, int]] = []
    done = 0
    for m in _OPENERS.finditer(text):
        a = m.start()
        if a < done:
            continue
        c = text[a]
        if c == '"' and a and text[a - 1].isalnum():
            continue
        k = bisect_right(breaks, a)
        end = breaks[k] if k < len(breaks) else len(text)
        b = first(_CLOSERS[c], a, end)
        if b < 0 and c == "„":
            b = max(first("”", a, end), first('"', a, end))
        elif c in "([" and b > 0:  # nesting
            depth = text.count(c, a + 1, b)
            while depth and b > 0:
                last, b = b, first(_CLOSERS[c], b, end)
                depth += text.count(c, last, b) - 1 if b > 0 else 0
        if b > 0 and _ENDERS.search(text, a, b):
            out.append((a, b + 1))
            done = b + 1
    return out


class Node:
    """A place where a sentence may end: text[at:end] is what ends it, ``stop`` its end, ``score`` its weight."""

    __slots__ = ("at", "score", "stop")

    def __init__(self, at: int, stop: int, score: float):
        self.at, self.stop, self.score = at, stop, score


def nodes(text: str) -> list[Node]:
    """All nodes of a text from left to right."""
    n, out = len(text), []
    thai = _THAI.search(text) is not None
    closed = _pairs(text)
    lo = k = 0  # lo: after the last node that is likelier than not
    while lo < n and text[lo].isspace():
        lo += 1
    for m in (_CAND if thai else _CAND_CJK_GAP if _HAS_CJK_BLANK.search(text) else _CAND_NO_GAP).finditer(text):
        at, end = m.span()
        if at < lo:
            continue
        while k < len(closed) and closed[k][1] <= at:
            k += 1
        inside = k < len(closed) and closed[k][0] < at
        c, stop = text[at], at
        if c == "\n":
            score = _line_break(text, lo, at, end) + (W["in quotation"] - W["blank line"] if inside else 0)
        elif c in " \u00a0\u3000":
            if _THAI.match(text[at - 1]) or _THAI.match(text[end]):
                ends = _thai_gap(text, at, end)
            elif _CJK_RUN.match(text[at - 1]) and _CJK_RUN.match(text[end]):
                ends = _cjk_blank(text, lo, at, end)
            else:
                continue
            score = (W["statement ends"] if ends else W["statement goes on"]) + (W["in quotation"] if inside else 0)
        elif inside:
            a, b = closed[k]
            if text[end:b].strip(" \u00a0)]\"”“»」』）"):
                score, stop = W["full stop"] + W["in quotation"], end
            else:  # the pair's own last terminator: a whole bracketed or quoted sentence ends with it
                nx = _NEXT.match(text, b).end()
                cased = nx >= n or text[nx].isupper()
                if a <= lo:
                    ends = nx >= n or text[a] in "([（" or not text[nx].islower()
                else:
                    ends = text[a] not in "([（" and cased and not _SPACELESS.match(text[a + 1])
                score, stop = W["pair closes"] if ends else W["pair goes on"], b
        else:
            score, stop = _terminator(text, lo, at, end, end - at > 1 and text[end - 1] in ")]\"”“»」』）"), end
        out.append(Node(at, stop, score))
        if score > 0 and not _LONE_MARKER.fullmatch(text[lo:at]):
            lo = max(stop, lo)
            while lo < n and text[lo].isspace():
                lo += 1
    return out


def best_path(text: str, places: list[Node]) -> list[Node]:
    """The nodes of the path with the greatest sum of scores and edges. Only edges that hold nothing but a list marker have
    a weight, and these are short, so that the best of all other edges is a running maximum."""
    best: list[tuple[float, int]] = []  # of each node: the sum of its path, and the node before
    top, waiting = (0.0, -1), []  # the best path whose last node stops at or before the place looked at
    for j, node in enumerate(places):
        while waiting and waiting[0][0] <= node.at:
            _, i = heapq.heappop(waiting)
            if best[i][0] > top[0]:
                top = (best[i][0], i)
        total, before = top
        stop = places[before].stop if before >= 0 else 0
        if _LONE_MARKER.fullmatch(text[stop : node.at]):
            # the best path ends just before a marker: its node and the others near it, each by its own edge
            total, before = -1e18, -1
            i = j - 1
            while True:
                if i < 0:
                    total, before = max((total, before), (0.0 + (W["marker"] if _LONE_MARKER.fullmatch(text[: node.at]) else 0), -1))
                    break
                if places[i].stop <= node.at:
                    lone = bool(_LONE_MARKER.fullmatch(text[places[i].stop : node.at]))
                    total, before = max((total, before), (best[i][0] + (W["marker"] if lone else 0), i))
                    if not lone and places[i].score > 0:
                        break
                i -= 1
        best.append((total + node.score, before))
        heapq.heappush(waiting, (node.stop, j))
    end = max(range(len(best)), key=lambda i: best[i][0], default=-1)
    out: list[Node] = []
    if end >= 0 and best[end][0] > 0:
        while end >= 0:
            out.append(places[end])
            end = best[end][1]
    return out[::-1]


def segment(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence of ``text``, blanks around it left out."""
    out: list[tuple[int, int]] = []
    start, n = 0, len(text)
    while start < n and text[start].isspace():
        start += 1
    for node in best_path(text, nodes(text)):
        e = node.stop
        while e > start and text[e - 1].isspace():
            e -= 1
        if e > start:
            if _ALNUM.search(text, start, e):
                out.append((start, e))
            elif out and "\n" not in text[out[-1][1] : start]:
                out[-1] = (out[-1][0], e)
        start = max(node.stop, start)
        while start < n and text[start].isspace():
            start += 1
    e = n
    while e > start and text[e - 1].isspace():
        e -= 1
    if e > start and _ALNUM.search(text, start, e):
        out.append((start, e))
    return out


_SPANS = "array<struct<sent_start:int,sent_end:int>>"


def split_sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per sentence: ``id_col``, ``sent_no`` (from 0), ``sent_start``, ``sent_end`` (characters, end exclusive).

    One Arrow pass over (id, text); repeated ids are reduced by their short span arrays, so texts are never shuffled.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"sent_start": s, "sent_end": e} for s, e in segment(t)] if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(spans, pa.list_(pa.struct([("sent_start", pa.int32()), ("sent_end", pa.int32())])))],
                names=["id", "spans"],
            )

    found = df.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull()).mapInArrow(run, f"id {kind}, spans {_SPANS}")
    one = found.groupBy("id").agg(F.first("spans").alias("spans"))
    return one.select(F.col("id").alias(id_col), F.posexplode("spans").alias("sent_no", "s")).select(id_col, "sent_no", "s.sent_start", "s.sent_end")
