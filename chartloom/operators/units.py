"""Quantities recorded in different units, brought to one common unit per measured thing.

Numbers and unit spellings are read out of free text. A spelling of the lexicon means its unit. A spelling outside it is a
source of its own: it is taken for the one known unit that it resembles (one letter off, cut short or not), and else goes
through the graph of sources: its values and those of every known unit of the same measured thing are linked by their
quantiles (no row of the given tables stands for the same thing in two sources, see the README), scale and offset between
the two are estimated robustly (medians of pairwise slopes and of what they leave) and snapped to the nearest known
conversion, and the unit that the nearest source so proposes is taken if no other comes near it (``graph_units``). Only
spellings that some row has in its unit column can be units, so a stray word after a number never becomes one.
``spelling_check`` reports scale, offset and verdict of every spelling, those of the lexicon included.

Defined results: null or blank texts, texts without numbers, with number words that are not read, and numbers without a
usable unit give no quantity and are reported by ``unconverted``; repeated ids give one result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartloom.runtime import cut_lineage

# Known units: (kind, name, factor to the kind's base, offset), with their spellings. International pound,
# ounce, inch. base: mm, mL, g, K-free degree Celsius, mmol/L (substance), mg/L (mass), s.
_KNOWN = """
length mm 1 0: mm mms millimeter millimetre milimeter
length cm 10 0: cm cms centimeter centimetre
length dm 100 0: dm decimeter decimetre
length m 1000 0: m meter metre
length um 1/1000 0: um micron micrometer micrometre
length in 127/5 0: in inch inche "
length ft 1524/5 0: ft foot feet
volume mL 1 0: ml mls cc ccm milliliter millilitre
volume cL 10 0: cl centiliter centilitre
volume dL 100 0: dl deciliter decilitre
volume L 1000 0: l ltr lt liter litre
volume uL 1/1000 0: ul microliter microlitre
mass kg 1000 0: kg kgs kilo kilogram kilogramme
mass g 1 0: g gm gms gr gram gramme
mass mg 1/1000 0: mg mgs milligram milligramme
mass ug 1/1000000 0: ug mcg ugs microgram mikrogramm
mass ng 1/1000000000 0: ng nanogram
mass lb 45359237/100000 0: lb lbs pound
mass oz 45359237/1600000 0: oz ounce
mass st 45359237/7142.857142857143 0: stone
temperature degC 1 0: c celsius centigrade degc
temperature degF 5/9 -160/9: f fahrenheit degf
temperature K 1 -273.15: k kelvin
molar mmol/L 1 0: mmol/l mm mmol mmoll millimol/l mmols/l
molar umol/L 1/1000 0: umol/l micromol/l um umol umoll mcmol/l
molar mol/L 1000 0: mol/l
molar nmol/L 1/1000000 0: nmol/l nm
massconc mg/dL 10 0: mg/dl mg% mgdl mg/100ml mgs/dl
massconc g/L 1000 0: g/l gm/l
massconc g/dL 10000 0: g/dl g%
massconc mg/L 1 0: mg/l ug/ml mcg/ml
duration s 1 0: s sec secs second
duration min 60 0: min minute
duration h 3600 0: h hr hrs hour
duration d 86400 0: d day
"""
#: Kinds of unit that each quantity of the reference table takes.
_KINDS = {"length": ("length",), "volume": ("volume",), "weight": ("mass",), "dose": ("mass",), "mass": ("mass",), "temperature": ("temperature",), "concentration": ("molar", "massconc"), "duration": ("duration",), "time": ("duration",)}
# Units that are written together as one quantity, the larger first.
_COMPOUND = {("h", "min"), ("min", "s"), ("d", "h"), ("lb", "oz"), ("ft", "in"), ("kg", "g"), ("g", "mg"), ("L", "mL"), ("m", "cm"), ("cm", "mm"), ("st", "lb")}
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
_GLYPH = {"¼": Fraction(1, 4), "½": Fraction(1, 2), "¾": Fraction(3, 4), "⅓": Fraction(1, 3), "⅔": Fraction(2, 3), "⅛": Fraction(1, 8), "⅜": Fraction(3, 8), "⅝": Fraction(5, 8), "⅞": Fraction(7, 8), "⅕": Fraction(1, 5)}
NO_UNIT = frozenset(["", "unk", "unknown", "mixed", "n/a", "na", "none", "null", "?", "-", "--", "nan"])


def _known() -> tuple[dict, dict]:
    units: dict[str, tuple[str, Fraction, Fraction]] = {}
    spell: dict[tuple[str, str], str] = {}
    for line in _KNOWN.strip().splitlines():
        head, words = line.split(":")
        kind, name, factor, offset = head.split()
        if name == "st":
            factor = str(Fraction(45359237 * 14, 100000))
        units[name] = (kind, Fraction(factor), Fraction(offset))
        for w in words.split():
            spell[kind, w] = name
    return units, spell


UNITS, SPELLINGS = _known()

_WORDS = "|".join(sorted([*_ONES, *_TENS], key=len, reverse=True))
_SMALL = rf"(?:(?:{'|'.join(_TENS)})(?:[-\s](?:{'|'.join(_ONES[1:10])}))?|(?:{_WORDS}))"
_HUNDRED = rf"(?:(?:{_SMALL}|a)\s+hundred(?:\s+(?:and\s+)?{_SMALL})?)"
_SPELT = rf"(?:(?:{_HUNDRED}|{_SMALL}|a)\s+thousand(?:\s+(?:and\s+)?(?:{_HUNDRED}|{_SMALL}))?|{_HUNDRED}|{_SMALL})(?:\s+point(?:\s+(?:{'|'.join(_ONES[:10])}))+|\s+and\s+a\s+half)?"
# A comma before exactly three digits groups thousands, and so do full stops before a decimal comma or another group.
_NUM = r"(?:\d{1,3}(?:,\d{3})+(?!\d)(?:\.\d+)?|\d{1,3}(?:\.\d{3})+,\d+|\d{1,3}(?:\.\d{3}){2,}(?!\d)|\d+(?:[.,]\d+)?(?:e[+-]?\d{1,2}(?!\w))?|(?<!\d)\.\d+)"
_NUMBER = re.compile(
    rf"(?<![\w.,:])(?:(?P<hours>\d{{1,3}}):(?P<minutes>[0-5]\d)(?![\d:])|(?P<whole>\d+)(?:\s*-\s*|\s+)?(?P<glyph>[¼½¾⅓⅔⅛⅜⅝⅞⅕])|(?P<glyph1>[¼½¾⅓⅔⅛⅜⅝⅞⅕])|(?:(?P<mix>\d+)[-\s])?(?P<top>\d+)[/⁄](?P<low>\d+)(?![\d/])|(?P<num>{_NUM})"
    rf"|(?P<spelt>{_SPELT})\b)|(?<=[x×*–—-])(?P<num2>{_NUM})",
    re.I,
)
# Number words that are not read: a text with one of them gives no quantity rather than a wrong one.
_UNREAD = re.compile(r"(?i)\b(?:hundreds?|thousands?|millions?|billions?|dozens?|couple|half|halves|quarters?|thirds?|tenths?|hundredths?|once|twice|thrice)\b")
_POWER = re.compile(r"(?<=\d)\s*[x×*·]\s*10\s*(?:\^\s*([+-]?\d{1,2})|([⁺⁻]?[⁰¹²³⁴⁵⁶⁷⁸⁹]{1,2}))")
_RAISED = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻", "0123456789+-")
_UNIT = re.compile(r"\s*(?:(?:deg(?:rees?|\.)?|°|º)\s*)?(?P<unit>\"|''|”|[^\W\d_]+(?:/(?:\d+)?[^\W\d_]+|%)?|°|º)", re.I)
# A multiplication sign between two dimensions, however it is set.
_TIMES = re.compile(rf"(?i)(?<!\bsi)(?<=[\w.\"¼½¾⅓⅔⅛])\s*[x×*]\s*(?=\.?\d|[¼½¾⅓⅔⅛]|(?:{_WORDS})(?:[x×*\s]|$))")
# A number word set against its unit.
_JOINED = re.compile(rf"(?i)\b({_WORDS})(?=(?:mm|cm|milli|centi|micro|kilo|mg|ml|min|inch|hour|gram|liter|litre|pound|second|degree)[a-z]*\b)")
_SEPARATOR = re.compile(r"x|by|to|and|or|und|bis|a", re.I)


def spelling(raw: str | None) -> str:
    """A unit spelling without case, blanks, full stops, degree signs and the plural's s."""
    u = re.sub(r"\s+", "", (raw or "").lower()).replace("µ", "u").replace("μ", "u").strip(".")
    u = re.sub(r"^(?:degrees?|deg\.?|°|º)", "", u) or u
    u = u.replace("''", '"').replace("”", '"').replace("litre", "liter").replace("metre", "meter")
    if u in NO_UNIT:
        return ""
    return u[:-1] if len(u) > 3 and u.endswith("s") and not u.endswith("celsius"[-3:]) else u


def unit_of(quantity: str, raw: str | None) -> str | None:
    """The known unit that a spelling means for a quantity."""
    u = spelling(raw)
    for kind in _KINDS.get(quantity, ()):
        for form in (u, u + "s", (raw or "").strip().lower().strip(".")):
            if (kind, form) in SPELLINGS:
                return SPELLINGS[kind, form]
    return None


def _value(m: re.Match) -> Fraction:
    g = m.groupdict()
    if g["hours"]:
        return int(g["hours"]) + Fraction(int(g["minutes"]), 60)
    if g["glyph"]:
        return int(g["whole"]) + _GLYPH[g["glyph"]]
    if g["glyph1"]:
        return _GLYPH[g["glyph1"]]
    if g["top"]:
        low = int(g["low"]) or 1
        return int(g["mix"] or 0) + Fraction(int(g["top"]), low)
    if g["spelt"]:
        return _spelt(g["spelt"])
    n = g["num"] or g["num2"]
    if re.fullmatch(r"\d{1,3}(?:\.\d{3})+,\d+|\d{1,3}(?:\.\d{3}){2,}", n):
        n = n.replace(".", "").replace(",", ".")
    elif re.fullmatch(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?", n):
        n = n.replace(",", "")
    else:
        n = n.replace(",", ".")
    return Fraction("0" + n if n.startswith(".") else n)


def _spelt(words: str) -> Fraction:
    """The value of number words."""
    total = part = Fraction(0)
    after = None
    for w in re.split(r"[-\s]+", words.lower()):
        if after is not None:
            after *= 10
            total += Fraction(_ONES.index(w), after)
        elif w in _TENS:
            part += _TENS[w]
        elif w in _ONES:
            part += _ONES.index(w)
        elif w == "hundred":
            part = max(part, Fraction(1)) * 100
        elif w == "thousand":
            total, part = max(part, Fraction(1)) * 1000, Fraction(0)
        elif w == "half":
            part += Fraction(1, 2)
        elif w == "point":
            total, part, after = total + part, Fraction(0), 1
    return total + part


def _negative(text: str, at: int) -> bool:
    """Whether a minus sign stands right before a number and is no dash after another one or a word."""
    return at > 0 and text[at - 1] in "-−" and not re.search(r"[\w.%°º)\"'¼½¾⅓⅔⅛]\s*$", text[: at - 1])


def read_quantities(quantity: str, text: str | None, column: str | None) -> list[tuple[Fraction, str]]:
    """(number, unit spelling or name) of each quantity of a measurement text; spelling '' where none is to be had."""
    if not text:
        return []
    text = _POWER.sub(lambda m: "e" + (m.group(1) or m.group(2).translate(_RAISED)), text)
    text = _TIMES.sub(" x ", _JOINED.sub(r"\1 ", text))
    found: list[list] = []  # number, unit text, end
    rest = text
    for m in _NUMBER.finditer(text):
        rest = rest[: m.start()] + " " * (m.end() - m.start()) + rest[m.end() :]
        u = _UNIT.match(text, m.end())
        raw = u.group("unit") if u else ""
        if raw and (_SEPARATOR.fullmatch(raw) and unit_of(quantity, raw) is None or raw.lower() == "x"):
            raw = ""
        if raw.lower() == "in" and re.match(r"\s+(?:size|diameter|length|width)", text[u.end() :], re.I):
            col = unit_of(quantity, column)
            if col is not None and col != "in":
                raw = ""
        if raw and re.match(r"[x×*]", raw, re.I) and unit_of(quantity, raw) is None and unit_of(quantity, raw[1:]) is None and len(raw) == 1:
            raw = ""
        if raw.lower().endswith("x") and len(raw) > 1 and unit_of(quantity, raw) is None and unit_of(quantity, raw[:-1]):
            raw = raw[:-1]
        if raw.lower() in ("diameter", "size", "approx", "about", "in", "of", "per", "daily") and unit_of(quantity, raw) is None:
            raw = ""
        found.append([-_value(m) if _negative(text, m.start()) else _value(m), raw, u.end() if raw and u else m.end(), m.start()])
    if _UNREAD.search(rest):
        return []
    out: list[list] = []
    for f in found:  # 5 h 10 min is one quantity
        if out and out[-1][1] and f[1]:
            a, b = unit_of(quantity, out[-1][1]), unit_of(quantity, f[1])
            if (a, b) in _COMPOUND and re.fullmatch(r"[\s,.]*(?:and\s)?", text[out[-1][2] : f[3]]):
                out[-1][0] += f[0] * UNITS[b][1] / UNITS[a][1]
                out[-1][2] = f[2]
                continue
        out.append(f)
    col = spelling(column)
    later = ""
    for f in reversed(out):
        if f[1] and (unit_of(quantity, f[1]) or not unit_of(quantity, column)):
            later = f[1]
        f.append(later)
    earlier = ""
    res = []
    for value, raw, _, _, after in out:
        use = after or earlier
        earlier = use or earlier
        res.append((value, unit_of(quantity, use) or spelling(use) or unit_of(quantity, column) or col))
    return res


def _factor(quantity: str, name: str, common: str, grams_per_mol: float | None) -> tuple[float, float] | None:
    """value_in_common = value * scale + offset."""
    target = unit_of(quantity, common)
    if target is None or name not in UNITS or UNITS[name][0] not in _KINDS.get(quantity, ()):
        return None
    kind, f, o = UNITS[name]
    tkind, tf, to = UNITS[target]
    if kind == tkind:
        return float(f / tf), float((o - to) / tf)
    if not grams_per_mol:
        return None
    mol = Fraction(str(grams_per_mol))
    return (float(f / mol / tf), 0.0) if kind == "massconc" else (float(f * mol / tf), 0.0)


def conversions(reference: DataFrame) -> DataFrame:
    """``measured, unit, scale, offset``: every known conversion of the reference table (one row per thing and known unit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for measured, quantity, common, mol in zip(*(b.column(k).to_pylist() for k in range(4))):
                for name in UNITS:
                    f = _factor(quantity or "", name, common or "", mol)
                    if f:
                        rows.append({"measured": measured, "unit": name, "scale": f[0], "offset": f[1]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("measured", pa.string()), ("unit", pa.string()), ("scale", pa.float64()), ("offset", pa.float64())]))

    return reference.select("measured", "quantity", "common_unit", "grams_per_mol").mapInArrow(run, "measured string, unit string, scale double, offset double")


def read_table(df: DataFrame, reference: DataFrame, id_col: str = "meas_id") -> DataFrame:
    """``id, measured, dim_no, number, unit, listed``: the quantities of each row, one result per id; ``listed``: whether the
    row's unit column has this unit."""
    kind = df.schema[id_col].dataType.simpleString()
    base = df.select(id_col, "measured", "measurement", "unit").dropDuplicates([id_col])
    joined = base.join(F.broadcast(reference.select("measured", "quantity").distinct()), "measured")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in batches:
            rows = []
            for i, measured, text, unit, quantity in zip(*(b.column(k).to_pylist() for k in range(5))):
                for k, (value, u) in enumerate(read_quantities(quantity or "", text, unit), 1):
                    rows.append({"id": i, "measured": measured, "dim_no": k, "number": float(value), "unit": u, "listed": u != "" and u == spelling(unit)})
            schema = schema or pa.schema([("id", b.schema.field(0).type), ("measured", pa.string()), ("dim_no", pa.int32()), ("number", pa.float64()), ("unit", pa.string()), ("listed", pa.bool_())])
            yield pa.RecordBatch.from_pylist(rows, schema)

    return joined.select(id_col, "measured", "measurement", "unit", "quantity").mapInArrow(run, f"id {kind}, measured string, dim_no int, number double, unit string, listed boolean")


#: How far (natural log, median over the quantiles) values may lie from those of another unit; letters of the shortest
#: spelling that may be one letter off.
SNAP, LEAST_LETTERS = 0.35, 6
_QUANTILES = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def _one_off(a: str, b: str) -> bool:
    """Whether one letter changed, dropped, added or none makes a to b."""
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return len(b) - len(a) <= 1 and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :])


def resembling(quantity: str | None, unit: str | None) -> str | None:
    """The one known unit of a quantity with a spelling that begins like ``unit``, up to one letter; none if there are several."""
    u = spelling(unit)
    if len(u) < LEAST_LETTERS:
        return None
    kinds = _KINDS.get(quantity or "", ())
    near = {name for (kind, w), name in SPELLINGS.items() if kind in kinds and len(w) >= LEAST_LETTERS and any(_one_off(u, w[:n]) for n in range(len(u) - 1, min(len(u) + 1, len(w)) + 1))}
    return near.pop() if len(near) == 1 else None


def resolve_spellings(spellings: DataFrame, known: DataFrame, reference: DataFrame) -> DataFrame:
    """``measured, unit, as_unit, scale, offset, origin``: a conversion for each distinct spelling (measured, unit) that means
    a known unit: `known` by the lexicon, `estimated` by its letters. The number of rows that hold it plays no part."""
    each = spellings.where("unit <> ''").select("measured", "unit").distinct()
    fixed = each.join(known, ["measured", "unit"]).select("measured", "unit", F.col("unit").alias("as_unit"), "scale", "offset", F.lit("known").alias("origin"))
    lost = each.join(known, ["measured", "unit"], "left_anti").join(F.broadcast(reference.select("measured", "quantity").distinct()), "measured")
    like = lost.select("measured", "unit", F.udf(resembling, "string", useArrow=True)("quantity", "unit").alias("as_unit"))
    found = like.join(known.withColumnRenamed("unit", "as_unit"), ["measured", "as_unit"])
    return fixed.unionByName(found.select("measured", "unit", "as_unit", "scale", "offset", F.lit("estimated").alias("origin")))


def _middle(values):
    return F.element_at(F.array_sort(values), F.greatest(F.lit(1), F.ceil(F.size(values) / 2).cast("int")))


def _gap(q, scale, offset, base):
    """Median |log ratio| of quantiles brought to another unit and that unit's own."""
    floor = F.lit(1e-9)
    return _middle(F.zip_with(q, base, lambda x, y: F.abs(F.log(F.greatest(x * scale + offset, floor) / F.greatest(y, floor)))))


def _linked(q, base):
    """(scale, offset) that bring the quantiles ``q`` to ``base``: the median of the slopes between pairs of quantiles, and
    the median of what it leaves."""
    at = [(i, j) for i in range(len(_QUANTILES)) for j in range(i)]
    slopes = F.filter(F.array(*[F.try_divide(base[i] - base[j], q[i] - q[j]) for i, j in at]), lambda x: x.isNotNull())
    scale = F.when(F.size(slopes) > 0, _middle(slopes))
    return scale, _middle(F.zip_with(q, base, lambda x, y: y - x * scale))


def graph_units(numbers: DataFrame, known: DataFrame, taken: DataFrame) -> DataFrame:
    """``measured, unit, as_unit, scale, offset``: units of the spellings that stand in a unit column and are not in ``taken``
    (measured, unit), by the graph of sources.

    Each such spelling is linked with each known unit of its measured thing that has values (as many rows as there are known
    units, which the lexicon bounds). An edge gives scale and offset of the two sources and is snapped to the conversion
    between known units that comes nearest, which proposes a unit; each proposal has a gap. The unit of the least gap is
    taken if that is at most SNAP and the next unit's lies farther than twice the standard error of the spelling's median:
    few values leave more units possible than many, and none is taken while two are."""
    source = numbers.where((F.col("unit") != "") & (F.col("number") > 0)).groupBy("measured", "unit")
    source = source.agg(F.count("*").alias("rows"), F.percentile_approx("number", _QUANTILES, 2000).alias("q"), F.stddev_samp(F.log("number")).alias("spread"), F.bool_or("listed").alias("listed"))
    lost = source.where("listed").join(taken.select("measured", "unit"), ["measured", "unit"], "left_anti")
    anchors = source.join(known, ["measured", "unit"]).select("measured", F.col("unit").alias("anchor"), F.col("q").alias("base"), F.col("spread").alias("wide"), F.col("scale").alias("a_scale"), F.col("offset").alias("a_offset"))
    edges = lost.join(anchors, "measured")
    scale, offset = _linked(F.col("q"), F.col("base"))
    edges = edges.withColumn("est_scale", scale).withColumn("est_offset", offset)
    try_ = edges.join(known.select("measured", F.col("unit").alias("as_unit"), "scale", "offset"), "measured")
    snap_scale, snap_offset = F.col("scale") / F.col("a_scale"), (F.col("offset") - F.col("a_offset")) / F.col("a_scale")
    # an edge proposes the units whose conversion to the anchor brings the two sources together
    try_ = try_.withColumn("gap", _gap(F.col("q"), snap_scale, snap_offset, F.col("base"))).withColumn("off", F.abs(F.log(F.greatest(F.col("est_scale"), F.lit(1e-12)) / snap_scale)))
    each = try_.groupBy("measured", "unit", "as_unit").agg(F.min(F.struct("gap", "off")).alias("best"), F.first("rows").alias("rows"), F.max(F.coalesce("spread", "wide", F.lit(1.0))).alias("spread"), F.first("scale").alias("scale"), F.first("offset").alias("offset"))
    w = Window.partitionBy("measured", "unit").orderBy("best", "as_unit")  # as many rows as there are known units
    ranked = each.withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("best.gap").over(w))
    sure = F.col("next").isNull() | (F.col("next") - F.col("best.gap") > 2 * 1.2533 * F.col("spread") / F.sqrt("rows"))
    return ranked.where((F.col("n") == 1) & (F.col("best.gap") <= SNAP) & sure).select("measured", "unit", "as_unit", "scale", "offset")


def spelling_check(df: DataFrame, reference: DataFrame, id_col: str = "meas_id") -> DataFrame:
    """``measured, unit, as_unit, origin, rows, scale, offset, other, est_scale, est_offset, gap, nearest, verdict``.

    One row per spelling of a measured thing. ``other`` is the best supported other known unit; ``est_scale`` and
    ``est_offset`` bring the spelling's quantiles to the other's in the common unit; ``gap`` is the median |log ratio| under
    the spelling's own conversion; ``nearest`` is the known unit with the least gap. ``verdict``: `agrees`,
    `apart` (gap over SNAP, yet no unit nearer) or `contradicts` for a spelling with a conversion, `proposed` or `unlike` for
    one without, `alone` if the measured thing has no other known unit."""
    known = conversions(reference).distinct()
    numbers = cut_lineage(read_table(df, reference, id_col)).where("unit <> ''")
    stats = numbers.groupBy("measured", "unit").agg(F.count("*").alias("rows"), F.percentile_approx("number", _QUANTILES, 2000).alias("q"))
    mine = stats.join(resolve_spellings(numbers, known, reference), ["measured", "unit"], "left")
    anchors = stats.join(known, ["measured", "unit"]).select("measured", F.col("unit").alias("other"), F.col("rows").alias("support"), F.transform("q", lambda x: x * F.col("scale") + F.col("offset")).alias("base"))
    best = mine.select("measured", "unit").join(anchors, "measured").where("unit <> other").groupBy("measured", "unit").agg(F.max_by(F.struct("other", "base"), F.struct("support", "other")).alias("a"))
    met = mine.join(best, ["measured", "unit"], "left").select("*", F.col("a.other").alias("other"), F.col("a.base").alias("base")).drop("a")

    scale, offset = _linked(F.col("q"), F.col("base"))
    met = met.withColumn("est_scale", scale).withColumn("est_offset", offset)
    gap = lambda scale, offset: _gap(F.col("q"), scale, offset, F.col("base"))
    tried = met.where("other IS NOT NULL").select("measured", "unit", "q", "base").join(known.select("measured", F.col("unit").alias("try"), "scale", "offset"), "measured")
    nearest = tried.groupBy("measured", "unit").agg(F.min_by("try", F.struct(gap(F.col("scale"), F.col("offset")), "try")).alias("nearest"), F.min(gap(F.col("scale"), F.col("offset"))).alias("least"))
    met = met.join(nearest, ["measured", "unit"], "left").withColumn("gap", F.when(F.col("other").isNotNull() & F.col("scale").isNotNull(), gap(F.col("scale"), F.col("offset"))))
    verdict = F.when(F.col("other").isNull(), "alone").when(F.col("gap") <= SNAP, "agrees").when(F.col("nearest") == F.col("as_unit"), "apart").when(F.col("gap").isNotNull(), "contradicts").when(F.col("least") <= SNAP, "proposed").otherwise("unlike")
    return met.select("measured", "unit", "as_unit", "origin", "rows", "scale", "offset", "other", "est_scale", "est_offset", "gap", "nearest", verdict.alias("verdict"))


def convert(df: DataFrame, reference: DataFrame, id_col: str = "meas_id") -> DataFrame:
    """``id_col, dim_no, number, unit, as_unit, origin, value`` (in the common unit) of each number that can be converted.
    ``origin``: `known` by the lexicon, `estimated` by the letters of the spelling, `graph` by its values."""
    known = conversions(reference).distinct()
    numbers = cut_lineage(read_table(df, reference, id_col))
    found = resolve_spellings(numbers, known, reference)
    found = found.unionByName(graph_units(numbers, known, found).withColumn("origin", F.lit("graph")))
    done = numbers.join(found, ["measured", "unit"])
    return done.select(F.col("id").alias(id_col), "dim_no", "number", "unit", "as_unit", "origin", (F.col("number") * F.col("scale") + F.col("offset")).alias("value"))


def unconverted(df: DataFrame, reference: DataFrame, id_col: str = "meas_id") -> DataFrame:
    """``id_col, reason``: rows of which no number could be converted."""
    done = convert(df, reference, id_col).select(id_col).distinct()
    rest = df.select(id_col, "measured", "measurement").dropDuplicates([id_col]).join(done, id_col, "left_anti")
    rest = rest.join(F.broadcast(reference.select("measured").distinct().withColumn("listed", F.lit(True))), "measured", "left")
    reason = (
        F.when(F.col("listed").isNull(), "not in the reference")
        .when(F.col("measurement").isNull() | (F.trim("measurement") == ""), "no text")
        .when(~F.col("measurement").rlike(rf"(?i)[0-9¼½¾⅓⅔⅛]|\b(?:{_WORDS})\b"), "no number")
        .otherwise("no usable unit")
    )
    return rest.select(id_col, reason.alias("reason"))
