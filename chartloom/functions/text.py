"""Column builders for clinical text: each takes and returns a Column and stays inside the JVM.

Null text becomes the empty string where the operator cleans text, and stays null where it only maps a value. Patterns
are Unicode-aware ((?U)); rule tables are applied in the order given.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Abbreviations of clinical notes and their expansions.
ABBREVIATIONS = {
    "HTN": "hypertension", "DM2": "type 2 diabetes mellitus", "CHF": "congestive heart failure", "pt": "patient", "dx": "diagnosis", "hx": "history",
    "s/p": "status post", "c/o": "complains of", "prn": "as needed", "BID": "twice a day", "TID": "three times a day", "QID": "four times a day", "sob": "shortness of breath",
}
# Two more of the second dictionary.
ABBREVIATIONS_2 = ABBREVIATIONS | {"ivf": "intravenous fluids", "ct": "computed tomography"}
# The older dictionary; its order matters.
LEGACY_ABBREVIATIONS = {
    "htn": "hypertension", "dm": "diabetes mellitus", "t2dm": "type 2 diabetes mellitus", "id-t2dm": "insulin-dependent type 2 diabetes mellitus",
    "bph": "benign prostatic hyperplasia", "lfts": "liver function tests", "rcc": "renal cell carcinoma", "n/v": "nausea vomiting", "abd": "abdominal",
}
# Drug synonyms and words that are no drugs.
DRUG_SYNONYMS = {"ativan": "lorazepam", "tylenol": "acetaminophen", "paracetamol": "acetaminophen"}
DRUG_NOISE = ["pt", "nad", "ctab", "q8h", "qhs", "u-100", "greasy", "fen", "hsq", "pcp", "sodium"]
# Findings that read as normal, in order, and words of abnormal findings.
NORMAL_PATTERNS = [r"no\s+evidence\s+of", r"negative\s+for", r"rule\s+out", "excluded", "normal", "unremarkable"]
ABNORMAL_WORDS = "abnormal abnormality finding lesion mass collection thickening enhancement narrowing stenosis occlusion fracture dislocation rupture infarction hemorrhage".split()
# Cues of relations between findings, strongest first.
FINDING_CUES = {
    "CAUSED_BY": ["caused by", "due to", "secondary to", "resulting in", "leading to"],
    "CORRELATED_WITH": ["associated with", "compatible with", "in keeping with", "consistent with"],
    "CONTRASTED_WITH": ["no evidence of", "negative for", "without evidence of"],
}
# Cues of drug-problem relations; causes beat treats.
CAUSES_CUES = ["caused", "due to", "secondary to", "adverse", "side effect", "induced", "complication"]
TREATS_CUES = ["treated with", "started on", "given", "prescribed", "for", "improved on", "responded to"]
CAUSES_SCORE, TREATS_SCORE = 0.68, 0.66
# Two forms of a size, with their units.
MEASUREMENT_PATTERNS = [
    r"(\d+\.?\d*)\s*x\s*(\d+\.?\d*)\s*(?:x\s*(\d+\.?\d*))?\s*(cm|mm|inches?)",
    r"(\d+\.?\d*)\s*(cm|mm|inches?)\s*(?:in\s+)?(?:diameter|size)",
]


def _literal(s: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|/-" else c for c in s)


def strip_ws(c: Column) -> Column:
    """Python's strip(): all Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def expand(c: Column, rules: dict[str, str]) -> Column:
    """Each abbreviation as a whole word, in any case, one rule after the other."""
    return reduce(lambda x, r: F.regexp_replace(x, rf"(?iU)\b{_literal(r[0])}\b", r[1]), rules.items(), c)


def expand_once(c: Column, rules: dict[str, str]) -> Column:
    """``expand`` in one pass, for rules of which none makes another one apply: the text is cut at all abbreviations at
    once and put together again with their expansions."""
    low = {k.lower(): v for k, v in rules.items()}
    pattern = rf"(?iU)(?=[{''.join(sorted({k[0] for k in low}))}])\b(?:" + "|".join(_literal(k) for k in sorted(low, key=len, reverse=True)) + r")\b"
    table = F.create_map(*[F.lit(x) for kv in low.items() for x in kv])
    full = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda m: table[F.lower(m)])
    return F.array_join(F.flatten(F.zip_with(F.split(c, pattern, -1), full, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def clean_text(c: Column) -> Column:
    """De-identification marks out, abbreviations expanded, laboratory values tagged, blanks collapsed."""
    x = F.coalesce(c, F.lit(""))
    x = F.regexp_replace(x, "_{3,}", " ")
    x = F.regexp_replace(x, r"(?d)\[\*\*.*?\*\*\]", " ")
    x = expand_once(x, ABBREVIATIONS)
    x = F.regexp_replace(x, r"(?U)(?<![A-Za-z])([A-Za-z]++)\:\s*(\d+\.?\d*)\s*([a-zA-Z/%]+)", "LABTEST $1: $2 $3")
    x = F.regexp_replace(x, r"\[DEID\]", " ")
    return strip_ws(F.regexp_replace(x, "[ \t]+", " "))


def legacy_clean(c: Column) -> Column:
    """The older cleaning: protected spans to [PHI], separator lines out, blank lines and blanks collapsed."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?d)\[\*\*.*?\*\*\]", "[PHI]")
    for pattern in ("_{3,}", "-{4,}", r"\*{3,}"):
        x = F.regexp_replace(x, pattern, " ")
    return strip_ws(F.regexp_replace(F.regexp_replace(x, "\n{3,}", "\n\n"), " {2,}", " "))


def strip_dosage(c: Column) -> Column:
    x = F.regexp_replace(c, r"(?iU)\b\d+(\.\d+)?\s?(mg|ml|mcg|g|units?)\b", "")
    return strip_ws(F.regexp_replace(x, r"(?U)\s+", " "))


def normalize_drug(c: Column) -> Column:
    x = strip_ws(F.lower(c))
    pairs = [F.lit(v) for kv in DRUG_SYNONYMS.items() for v in kv]
    return F.coalesce(F.create_map(*pairs)[x], x)


def is_drug_noise(c: Column) -> Column:
    x = strip_ws(F.lower(c))
    return x.isin(DRUG_NOISE) | (F.length(x) < 4) | x.contains("/")


def ocr_tail(c: Column) -> Column:
    """The steps of ``ocr_normalize`` after NFKC."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), "­", "")
    x = F.regexp_replace(x, "(?U)\\s*[-‐-—]\\s*", " - ")
    return strip_ws(F.regexp_replace(x, "[ \t]+", " "))


def ocr_normalize(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``text_col`` in NFKC, soft hyphens out, dashes set off by blanks. NFKC has no JVM function; one Arrow
    UDF over whole columns supplies it, and only for texts with a character outside ASCII."""
    import unicodedata

    @F.arrow_udf("string")
    def nfkc(col: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in col.to_pylist()], pa.string())

    plain = F.col(text_col).rlike(r"^\p{ASCII}*\z") | F.col(text_col).isNull()
    return df.withColumn(text_col, ocr_tail(F.when(plain, F.col(text_col)).otherwise(nfkc(F.col(text_col)))))


def severity(context: Column, word: Column) -> Column:
    """normal, abnormal or uncertain; a normal reading wins (``abnormal`` itself holds ``normal``)."""
    t = F.lower(F.concat(F.coalesce(context, F.lit("")), F.lit(" "), F.coalesce(word, F.lit(""))))
    return F.when(t.rlike("(?U)" + "|".join(NORMAL_PATTERNS)), "normal").when(t.rlike("|".join(ABNORMAL_WORDS)), "abnormal").otherwise("uncertain")


def finding_relation(context: Column) -> Column:
    """CAUSED_BY, CORRELATED_WITH or CONTRASTED_WITH by the first kind of cue found, else null."""
    t = F.lower(F.coalesce(context, F.lit("")))
    out = F.lit(None).cast("string")
    for name, cues in reversed(FINDING_CUES.items()):
        out = F.when(t.rlike("|".join(cues)), name).otherwise(out)
    return out


def keyword_relation(context: Column) -> tuple[Column, Column]:
    """(relation, score) of a context by keywords."""
    t = F.lower(F.coalesce(context, F.lit("")))
    words = lambda cues: r"(?U)\b(?:" + "|".join(cues) + r")\b"
    relation = F.when(t.rlike(words(CAUSES_CUES)), "CAUSES").when(t.rlike(words(TREATS_CUES)), "TREATS").otherwise("UNRELATED")
    return relation, F.when(relation == "CAUSES", F.lit(CAUSES_SCORE)).when(relation == "TREATS", F.lit(TREATS_SCORE)).otherwise(F.lit(0.0))


def note_track(c: Column) -> Column:
    """discharge or radiology for the written forms of a note type; case-sensitive, discharge by default."""
    radiology = ["RR", "radiology", "Radiology Report"]
    return F.when(c.isin(radiology), "radiology").otherwise("discharge")


def matches(text: Column, pattern: str, groups: int) -> Column:
    """array<struct<start, end_, full, g1..gn>> of all matches, with character offsets, without a Python UDF: the pieces
    between matches and the matches themselves are summed up once from left to right, and the groups are read from the
    short matches. Texts without a match are looked at once."""
    whole = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("full"))

    def one(s: Column) -> Column:
        steps = F.zip_with(s["gaps"], s["full"], lambda g, m: F.struct(F.length(g).alias("g"), F.coalesce(F.length(m), F.lit(0)).alias("m")))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(steps, begin, lambda a, x: F.struct((a["at"] + x["g"] + x["m"]).alias("at"), F.array_append(a["starts"], a["at"] + x["g"]).alias("starts")), lambda a: a["starts"])
        return F.zip_with(
            s["full"],
            F.slice(starts, 1, F.size(s["full"])),
            lambda m, at: F.struct(at.alias("start"), (at + F.length(m)).alias("end_"), m.alias("full"), *[F.nullif(F.regexp_extract(m, pattern, k), F.lit("")).alias(f"g{k}") for k in range(1, groups + 1)]),
        )

    return F.when(text.rlike(pattern), F.flatten(F.transform(F.array(whole), one)))


def measurements(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per size in a text: id, measurement, dim_1..dim_3, unit, start, end_. Texts may overlap in both forms. One
    pass over the table for both."""

    def form(k: int, pattern: str, dims: int) -> Column:
        sizes = lambda m: [(m[f"g{i}"] if i <= dims else F.lit(None).cast("string")).alias(f"dim_{i}") for i in (1, 2, 3)]
        found = F.transform(matches(F.col(text_col), "(?iU)" + pattern, dims + 1), lambda m: F.struct(F.lit(k).alias("form"), m["full"].alias("measurement"), *sizes(m), F.coalesce(m[f"g{dims + 1}"], F.lit("cm")).alias("unit"), m["start"].alias("start"), m["end_"].alias("end_")))
        return F.coalesce(found, F.array())

    forms = [form(k, pattern, dims) for k, (pattern, dims) in enumerate(zip(MEASUREMENT_PATTERNS, (3, 1)), 1)]
    return df.where(F.col(text_col).isNotNull()).select(id_col, F.explode(F.concat(*forms)).alias("m")).select(id_col, "m.*")


def negations(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per negated finding: id, pattern_no, negation_type, finding, full_text, start, end_. One pass over the table
    for all patterns; a text is only searched for those patterns that it has."""

    def kind(k: int, p: str) -> Column:
        found = matches(F.col(text_col), rf"(?iU){p}\s+([a-zA-Z\s]+?)(?:[,.]|$)", 1)
        return F.coalesce(
            F.transform(found, lambda m: F.struct(F.lit(k).alias("pattern_no"), F.lit("normal_finding").alias("negation_type"), strip_ws(F.coalesce(m["g1"], F.lit(""))).alias("finding"), m["full"].alias("full_text"), m["start"].alias("start"), m["end_"].alias("end_"))), F.array()
        )

    kinds = [kind(k, p) for k, p in enumerate(NORMAL_PATTERNS)]
    return df.where(F.col(text_col).isNotNull()).select(id_col, F.explode(F.concat(*kinds)).alias("m")).select(id_col, "m.*")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where a norm is 0, a side is null or the lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((norm > 0) & (F.size(a) == F.size(b)), dot(a, b) / norm), F.lit(0.0))
