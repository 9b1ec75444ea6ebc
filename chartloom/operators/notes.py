"""Note scans, section segmentation, sentences, melting, diagnosis codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions.text import strip_ws

# Section headers of discharge notes and radiology reports, matched at the start of a line in any case.
SECTION_HEADERS = {
    "discharge": {
        "Chief Complaint": ["chief complaint", "c/c"],
        "HPI": ["history of present illness", "hpi"],
        "PMH": ["past medical history", "pmh"],
        "Medications": ["discharge medications", "medications on admission"],
        "Assessment/Plan": ["assessment and plan", "a/p"],
        "Discharge Dx": ["discharge diagnos(?:is|es)"],
        "Hospital Course": ["brief hospital course", "hospital course"],
    },
    "radiology": {"Indication": ["indication", "reason for exam"], "Findings": ["findings"], "Impression": ["impression", "conclusions"]},
}
RADIOLOGY_SECTIONS = list(SECTION_HEADERS["radiology"])


def scan_multi_note(notes: DataFrame, patients: int = 200, limit: int = 1000) -> DataFrame:
    """Notes of the first ``patients`` subjects with more than one note, ``limit`` rows by note_id. Rows without an
    admission count for nobody."""
    admitted = notes.where(F.col("hadm_id").isNotNull())
    many = admitted.groupBy("subject_id").agg(F.count("note_id").alias("n")).where("n > 1").orderBy("subject_id").limit(patients)
    return admitted.join(many, "subject_id", "left_semi").select("subject_id", "hadm_id", "note_id", "text").orderBy("note_id", "hadm_id", "subject_id").limit(limit)


def scan_diagnoses(diagnoses: DataFrame, limit: int = 5000) -> DataFrame:
    cols = ["hadm_id", "seq_num", "icd_code", "icd_version", "subject_id"]
    return diagnoses.where(F.col("hadm_id").isNotNull()).select(*cols).orderBy(*cols).limit(limit)


def single_note(notes: DataFrame) -> DataFrame:
    return notes.where(F.col("text").isNotNull()).select("note_id", "text").orderBy("note_id", "text").limit(1)


def distinct_prescriptions(prescriptions: DataFrame, hadm_id: int | None = None) -> DataFrame:
    """Different drugs of one admission, or of each."""
    rows = prescriptions.where(F.col("drug").isNotNull())
    return rows.where(F.col("hadm_id") == hadm_id).select("drug").distinct() if hadm_id is not None else rows.select("hadm_id", "drug").distinct()


def _header(track: Column, line: Column) -> Column:
    t = strip_ws(line)
    out = F.lit(None).cast("string")
    for kind, sections in SECTION_HEADERS.items():
        own = F.lit(None).cast("string")
        for name, patterns in reversed(sections.items()):
            own = F.when(t.rlike("(?i)^(?:" + "|".join(patterns) + ")"), name).otherwise(own)
        any_of = "|".join(p for patterns in sections.values() for p in patterns)
        out = F.when((track == kind) & line.rlike(rf"(?iU)^\s*(?:{any_of})"), own).otherwise(out)
    return out


def segment_sections(notes: DataFrame, id_col: str = "note_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per non-blank section: id_col, the columns ``keep``, section_name, section_ord, section_text.

    Runs of lines between headers become sections; a header's own line is dropped, text before the first header is
    ``full_text``, a run without lines stores nothing, a repeated section is overwritten by its last run and keeps the
    place of its first. Other note types are one ``full_text``. A note is one row and is cut where it is read: arrays of
    lines, no shuffle. Null text counts as empty; a note that is there twice gives its sections twice.
    """
    track = strip_ws(F.lower(F.coalesce(F.col("note_type"), F.lit(""))))
    base = notes.select(F.col(id_col), *keep, track.alias("track"), F.coalesce("text", F.lit("")).alias("text"))

    def cut(note: Column) -> Column:
        """The runs of one note (lines, and the header of each or null): number, name, text, and whether it has lines."""
        lines, heads = note["lines"], note["heads"]
        marks = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.get(heads, i - 1).isNotNull())
        return F.transform(
            F.sequence(F.lit(0), F.size(marks)),
            lambda k: F.transform(
                F.array(F.struct(F.coalesce(F.get(marks, k - 1), F.lit(0)).alias("head"), (F.coalesce(F.get(marks, k), F.size(lines) + 1)).alias("end"))),
                lambda r: F.struct(k.alias("run"), F.coalesce(F.get(heads, r["head"] - 1), F.lit("full_text")).alias("name"), (r["end"] - r["head"] - 1).alias("n"), strip_ws(F.array_join(F.slice(lines, r["head"] + 1, r["end"] - r["head"] - 1), "\n")).alias("body")),
            )[0],
        )

    def last(runs: Column) -> Column:
        """Of each name the text of its last run and the number of its first."""
        names = F.array_distinct(F.transform(runs, lambda r: r["name"]))
        return F.transform(
            names,
            lambda n: F.transform(
                F.array(F.filter(runs, lambda r: r["name"] == n)), lambda own: F.struct(n.alias("section_name"), own[0]["run"].alias("section_ord"), F.element_at(own, -1)["body"].alias("section_text"))
            )[0],
        )

    lines = F.transform(F.array(F.split("text", "\n", -1)), lambda x: F.struct(x.alias("lines"), F.transform(x, lambda y: _header(F.col("track"), y)).alias("heads")))
    runs = F.filter(F.flatten(F.transform(lines, cut)), lambda r: r["n"] > 0)
    sections = F.flatten(F.transform(F.array(runs), last))
    plain = F.array(F.struct(F.lit("full_text").alias("section_name"), F.lit(0).alias("section_ord"), F.col("text").alias("section_text")))
    out = base.select(id_col, *keep, F.explode(F.when(F.col("track").isin(*SECTION_HEADERS), sections).otherwise(plain)).alias("s"))
    return out.select(id_col, *keep, "s.*").where(strip_ws(F.col("section_text")) != "")


def split_sentences(sections: DataFrame, keys: list[str], text_col: str, splitter=None) -> DataFrame:
    """keys, sentence_index, sentence_text: cut after . ! ? and blanks, or by ``splitter`` (a function from a column to its
    array of pieces, see ``models.sentence_splitter``); pieces of two characters or less are dropped, and the index counts
    them and starts at 0 in each section."""
    rule = lambda c: F.split(F.regexp_replace(c, r"(?U)([.!?])\s+", "$1\u0001"), "\u0001", -1)
    pieces = sections.where(F.col(text_col).isNotNull()).select(*keys, F.posexplode((splitter or rule)(F.col(text_col))).alias("sentence_index", "piece"))
    return pieces.withColumn("sentence_text", strip_ws(F.col("piece"))).where(F.length("sentence_text") > 2).select(*keys, "sentence_index", "sentence_text")


def melt_sections(wide: DataFrame, ids: list[str]) -> DataFrame:
    """ids, section_name, section_text from one column per section; blanks and nulls dropped."""
    values = [c for c in wide.columns if c not in ids]
    return wide.unpivot(ids, values, "section_name", "section_text").where(F.col("section_text").isNotNull() & (strip_ws(F.col("section_text")) != ""))


def track_split(rows: DataFrame) -> DataFrame:
    """``rows`` with ``track``: radiology for its three sections, else discharge; a null section is discharge."""
    return rows.withColumn("track", F.when(F.coalesce(F.col("section_name").isin(RADIOLOGY_SECTIONS), F.lit(False)), "radiology").otherwise("discharge"))


def icd_map(diagnoses: DataFrame, crosswalk: DataFrame, order: str | None = None) -> DataFrame:
    """Version 9 codes through the crosswalk; version 10 stays; others keep their version. Of several entries of a code the
    last wins: by the column ``order``, else by ``line_no`` (which the crosswalk source gives), else by the place of the row
    in the table, which only an unsplit table has. Codes without an entry are flagged. The crosswalk joins by code; Spark
    broadcasts it while it is small."""
    order = order or ("line_no" if "line_no" in crosswalk.columns else None)
    placed = crosswalk.withColumn("at", F.col(order) if order else F.monotonically_increasing_id())
    last = placed.groupBy(F.col("icd9_code").alias("_nine")).agg(F.max_by("icd10_code", "at").alias("_ten"))
    d = diagnoses.select("subject_id", "hadm_id", "seq_num", "icd_code", "icd_version", strip_ws(F.col("icd_code")).alias("_stripped"))
    nine = F.col("icd_version") == "9"
    j = d.join(last, nine & (F.col("_stripped") == F.col("_nine")), "left")
    hit = F.col("_ten").isNotNull()
    code = F.when(nine & hit, F.col("_ten")).when(nine, F.col("_stripped")).otherwise(F.col("icd_code"))
    version = F.when(nine & hit, "10").otherwise(F.col("icd_version"))
    return j.select("subject_id", "hadm_id", "seq_num", code.alias("icd_code"), version.alias("icd_version"), F.coalesce(F.when(F.col("icd_version") == "10", False).when(nine, ~hit), F.lit(True)).alias("is_unmapped"))


def unmapped_count(mapped: DataFrame) -> DataFrame:
    """One row: codes, and those without an entry."""
    return mapped.agg(F.count("*").alias("codes"), F.count_if("is_unmapped").alias("unmapped"))
