"""Entity spans: overlap, priorities, greedy suppression, polishing, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions.models import NOISE_TAGS
from chartloom.functions.text import normalize_drug, is_drug_noise, strip_ws

# Priorities of labels and sources, the labels that count as medication, and the overlap thresholds.
LABEL_PRIORITY = {"drug": 300, "medication": 260, "route": 220, "strength": 210, "frequency": 200, "dose": 190, "dosage": 190, "chemical": 120, "treatment": 110, "problem": 100, "procedure": 90}
SOURCE_PRIORITY = {"med7": 300, "clinicalbert": 150, "radbert": 100}
MEDICATION_LABELS = ["drug", "medication", "chemical"]
MEDICATION_OVERLAP, BASE_OVERLAP = 0.60, 0.40
# Word lists of the polishing step.
NOISE_WORDS = ["and", "by", "repair"]
STOPWORDS = "a an the all this that these those other some any each every either neither".split()
UNITS_REQUIRING_DRUG = ["strength", "dosage"]
DISEASE_MARKERS = "itis osis emia infection sepsis pneumonia cancer failure syndrome fracture stroke hemorrhage tumor disease".split()
TREATMENT_CUES = "therapy treatment management surgery procedure infusion medication dose".split()
#: Shares of an admission's drugs.
SALTS = 8
#: The columns that order equal rows.
TOTAL = ["start", "end_", "entity_group", "word", "source_model", "score"]


def norm(c: Column | str) -> Column:
    return F.lower(strip_ws(F.col(c) if isinstance(c, str) else c))


def lookup(c: Column, table: dict[str, int]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c], F.lit(0))


def span_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length met over the hull of both spans; 0 for an empty hull."""
    met = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(hull > 0, met / hull).otherwise(F.lit(0.0))


def priority() -> Column:
    return lookup(norm("source_model"), SOURCE_PRIORITY) + lookup(norm("entity_group"), LABEL_PRIORITY)


def is_medication() -> Column:
    return F.coalesce(norm("entity_group").isin(MEDICATION_LABELS) | (norm("source_model") == "med7"), F.lit(False))


def merge_entities(entities: DataFrame) -> DataFrame:
    """Greedy suppression per sentence: spans from the highest priority on; one that overlaps an accepted span by more than
    the threshold is dropped. ``entity_type`` is the label before any relabelling; ``accepted_no`` the order of acceptance.

    A sentence's spans are one array, bounded by the sentence's length; sentences spread by note and index.
    """
    e = entities.withColumn("prio", priority()).withColumn("med", is_medication())
    key = F.struct((-F.col("prio")).alias("k1"), (F.col("start") - F.col("end_")).alias("k2"), (-F.col("score")).alias("k3"), (-F.length("word")).alias("k4"), "start", "end_", "entity_group", "word", "source_model", "score", "med", "hadm_id")
    grouped = e.groupBy("note_id", "sentence_index").agg(F.array_sort(F.collect_list(key)).alias("spans"))
    clash = lambda a, x: span_iou(a["start"], a["end_"], x["start"], x["end_"]) > F.when(a["med"] & x["med"], F.lit(MEDICATION_OVERLAP)).otherwise(F.lit(BASE_OVERLAP))
    keep = F.aggregate("spans", F.slice("spans", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda a: clash(a, x)), acc).otherwise(F.concat(acc, F.array(x))))
    out = grouped.select("note_id", "sentence_index", F.posexplode(keep).alias("accepted_no", "s"))
    return out.select("note_id", "s.hadm_id", "sentence_index", "s.entity_group", "s.word", "s.start", "s.end_", "s.score", "s.source_model", F.col("s.entity_group").alias("entity_type"), "accepted_no")


def _contains_any(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(words))


def is_disease_term(c: Column) -> Column:
    x = F.lower(c)
    return _contains_any(x, DISEASE_MARKERS) & ~_contains_any(x, TREATMENT_CUES)


def is_noise_entity(c: Column) -> Column:
    """Blank, or a single word of the noise list."""
    x = norm(c)
    return (x == "") | (~x.contains(" ") & x.isin(NOISE_WORDS))


def is_low_information(word: Column, label: Column) -> Column:
    x = norm(word)
    return label.isin("treatment", "problem") & ~x.contains(" ") & x.isin(STOPWORDS)


def drop_unlinked_units(entities: DataFrame) -> DataFrame:
    """Strength and dosage spans only where their sentence holds a drug."""
    label = norm("entity_group")
    sentence = Window.partitionBy("note_id", "sentence_index")
    with_flag = entities.withColumn("_has_drug", F.max(F.coalesce(label == "drug", F.lit(False))).over(sentence))
    return with_flag.where(~F.coalesce(label.isin(UNITS_REQUIRING_DRUG), F.lit(False)) | F.col("_has_drug")).drop("_has_drug")


def polish_entities(entities: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Word pieces, short words, noise and stop words out; disease-like treatments become problems; units need a drug;
    words in lower case. ``tags`` (word, tag, is_stop of single words, see ``models.word_tags``): single words with a noise
    tag, and stop words that are treatments or problems, go too."""
    e = entities.where(~F.col("word").contains("##") & (F.length("word") > 2)).withColumn("_label", norm("entity_group"))
    e = e.where(~F.col("_label").contains("label")).where(~is_noise_entity(F.col("word"))).where(~is_low_information(F.col("word"), F.col("_label")))
    if tags is not None:
        e = e.withColumn("_single", norm("word")).join(tags.select(F.col("word").alias("_single"), F.col("tag").alias("_tag"), F.col("is_stop").alias("_stop")), "_single", "left")
        stop = F.col("_label").isin("treatment", "problem") & F.col("_stop")
        e = e.where(~F.coalesce(F.col("_tag").isin(NOISE_TAGS), F.lit(False)) & ~F.coalesce(stop, F.lit(False))).drop("_single", "_tag", "_stop")
    e = e.withColumn("entity_group", F.when((F.col("_label") == "treatment") & is_disease_term(F.col("word")), "problem").otherwise(F.col("entity_group"))).drop("_label")
    return drop_unlinked_units(e).withColumn("word", norm("word"))


def in_order(entities: DataFrame) -> DataFrame:
    """Entities by note, sentence and word, ties by their other columns."""
    return entities.orderBy("note_id", "sentence_index", "word", *[c for c in TOTAL if c != "word"])


def dedupe_entities(entities: DataFrame, per: list[str]) -> DataFrame:
    """The first row (by start, end and the other columns) of each word in any case and label."""
    w = Window.partitionBy(*per, F.lower("word"), "entity_group").orderBy(*TOTAL, "sentence_index")
    return entities.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def verify_drugs(entities: DataFrame, prescriptions: DataFrame, label: str = "CHEMICAL") -> DataFrame:
    """hadm_id, drug, normalized, status: a drug is Verified if it holds, or is held by, a prescribed drug of the same
    admission. Different drugs are compared once; the join is on the admission and one of SALTS shares of its drugs, so
    that an admission with very many drugs is worked on by several tasks; the match is a residual condition."""
    drugs = entities.where(F.col("entity_group") == label).select("hadm_id", strip_ws(F.col("word")).alias("drug")).distinct()
    drugs = drugs.where(~is_drug_noise(F.col("drug"))).withColumn("normalized", normalize_drug(F.col("drug")))
    given = prescriptions.where(F.col("drug").isNotNull()).select("hadm_id", norm("drug").alias("given")).distinct()
    both = F.col("given").contains(F.col("normalized")) | F.col("normalized").contains(F.col("given"))
    mine = drugs.withColumn("salt", F.pmod(F.xxhash64("drug"), F.lit(SALTS)).cast("int"))
    theirs = given.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = mine.join(theirs, ["hadm_id", "salt"]).where(both).select("hadm_id", "drug").distinct().withColumn("hit", F.lit(True))
    return drugs.join(found, ["hadm_id", "drug"], "left").select("hadm_id", "drug", "normalized", F.when(F.col("hit"), "Verified").otherwise("Unverified").alias("status"))
