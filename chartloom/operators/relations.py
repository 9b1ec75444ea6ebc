"""Pairs of entities within a window of sentences, and their relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions.models import evidence_classifier, relation_classifier
from chartloom.operators.entities import TOTAL, norm
from chartloom.runtime import cut_lineage, large

# Sections, labels, windows and thresholds of the batch and the interactive configuration.
BATCH_SECTIONS = ["HPI", "Hospital Course", "Assessment/Plan", "Findings", "Impression"]
API_SECTIONS = [*BATCH_SECTIONS, "Medications"]
BATCH = {"drugs": ["DRUG"], "problems": ["problem"], "window": 1, "sections": BATCH_SECTIONS}
API = {"drugs": ["DRUG", "treatment", "TREATMENT"], "problems": ["problem", "PROBLEM"], "window": 2, "sections": API_SECTIONS}
RELAXED_WINDOW, API_THRESHOLD, API_FILTER = 4, 0.50, 0.60
STRICT_SECTIONS, STRICT_THRESHOLD, OTHER_THRESHOLD = ["HPI", "Hospital Course"], 0.80, 0.65
_ENTITY = ["sentence_index", *TOTAL]


def _side(group: str) -> Column:
    """1 for an act (drug, treatment), 2 for an observation (problem, test), else null."""
    label = norm(group)
    return F.when(label.isin("drug", "treatment"), 1).when(label.isin("problem", "test"), 2)


def sentence_lookup(sentences: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """note_id, keys, sentence_index, section_name, sentence_text: of several sentences with one index the one of the last
    section wins."""
    last = sentences.groupBy("note_id", *keys, "sentence_index").agg(F.max_by(F.struct("section_name", "sentence_text"), "section_ord").alias("s"))
    return last.select("note_id", *keys, "sentence_index", "s.*")


def pair_dedup(pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The first pair of each (note, keys, start_1, start_2), by the left row, then the right row."""
    order = [f"{c}_{s}" for s in (1, 2) for c in _ENTITY]
    w = Window.partitionBy("note_id", *keys, "start_1", "start_2").orderBy(*order)
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def candidate_pairs(entities: DataFrame, sentences: DataFrame, types: list[str], window: int, keys: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """Pairs of one note with start_1 < start_2, at most ``window`` sentences apart, one side an act (drug, treatment) and
    the other an observation (problem, test), with the section of the first.

    The join is on the note and a bucket of ``window + 1`` sentences: the left row lies in its own bucket, the right one is
    also sent to both neighbours, so that every pair within the window meets once and a long note is spread over its
    buckets. The type filter runs before the join; the other conditions are part of it. ``keys``: further columns that a
    sentence is known by (``section_ord``), where both tables have them, so that sections with colliding sentence numbers
    do not mix. ``with_text`` adds the sentence of the first as ``text_1``."""
    e = entities.where(F.col("entity_group").isin(types)).select("note_id", "hadm_id", *keys, *_ENTITY, _side("entity_group").alias("side")).where("side IS NOT NULL")
    bucket = F.floor(F.col("sentence_index") / F.lit(window + 1))
    a = e.select("note_id", *keys, "hadm_id", *[F.col(c).alias(f"{c}_1") for c in _ENTITY], F.col("side").alias("side_1"), bucket.alias("bucket"))
    b = e.select("note_id", *keys, F.col("hadm_id").alias("hadm_b"), *[F.col(c).alias(f"{c}_2") for c in _ENTITY], F.col("side").alias("side_2"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    near = F.abs(F.col("sentence_index_1") - F.col("sentence_index_2")) <= window
    fits = F.col("hadm_id").eqNullSafe(F.col("hadm_b")) & (F.col("start_1") < F.col("start_2")) & near & (F.col("side_1") != F.col("side_2"))
    pairs = a.join(large(b), ["note_id", *keys, "bucket"]).where(fits).drop("hadm_b", "bucket", "side_1", "side_2").withColumn("sentence_diff", F.abs(F.col("sentence_index_1") - F.col("sentence_index_2")))
    text = [F.col("sentence_text").alias("text_1")] if with_text else []
    names = sentence_lookup(sentences, keys).select("note_id", *keys, F.col("sentence_index").alias("sentence_index_1"), "section_name", *text)
    return pairs.join(large(names), ["note_id", *keys, "sentence_index_1"], "left").withColumn("section_name", F.coalesce("section_name", F.lit("unknown")))


def narrowed(pairs: DataFrame, window: int, sections: list[str] | None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Candidate pairs of a window and of sections, each (note, keys, start_1, start_2) once."""
    kept = pairs.where(F.col("sentence_diff") <= window)
    return pair_dedup(kept.where(F.col("section_name").isin(sections)) if sections else kept, keys)


def cooccurrence_pairs(entities: DataFrame, sentences: DataFrame, types: list[str], window: int, sections: list[str] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    return narrowed(candidate_pairs(entities, sentences, types, window, keys), window, sections, keys)


def section_threshold(section: Column) -> Column:
    return F.when(section.isin(STRICT_SECTIONS), F.lit(STRICT_THRESHOLD)).otherwise(F.lit(OTHER_THRESHOLD))


def with_relation(pairs: DataFrame, sentences: DataFrame, config: dict, classify=None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Drug-problem pairs with ``context`` (the sentence of both, or the two joined) and the relation and score that
    ``classify`` (see ``models.relation_classifier``) gives the context, the drug and the disease."""
    drugs, problems = config["drugs"], config["problems"]
    exact = (F.col("entity_group_1").isin(drugs) & F.col("entity_group_2").isin(problems)) | (F.col("entity_group_1").isin(problems) & F.col("entity_group_2").isin(drugs))
    text = sentence_lookup(sentences, keys)
    rows = pairs.where(exact)
    for k in (1, 2):
        if f"text_{k}" not in rows.columns:
            other = text.select("note_id", *keys, F.col("sentence_index").alias(f"sentence_index_{k}"), F.col("sentence_text").alias(f"text_{k}"))
            rows = rows.join(large(other), ["note_id", *keys, f"sentence_index_{k}"], "left")
    one, two = F.coalesce("text_1", F.lit("")), F.coalesce("text_2", F.lit(""))
    rows = rows.withColumn("context", F.when(F.col("sentence_diff") == 0, one).otherwise(F.concat(one, F.lit(" "), two))).drop("text_1", "text_2")
    first = F.col("entity_group_1").isin(drugs)
    drug, disease = F.when(first, F.col("word_1")).otherwise(F.col("word_2")), F.when(first, F.col("word_2")).otherwise(F.col("word_1"))
    if classify is None:
        relation, score = relation_classifier()(F.col("context"))
        return rows.withColumn("relation_type", relation).withColumn("model_confidence", score)
    asked = {"context": F.coalesce("context", F.lit("")), "_drug": F.coalesce(drug, F.lit("")), "_disease": F.coalesce(disease, F.lit(""))}
    return _answered(rows.withColumns(asked), list(asked), classify, "relation_type", "model_confidence").drop("_drug", "_disease")


def _answered(rows: DataFrame, asked: list[str], model, label: str, score: str) -> DataFrame:
    """``rows`` with what a model says of the columns ``asked``; each different question is put once."""
    one = rows.select(*asked).distinct()
    says, sure = model(*[F.col(c) for c in asked])
    return rows.join(large(one.withColumn(label, says).withColumn(score, sure)), asked)


def accepted(rows: DataFrame, least: Column, evidence=None) -> DataFrame:
    """TREATS and CAUSES relations whose score reaches ``least``, with the kind of evidence that ``evidence`` (see
    ``models.evidence_classifier``) sees in the context; only accepted rows are asked."""
    kept = rows.where(F.col("relation_type").isin("TREATS", "CAUSES") & (F.col("model_confidence") >= least))
    if evidence is None:
        kind, score = evidence_classifier()(F.lit(None).cast("string"))
        return kept.withColumn("evidence_type", kind).withColumn("evidence_confidence", score).drop("context")
    return _answered(kept.withColumn("context", F.coalesce("context", F.lit(""))), ["context"], evidence, "evidence_type", "evidence_confidence").drop("context")


def extract_relations(entities: DataFrame, sentences: DataFrame, config: dict, threshold: Column | float | None = None, classify=None, evidence=None, keys: tuple[str, ...] = ()) -> DataFrame:
    """TREATS and CAUSES relations of drug-problem pairs whose score reaches the threshold (a column, a number, or the
    section's own)."""
    pairs = cooccurrence_pairs(entities, sentences, config["drugs"] + config["problems"], config["window"], config["sections"], keys)
    least = section_threshold(F.col("section_name")) if threshold is None else threshold if isinstance(threshold, Column) else F.lit(threshold)
    return accepted(with_relation(pairs, sentences, config, classify, keys), least, evidence)


def relaxed_fallback(entities: DataFrame, sentences: DataFrame, classify=None, evidence=None, keys: tuple[str, ...] = ()) -> DataFrame:
    """The interactive configuration; notes without any result are tried again with a wider window and all sections.

    The wider candidates hold the strict ones: they are joined and classified once and written once; both passes are
    windows over them.
    """
    found = candidate_pairs(entities, sentences, API["drugs"] + API["problems"], RELAXED_WINDOW, keys, with_text=True)
    found = with_relation(found, sentences, API, classify, keys)
    found = cut_lineage(found if evidence else found.drop("context"))  # contexts go on only to a model that reads them
    strict = accepted(narrowed(found, API["window"], API["sections"], keys), F.lit(API_THRESHOLD), evidence)
    wide = accepted(narrowed(found, RELAXED_WINDOW, None, keys), F.lit(API_THRESHOLD), evidence)
    rest = wide.join(large(strict.select("note_id").distinct()), "note_id", "left_anti")
    return strict.withColumn("pass", F.lit("strict")).unionByName(rest.withColumn("pass", F.lit("relaxed"))).where(F.col("model_confidence") >= API_FILTER)


def relation_counts(relations: DataFrame) -> DataFrame:
    """One row: relations, and those of each kind."""
    return relations.agg(F.count("*").alias("relations"), F.count_if(F.col("relation_type") == "CAUSES").alias("causes"), F.count_if(F.col("relation_type") == "TREATS").alias("treats"))
