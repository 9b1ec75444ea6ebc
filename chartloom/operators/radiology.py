"""Findings of radiology reports: pairs within sentences, severity, edges, bundles. All partition by note."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.functions.text import finding_relation, measurements, negations, severity
from chartloom.operators.entities import TOTAL
from chartloom.runtime import large

PAIR_CONFIDENCE, LEAST_CONFIDENCE = 0.75, 0.50


def first_sentence(sentences: DataFrame) -> DataFrame:
    """note_id, sentence_index, context: of several sentences with one index the one of the first section."""
    return sentences.groupBy("note_id", "sentence_index").agg(F.min_by("sentence_text", "section_ord").alias("context"))


def finding_pairs(entities: DataFrame, sentences: DataFrame) -> DataFrame:
    """All pairs of a sentence's entities in their order, with the relation that the sentence's cues give. The pairs of a
    sentence are its result by definition, and bounded by its length; they are made where its entities have come together,
    in one shuffle."""
    spans = entities.groupBy("note_id", "sentence_index").agg(F.array_sort(F.collect_list(F.struct(*TOTAL, "hadm_id"))).alias("spans"))
    j = spans.where(F.size("spans") > 1).join(large(first_sentence(sentences)), ["note_id", "sentence_index"], "left").withColumn("relation_type", finding_relation(F.col("context")))
    left = j.select("note_id", "sentence_index", "relation_type", "spans", F.posexplode("spans").alias("i", "a"))
    pairs = left.select("note_id", "sentence_index", "relation_type", "a", (F.col("i") + 1).alias("ord_1"), F.posexplode(F.slice("spans", F.col("i") + 2, F.size("spans"))).alias("k", "b"))
    return pairs.select(
        "note_id", "sentence_index", "a.hadm_id", F.col("a.word").alias("entity_1"), F.col("a.entity_group").alias("entity_type_1"), "ord_1", F.col("b.word").alias("entity_2"), F.col("b.entity_group").alias("entity_type_2"),
        (F.col("ord_1") + 1 + F.col("k")).alias("ord_2"), "relation_type", F.lit(PAIR_CONFIDENCE).alias("confidence"),
    )


def finding_relations(entities: DataFrame, sentences: DataFrame) -> DataFrame:
    return finding_pairs(entities, sentences).where(F.col("relation_type").isNotNull())


def severity_map(entities: DataFrame, sentences: DataFrame) -> DataFrame:
    """note_id, word, severity: the reading of the note's last entity with that word."""
    j = entities.join(large(first_sentence(sentences)), ["note_id", "sentence_index"], "left").withColumn("severity", severity(F.col("context"), F.col("word")))
    return j.groupBy("note_id", "word").agg(F.max_by("severity", F.struct("sentence_index", *TOTAL)).alias("severity"))


def severity_counts(severities: DataFrame) -> DataFrame:
    return severities.groupBy("severity").agg(F.count("*").alias("n"))


def section_summary(entities: DataFrame) -> DataFrame:
    """note_id, section_name (always all_sections), words: the note's different words by first appearance."""
    first = entities.groupBy("note_id", "word").agg(F.min(F.struct("sentence_index", "start", "end_")).alias("at"))
    words = F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])
    return first.groupBy("note_id").agg(words.alias("words")).select("note_id", F.lit("all_sections").alias("section_name"), "words")


def radiology_edges(pairs: DataFrame, severities: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """Edges of related findings of enough confidence, with both severities and the alignment score.

    A severity is looked up under the finding in lower case and, if that is not there, as it is written. ``subjects``
    (note_id, subject_id; one row per note) adds the patient."""
    rows = pairs.where(F.col("relation_type").isNotNull() & (F.col("confidence") >= LEAST_CONFIDENCE) & (F.trim("entity_1") != "") & (F.trim("entity_2") != ""))
    # a note's words are bounded by its length: one map per note and one join answer all four look-ups
    of_note = severities.where(F.col("word").isNotNull()).groupBy("note_id", "word").agg(F.max("severity").alias("severity")).groupBy("note_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "severity"))).alias("known"))
    out = rows.join(large(of_note), "note_id", "left")
    for k, side in ((1, "source"), (2, "target")):
        raw = F.trim(f"entity_{k}")
        out = out.withColumn(f"{side}_severity", F.coalesce(F.col("known")[F.lower(raw)], F.col("known")[raw])).withColumn(f"entity_{k}", F.lower(raw))
    who = []
    if subjects is not None:
        out, who = out.join(large(subjects.select("note_id", "subject_id")), "note_id", "left"), ["subject_id"]
    return out.select(
        "hadm_id", *who, F.col("note_id").alias("source_note"), "entity_1", "entity_2", "relation_type", F.col("confidence").alias("model_confidence"), F.col("entity_type_1").alias("source_type"),
        F.col("entity_type_2").alias("target_type"), "source_severity", "target_severity", F.round(0.6 + 0.35 * F.col("confidence"), 4).alias("alignment_score"),
    )


def radiology_nodes(entities: DataFrame) -> DataFrame:
    """hadm_id, node: the different words of an admission in lower case."""
    return entities.where(F.trim("word") != "").select("hadm_id", F.lower(F.trim("word")).alias("node")).distinct()


def radiology_links(edges: DataFrame) -> DataFrame:
    """hadm_id, source, target, relation_type, confidence: the different edges of an admission."""
    return edges.select("hadm_id", F.col("entity_1").alias("source"), F.col("entity_2").alias("target"), "relation_type", F.col("model_confidence").alias("confidence")).distinct()


def radiology_graph(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """hadm_id, part (node or edge), source, target, relation_type, confidence: an admission's graph as rows, which no
    admission, however many notes it has, makes too large for a task."""
    nodes = radiology_nodes(entities).select("hadm_id", F.lit("node").alias("part"), F.col("node").alias("source"))
    return nodes.unionByName(radiology_links(edges).withColumn("part", F.lit("edge")), allowMissingColumns=True)


def packed_graph(graph: DataFrame) -> DataFrame:
    """hadm_id, nodes, edges: the rows of ``radiology_graph`` as one record per admission, for an export of single admissions."""
    node, edge = F.when(F.col("part") == "node", F.col("source")), F.when(F.col("part") == "edge", F.struct("source", "target", "relation_type", "confidence"))
    return graph.groupBy("hadm_id").agg(F.sort_array(F.collect_list(node)).alias("nodes"), F.sort_array(F.collect_list(edge)).alias("edges"))


def enhance(notes: DataFrame, entities: DataFrame, sentences: DataFrame) -> DataFrame:
    """One row per note: measurements, negations, section_summary, finding_relationships, severity_classification."""
    pack = lambda d, cols, name: d.groupBy("note_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    out = notes.select("note_id").distinct()
    rel = finding_relations(entities, sentences)
    sev = severity_map(entities, sentences)
    for part in (
        pack(measurements(notes, "note_id", "text"), ["form", "start", "end_", "measurement", "dim_1", "dim_2", "dim_3", "unit"], "measurements"),
        pack(negations(notes, "note_id", "text"), ["pattern_no", "start", "end_", "finding", "full_text"], "negations"),
        section_summary(entities).select("note_id", F.create_map("section_name", "words").alias("section_summary")),
        pack(rel, ["sentence_index", "ord_1", "ord_2", "entity_1", "entity_type_1", "entity_2", "entity_type_2", "relation_type", "confidence"], "finding_relationships"),
        sev.groupBy("note_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "severity")))).alias("severity_classification")),
    ):
        out = out.join(large(part), "note_id", "left")
    return out
