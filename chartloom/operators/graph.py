"""Relation tracks, longitudinal edges, alignment scores and admission graphs."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.functions.safe import json_safe
from chartloom.operators.ontology import UNMAPPED

# Least confidence of the tracks and the parts of the alignment score.
ADE_LEAST, TREATMENT_LEAST = 0.75, 0.65
NOTE_BOOST, SECTION_BOOST = 0.05, 0.05
# Colours of edges that several notes or sections agree on, and of the others.
CONSENSUS_COLOR, SINGLE_COLOR = "#f59e0b", "#2dd4bf"
# The decimals in which confidences are summed, and the largest that is; 10^10 of these fit the sum.
EXACT, EXACT_MOST = "decimal(28, 22)", 1e5


def ade_track(relations: DataFrame) -> DataFrame:
    return relations.where((F.col("relation_type") == "CAUSES") & (F.col("model_confidence") >= ADE_LEAST))


def treatment_track(relations: DataFrame) -> DataFrame:
    return relations.where((F.col("relation_type") == "TREATS") & (F.col("model_confidence") >= TREATMENT_LEAST))


def longitudinal_edges(relations: DataFrame) -> DataFrame:
    """One edge per admission, concept pair and relation: notes and sections in order, names of the first note, mentions,
    mean confidence of the mentions that have one. Mentions are first summed per note and section, so a hot edge is shuffled
    as a few rows. Sums of doubles depend on the order of rows, which turns scores at a half into one or the other rounded
    value; confidences are therefore summed as decimals, and only what these cannot hold (NaN, infinities) as doubles."""
    keys = ["hadm_id", "cui_1", "cui_2", "relation_type"]
    clean = relations.where((F.col("cui_1") != UNMAPPED) & (F.col("cui_2") != UNMAPPED) & F.col("target_semantic_valid")).dropna(subset=keys)
    c = F.col("model_confidence")
    fits = F.abs(c) <= EXACT_MOST
    part = clean.groupBy(*keys, "note_id", "section_name").agg(
        F.count("*").alias("n"), F.count(c).alias("known"), F.sum(F.when(fits, c).cast(EXACT)).alias("s"), F.sum(F.when(~fits, c)).alias("rest"),
        F.min(F.struct("canonical_name_1", "canonical_name_2")).alias("names"),
    )
    edges = part.groupBy(*keys).agg(
        F.sort_array(F.collect_set("note_id")).alias("note_occurrences"),
        F.sort_array(F.collect_set("section_name")).alias("sections_found"),
        F.min(F.struct("note_id", "section_name", "names")).alias("head"),
        F.sum("n").alias("mention_count"),
        F.try_divide(F.coalesce(F.sum("s").cast("double"), F.lit(0.0)) + F.coalesce(F.sum("rest"), F.lit(0.0)), F.sum("known")).alias("base_confidence"),
    )
    return edges.select(
        "hadm_id", F.col("cui_1").alias("source_cui"), F.col("head.names.canonical_name_1").alias("source_name"), F.col("cui_2").alias("target_cui"),
        F.col("head.names.canonical_name_2").alias("target_name"), F.col("relation_type").alias("relation"), "note_occurrences", "sections_found", "mention_count", "base_confidence",
    )


def alignment_score(edges: DataFrame, note_boost: float = NOTE_BOOST) -> DataFrame:
    """base + boost for every further note + a boost for more than one section, at most 1. The boost of all notes is the
    product of decimals: three times 0.05 is 0.15, as doubles a little more."""
    notes, sections = F.size("note_occurrences"), F.size("sections_found")
    raw = F.col("base_confidence") + F.when(notes > 1, ((notes - 1) * F.lit(Decimal(str(note_boost)))).cast("double")).otherwise(0.0) + F.when(sections > 1, SECTION_BOOST).otherwise(0.0)
    return edges.withColumn("alignment_score", F.least(F.lit(1.0), raw))


#: What orders the edges of an admission.
EDGE_ORDER = ["source_cui", "target_cui", "relation"]


def node_centrality(edges: DataFrame) -> DataFrame:
    """hadm_id, cui, name, centrality: edge ends at each node (a loop counts twice); the name by its first appearance, the
    edges in the order of EDGE_ORDER and the source of an edge before its target."""
    end = lambda k, side: F.struct(F.lit(k).alias("end"), F.col(f"{side}_cui").alias("cui"), F.col(f"{side}_name").alias("name"))
    ends = edges.select("hadm_id", F.struct(*EDGE_ORDER).alias("at"), F.explode(F.array(end(0, "source"), end(1, "target"))).alias("x"))
    return ends.groupBy("hadm_id", "x.cui").agg(F.min_by("x.name", F.struct("at", "x.end")).alias("name"), F.count("*").alias("centrality"))


def knowledge_graph(edges: DataFrame) -> DataFrame:
    """One row per admission: summary struct, nodes and edges as arrays of structs. An admission's graph is one record by
    definition; its size is bounded by its different concept pairs, not by its notes."""
    consensus = (F.size("note_occurrences") > 1) | (F.size("sections_found") > 1)
    e = edges.select("hadm_id", F.struct(
        F.col("source_cui").alias("source"), F.col("target_cui").alias("target"), "relation", F.round("alignment_score", 3).alias("alignment_score"),
        F.col("note_occurrences").alias("evidence_notes"), F.col("sections_found").alias("evidence_sections"), consensus.alias("is_consensus"),
    ).alias("edge"))
    packed = e.groupBy("hadm_id").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    nodes = node_centrality(edges).groupBy("hadm_id").agg(F.sort_array(F.collect_list(F.struct(F.col("cui").alias("id"), "name", "centrality"))).alias("nodes"))
    j = packed.join(nodes, "hadm_id")
    sure = F.size(F.filter("edges", lambda x: x["is_consensus"]))
    summary = F.struct(F.size("nodes").alias("total_nodes"), F.size("edges").alias("total_edges"), F.round(F.coalesce(F.try_divide(sure, F.size("edges")), F.lit(0.0)), 3).alias("consensus_ratio"))
    return j.select("hadm_id", summary.alias("summary"), "nodes", "edges")


def graph_visuals(nodes: DataFrame) -> DataFrame:
    """Nodes with a drawn size of 14 to 42 by their share of the admission's highest centrality."""
    top = nodes.groupBy("hadm_id").agg(F.max("centrality").alias("top"))
    return nodes.join(top, "hadm_id").withColumn("node_size", F.round(14 + 28 * F.col("centrality") / F.col("top"), 6)).drop("top")


def edge_visuals(edges: DataFrame) -> DataFrame:
    """Scored edges with a drawn width by their score and a colour by consensus."""
    agreed = (F.size("note_occurrences") > 1) | (F.size("sections_found") > 1)
    return edges.withColumn("edge_width", F.round(1.5 + F.col("alignment_score") * 2, 6)).withColumn("edge_color", F.when(agreed, CONSENSUS_COLOR).otherwise(SINGLE_COLOR))


def graph_rows(edges: DataFrame) -> DataFrame:
    """hadm_id, part (node or edge), source, target, name, relation, centrality, alignment_score, is_consensus: the graphs of
    all admissions as rows."""
    nodes = node_centrality(edges).select("hadm_id", F.lit("node").alias("part"), F.col("cui").alias("source"), "name", "centrality")
    agreed = (F.size("note_occurrences") > 1) | (F.size("sections_found") > 1)
    links = edges.select("hadm_id", F.lit("edge").alias("part"), F.col("source_cui").alias("source"), F.col("target_cui").alias("target"), "relation", F.round("alignment_score", 3).alias("alignment_score"), agreed.alias("is_consensus"))
    return nodes.unionByName(links, allowMissingColumns=True)


def to_json_graph(graph: DataFrame) -> DataFrame:
    """hadm_id and the graph as one JSON text; NaN and infinities become null at every depth."""
    safe = json_safe(graph)
    return safe.select("hadm_id", F.to_json(F.struct("hadm_id", "summary", "nodes", "edges")).alias("graph_json"))
