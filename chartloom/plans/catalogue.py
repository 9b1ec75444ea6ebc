"""All queries of the core, by name: one per operator, each over whole tables of a data folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom import schemas
from chartloom.functions import models, text
from chartloom.operators import entities, graph, notes, ontology, radiology, relations, units
from chartloom.plans import fixtures as fx
from chartloom.plans import oracles
from chartloom.runtime import cut_lineage, shared_dir, table
from chartloom.sources import readers, sinks
from chartloom.streaming import notes_stream as stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _notes(s, d):
    return fx.view(s, d, fx.NOTES)


def _ent(s, d):
    return fx.view(s, d, fx.ENT)


def _sent(s, d):
    return fx.view(s, d, fx.SENT)


def _rel(s, d):
    return fx.view(s, d, fx.REL)


def _edges(s, d):
    return graph.longitudinal_edges(_rel(s, d))


def sentences_of(raw: DataFrame, splitter=None) -> DataFrame:
    """Cleaned notes cut into sections and sentences, where they are read: nothing is shuffled."""
    cleaned = raw.withColumn("text", text.clean_text(F.col("text")))
    sections = notes.segment_sections(cleaned, keep=("hadm_id",))
    return notes.split_sentences(sections, ["note_id", "hadm_id", "section_ord", "section_name"], "section_text", splitter)


def pipeline(raw: DataFrame, kb: DataFrame, recognisers=None, splitter=None, classify=None, evidence=None, tags=None) -> DataFrame:
    """Raw notes to relations: clean, segment, split, recognise (the lexicon and all given recognisers), merge, polish, pair,
    classify, link. Sentences, entities and relations are each used several times below, so each is written once."""
    sents = cut_lineage(sentences_of(raw, splitter))
    found = cut_lineage(entities.polish_entities(entities.merge_entities(models.recognise(sents, recognisers)), tags))
    return ontology.link_relations(cut_lineage(relations.relaxed_fallback(found, sents, classify, evidence)), kb)


def radiology_pipeline(raw: DataFrame, recognisers=None, splitter=None) -> DataFrame:
    """Raw notes to edges between radiological findings, with the patient of each."""
    reports = raw.where(text.note_track(F.col("note_type")) == "radiology")
    sents = cut_lineage(sentences_of(reports, splitter))
    found = cut_lineage(entities.merge_entities(models.recognise(sents, recognisers)).select("note_id", "hadm_id", "sentence_index", "entity_group", "word", "start", "end_", "score", "source_model"))
    return radiology.radiology_edges(radiology.finding_pairs(found, sents), radiology.severity_map(found, sents), reports.select("note_id", "subject_id"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Raw notes to linked relations."""
    out = pipeline(_notes(s, d), fx.view(s, d, fx.KB))
    return out.select("note_id", "hadm_id", "section_name", "word_1", "word_2", "relation_type", "model_confidence", "cui_1", "cui_2", "target_semantic_valid")


@query
def note_pipeline(s, d):
    return flagship(s, d)


@query
def longitudinal_pipeline(s, d):
    """Raw notes to scored longitudinal edges; either side of a relation may be the drug, so both directions count as valid."""
    rel = pipeline(_notes(s, d), fx.view(s, d, fx.KB)).withColumn("target_semantic_valid", F.lit(True))
    e = graph.alignment_score(graph.longitudinal_edges(rel))
    return e.select("hadm_id", "source_cui", "source_name", "target_cui", "target_name", "relation", F.array_join("note_occurrences", "|").alias("note_occurrences"), "mention_count", F.round("base_confidence", 6).alias("base_confidence"), F.round("alignment_score", 6).alias("alignment_score"))


@query
def scan_multi_note(s, d):
    return notes.scan_multi_note(_notes(s, d))


@query
def scan_diagnoses(s, d):
    return notes.scan_diagnoses(fx.view(s, d, fx.DIAG))


@query
def single_note(s, d):
    return notes.single_note(_notes(s, d))


@query
def distinct_prescriptions(s, d):
    return notes.distinct_prescriptions(fx.view(s, d, fx.RX))


@query
def constant_query(s, d):
    return readers.read(s, "sql")


@query
def clean_text(s, d):
    return _notes(s, d).select("note_id", text.clean_text(F.col("text")).alias("clean_text"))


@query
def legacy_clean(s, d):
    return table(s, d, "documents").select("doc_id", text.legacy_clean(F.col("text")).alias("cleaned_text"))


@query
def legacy_abbrev(s, d):
    return _notes(s, d).select("note_id", text.expand(F.col("text"), text.LEGACY_ABBREVIATIONS).alias("expanded"))


@query
def expand_second(s, d):
    return _notes(s, d).select("note_id", text.expand_once(F.concat("text", F.lit(" ivf and CT")), text.ABBREVIATIONS_2).alias("expanded"))


@query
def linked_or_unmapped(s, d):
    """The least score that a first candidate needs, on the small ontology's aliases."""
    return models.linked_or_unmapped(fx.view(s, d, fx.KB).withColumnRenamed("alias", "text"), 0.95)


@query
def strip_dosage(s, d):
    return _notes(s, d).select("note_id", text.strip_dosage(F.concat("text", F.lit(" 50 mg 2ml 3 units"))).alias("stripped"))


@query
def normalize_drug(s, d):
    return fx.view(s, d, fx.RX).groupBy("drug", text.normalize_drug(F.col("drug")).alias("normalized")).agg(F.count("*").alias("n"))


@query
def drug_noise(s, d):
    return _ent(s, d).groupBy("word", text.is_drug_noise(F.col("word")).alias("noise")).agg(F.count("*").alias("n"))


@query
def ocr_normalize(s, d):
    return text.ocr_normalize(_notes(s, d).select("note_id", "text"), "text")


@query
def note_track(s, d):
    return _notes(s, d).groupBy("note_type", text.note_track(F.col("note_type")).alias("track")).agg(F.count("*").alias("n"))


@query
def severity(s, d):
    return _notes(s, d).select("note_id", text.severity(F.col("text"), F.lit("")).alias("severity"))


@query
def keyword_relation(s, d):
    r, score = text.keyword_relation(F.col("text"))
    return _notes(s, d).select("note_id", r.alias("relation"), score.alias("score"))


@query
def finding_cue(s, d):
    return _notes(s, d).select("note_id", text.finding_relation(F.col("text")).alias("relation_type"))


@query
def measurements(s, d):
    return text.measurements(_notes(s, d), "note_id", "text")


@query
def negations(s, d):
    return text.negations(_notes(s, d), "note_id", "text")


@query
def segment_sections(s, d):
    return notes.segment_sections(_notes(s, d))


@query
def split_sentences(s, d):
    one = table(s, d, "sections").select("section_id", "section_text").distinct()
    return notes.split_sentences(one, ["section_id"], "section_text")


@query
def melt_sections(s, d):
    return notes.melt_sections(_notes(s, d).select("note_id", F.col("note_type").alias("Indication"), F.col("text").alias("Findings")), ["note_id"])


@query
def track_split(s, d):
    return notes.track_split(_sent(s, d)).groupBy("section_name", "track").agg(F.count("*").alias("n"))


@query
def icd_map(s, d):
    return notes.icd_map(fx.view(s, d, fx.DIAG), fx.view(s, d, fx.GEM))


@query
def span_iou(s, d):
    e = _ent(s, d).select("note_id", "sentence_index", "start", "end_")
    a = e.select("note_id", "sentence_index", F.col("start").alias("start_1"), F.col("end_").alias("end_1"))
    b = e.select("note_id", "sentence_index", F.col("start").alias("start_2"), F.col("end_").alias("end_2"))
    j = a.join(b, ["note_id", "sentence_index"]).where(F.struct("start_1", "end_1") < F.struct("start_2", "end_2"))
    return j.withColumn("iou", F.round(entities.span_iou(*[F.col(c) for c in ("start_1", "end_1", "start_2", "end_2")]), 6))


@query
def entity_priority(s, d):
    return _ent(s, d).groupBy("source_model", "entity_group", entities.priority().alias("priority"), entities.is_medication().alias("medication")).agg(F.count("*").alias("n"))


@query
def merge_entities(s, d):
    return entities.merge_entities(_ent(s, d))


@query
def drop_unlinked_units(s, d):
    return entities.drop_unlinked_units(_ent(s, d))


@query
def polish_entities(s, d):
    return entities.polish_entities(_ent(s, d))


@query
def dedupe_entities(s, d):
    return entities.dedupe_entities(_ent(s, d), ["note_id"])


@query
def verify_drugs(s, d):
    return entities.verify_drugs(_ent(s, d), fx.view(s, d, fx.RX), "DRUG")


@query
def cooccurrence_pairs(s, d):
    return relations.cooccurrence_pairs(_ent(s, d), _sent(s, d), ["DRUG", "problem", "treatment", "test"], 1, relations.BATCH_SECTIONS)


@query
def extract_relations(s, d):
    return relations.extract_relations(_ent(s, d), _sent(s, d), relations.BATCH)


@query
def relaxed_fallback(s, d):
    return relations.relaxed_fallback(_ent(s, d), _sent(s, d))


def _mentions(s, d):
    kinds = F.array(*[F.lit(k) for k in ("TREATS", "CAUSES", "NONE")])
    return _ent(s, d).select("word", "entity_group").distinct().withColumn("relation_type", F.explode(kinds))


@query
def link_concepts(s, d):
    return ontology.link_concepts(_mentions(s, d), fx.view(s, d, fx.KB), "target")


@query
def link_relations(s, d):
    linked = ontology.link_relations(cut_lineage(relations.relaxed_fallback(_ent(s, d), _sent(s, d))), fx.view(s, d, fx.KB))
    return linked.select("note_id", "start_1", "start_2", "relation_type", "cui_1", "canonical_name_1", "cui_2", "canonical_name_2", "target_semantic_valid")


@query
def target_valid(s, d):
    kb = fx.view(s, d, fx.KB)
    return ontology.target_valid(ontology.link_concepts(_mentions(s, d), kb, "target"), kb, "cui")


@query
def ade_track(s, d):
    return graph.ade_track(_rel(s, d))


@query
def treatment_track(s, d):
    return graph.treatment_track(_rel(s, d))


@query
def mapping_coverage(s, d):
    return ontology.mapping_coverage(_rel(s, d))


@query
def longitudinal_edges(s, d):
    e = _edges(s, d)
    return e.withColumns({"note_occurrences": F.array_join("note_occurrences", "|"), "sections_found": F.array_join("sections_found", "|"), "base_confidence": F.round("base_confidence", 6)})


@query
def alignment_score(s, d):
    return graph.alignment_score(_edges(s, d)).select("hadm_id", "source_cui", "target_cui", "relation", F.round("alignment_score", 6).alias("alignment_score"))


@query
def node_centrality(s, d):
    return graph.node_centrality(_edges(s, d))


@query
def graph_visuals(s, d):
    return graph.graph_visuals(graph.node_centrality(_edges(s, d))).select("hadm_id", "cui", "node_size")


@query
def graph_summary(s, d):
    return graph.knowledge_graph(graph.alignment_score(_edges(s, d))).select("hadm_id", "summary.*")


@query
def edge_visuals(s, d):
    return graph.edge_visuals(graph.alignment_score(_edges(s, d))).select("hadm_id", "source_cui", "target_cui", "relation", "edge_width", "edge_color")


@query
def graph_rows(s, d):
    return graph.graph_rows(graph.alignment_score(_edges(s, d)))


@query
def knowledge_graph(s, d):
    """The packed graphs, their arrays as text."""
    g = graph.knowledge_graph(graph.alignment_score(_edges(s, d)))
    nodes = F.array_join(F.transform("nodes", lambda n: F.concat_ws("|", n["id"], n["name"], n["centrality"].cast("string"))), ";")
    links = F.transform("edges", lambda e: F.concat_ws("|", e["source"], e["target"], e["relation"], F.array_join(e["evidence_sections"], "+"), e["is_consensus"].cast("string")))
    return g.select("hadm_id", "summary.*", nodes.alias("nodes"), F.array_join(links, ";").alias("edges"))


@query
def knowledge_graph_json(s, d):
    return graph.to_json_graph(graph.knowledge_graph(graph.alignment_score(_edges(s, d))))


@query
def finding_pairs(s, d):
    return radiology.finding_pairs(_ent(s, d), _sent(s, d))


@query
def finding_relations(s, d):
    return radiology.finding_relations(_ent(s, d), _sent(s, d))


@query
def severity_map(s, d):
    return radiology.severity_map(_ent(s, d), _sent(s, d))


@query
def severity_counts(s, d):
    return radiology.severity_counts(radiology.severity_map(_ent(s, d), _sent(s, d)))


@query
def section_summary(s, d):
    return radiology.section_summary(_ent(s, d)).withColumn("words", F.array_join("words", "|"))


@query
def radiology_edges(s, d):
    e, t = _ent(s, d), _sent(s, d)
    return radiology.radiology_edges(radiology.finding_pairs(e, t), radiology.severity_map(e, t))


def _radiology_graph(s, d):
    e, t = _ent(s, d), _sent(s, d)
    return radiology.radiology_graph(e, radiology.radiology_edges(radiology.finding_pairs(e, t), radiology.severity_map(e, t)))


@query
def radiology_graph(s, d):
    return _radiology_graph(s, d)


@query
def packed_radiology_graph(s, d):
    """The graph of each admission as one record; counts and nodes as text."""
    g = radiology.packed_graph(_radiology_graph(s, d))
    return g.select("hadm_id", F.array_join("nodes", "|").alias("nodes"), F.size("edges").alias("n_edges"))


@query
def radiology_track(s, d):
    """Raw radiology reports to edges between their findings."""
    return radiology_pipeline(_notes(s, d))


@query
def radiology_bundle(s, d):
    """The bundle of each note, its parts as text."""
    out = radiology.enhance(_notes(s, d), _ent(s, d), _sent(s, d))
    text_of = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), "|"), F.lit(""))
    return out.select(
        "note_id",
        text_of("measurements", lambda m: m["measurement"]).alias("measurements"),
        text_of("negations", lambda n: n["finding"]).alias("negations"),
        F.coalesce(F.array_join(F.get(F.map_values("section_summary"), 0), "|"), F.lit("")).alias("words"),
        text_of("finding_relationships", lambda r: F.concat_ws(">", r["entity_1"], r["relation_type"], r["entity_2"])).alias("relations"),
        text_of(F.map_entries("severity_classification"), lambda x: F.concat_ws("=", x["key"], x["value"])).alias("severities"),
    )


@query
def entity_type_counts(s, d):
    return _ent(s, d).groupBy("entity_group").agg(F.count("*").alias("n"))


@query
def entities_by_sentence(s, d):
    return _ent(s, d).groupBy("note_id", "sentence_index").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("word")), "|").alias("words"))


@query
def lexicon_entities(s, d):
    n = _notes(s, d).select("note_id", "hadm_id", F.lit(0).cast("bigint").alias("sentence_index"), F.col("text").alias("sentence_text"))
    return models.lexicon_entities(n)


@query
def cosine_similarity(s, d):
    """Each embedding against the mean of all. The mean is one row (as many sums as dimensions) and is broadcast."""
    e = table(s, d, "embeddings")
    mean = e.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m"))
    centre = mean.select(F.transform("m", lambda v: v["x"]).alias("centre"), F.lit(1).alias("one"))
    joined = e.withColumn("one", F.lit(1)).join(F.broadcast(centre), "one")
    return joined.select("vec_id", F.round(text.cosine(F.col("embedding"), F.col("centre")), 6).alias("cosine"))


@query
def relation_counts(s, d):
    return relations.relation_counts(_rel(s, d))


@query
def unmapped_count(s, d):
    return notes.unmapped_count(notes.icd_map(fx.view(s, d, fx.DIAG), fx.view(s, d, fx.GEM)))


@query
def count_metrics(s, d):
    """Counts of a result: entities, kinds of entities, relations, edges, nodes, agreed edges; one row each."""
    e = _edges(s, d)
    agreed = (F.size("note_occurrences") > 1) | (F.size("sections_found") > 1)
    one = lambda df, name, c: df.agg(F.lit(name).alias("metric"), c.cast("bigint").alias("value"))
    parts = [
        one(_ent(s, d), "entities", F.count("*")), one(_ent(s, d), "entity_types", F.count_distinct("entity_group")), one(_rel(s, d), "relations", F.count("*")),
        one(e, "edges", F.count("*")), one(graph.node_centrality(e), "nodes", F.count("*")), one(e, "agreed_edges", F.count_if(agreed)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def pair_dedup(s, d):
    """The first of all pairs of a sentence's entities with equal starts."""
    e = _ent(s, d)
    side = lambda k: e.select("note_id", *[F.col(c).alias(f"{c}_{k}") for c in ("sentence_index", *entities.TOTAL)])
    pairs = side(1).join(side(2).withColumn("sentence_index_1", F.col("sentence_index_2")), ["note_id", "sentence_index_1"]).where("start_1 < start_2")
    return relations.pair_dedup(pairs)


@query
def colliding_sections(s, d):
    """Pairs within a window where sections with equal sentence numbers are kept apart by section_ord."""
    e = _ent(s, d).join(_sent(s, d).select("note_id", "section_ord").distinct(), "note_id")
    return relations.cooccurrence_pairs(e, _sent(s, d), ["DRUG", "problem"], 1, None, ("section_ord",))


@query
def polish_order(s, d):
    """The place of each polished entity in its sentence by note, sentence and word, as the sink orders them."""
    p = entities.in_order(entities.polish_entities(_ent(s, d)))
    w = Window.partitionBy("note_id", "sentence_index").orderBy("word", *[c for c in entities.TOTAL if c != "word"])
    return p.select("note_id", "sentence_index", "word", "start", "end_", F.row_number().over(w).alias("place"))


def _words(s, d):
    """Sentences of the fixture as texts for the plug-ins."""
    return _sent(s, d).select("note_id", "hadm_id", "section_ord", "sentence_index", "sentence_text")


def _found_words(pattern: str, label: str):
    """A stand-in for a model: all places of a pattern."""
    return lambda: lambda texts: [[(label, m.group(), m.start(), m.end(), 0.75) for m in re.finditer(pattern, t)] for t in texts]


@query
def model_entities(s, d):
    """A registered recogniser (here all places of the word rash) through the surface of the clinical model."""
    models.register("rash", _found_words("rash", "problem"))
    return models.model_entities(_words(s, d), "rash", "ClinicalBERT")


@query
def windowed_model(s, d):
    """The same surface with a model that reads the first three words only."""
    models.register("late", _found_words("rash|drug", "FINDING"))
    return models.model_entities(_words(s, d), "late", "RadBERT", window=3)


@query
def legacy_recogniser(s, d):
    """The older recogniser's gate: only its two labels are kept."""
    models.register("legacy", lambda: lambda texts: [[("CHEMICAL", "aspirin", t.index("aspirin"), t.index("aspirin") + 7, 1.0)] if "aspirin" in t else [("OTHER", t[:4], 0, 4, 1.0)] for t in texts])
    return models.model_entities(_words(s, d), "legacy", "bc5cdr", labels=models.LEGACY_LABELS)


@query
def recognisers_union(s, d):
    """The lexicon and a registered model together."""
    models.register("rash", _found_words("rash", "problem"))
    found = models.recognise(_words(s, d), [("rash", "ClinicalBERT")])
    return found.groupBy("source_model", "entity_group", "word").agg(F.count("*").alias("n"))


@query
def model_splitter(s, d):
    """A registered splitter (here at blanks before the word of) in the place of the built-in rule."""
    models.register("at of", lambda: lambda texts: [re.split(r"\s(?=of\b)", t) for t in texts])
    return notes.split_sentences(_notes(s, d).select("note_id", "text"), ["note_id"], "text", models.sentence_splitter("at of"))


@query
def tagged_polish(s, d):
    """Polishing with a registered tagger (here ct is a verb and pneumonia a stop word)."""
    models.register("tagger", lambda: lambda words: [("VERB" if w == "sepsis" else "NOUN", w == "pneumonia") for w in words])
    return entities.polish_entities(_ent(s, d), models.word_tags(_ent(s, d), "tagger"))


@query
def model_relations(s, d):
    """Relations by a registered classifier of (context, drug, disease) and evidence by a registered one of the context."""
    models.register("asks", lambda: lambda rows: [("CAUSES" if drug.lower() == "aspirin" else "TREATS", 0.9 if "due to" in context else 0.7) for context, drug, _ in rows])
    models.register("evidence", lambda: lambda texts: [("clinical abbreviation", 0.8) if "drug" in t else ("direct implication", 0.6) for t in texts])
    return relations.extract_relations(_ent(s, d), _sent(s, d), relations.BATCH, 0.65, models.relation_classifier("asks"), models.evidence_classifier("evidence"))


@query
def model_probe(s, d):
    """Which models are there."""
    models.register("rash", _found_words("rash", "problem"))
    return s.createDataFrame([(n, models.available(n, m)) for n, m in (("rash", None), ("rash", "json"), ("rash", "no_such_module"), ("absent", None))], "name string, there boolean").groupBy("name").agg(F.count_if("there").alias("there"))


@query
def resembling_concepts(s, d):
    """Concepts of names that are written with a letter more than an alias."""
    kb = fx.view(s, d, fx.KB)
    words = _ent(s, d).select(F.concat(F.lower("word"), F.lit("e")).alias("word")).distinct()
    return ontology.resembling_aliases(words, kb, 0.6).select("word", "alias", F.round("similarity", 6).alias("similarity"))


@query
def csv_round_trip(s, d):
    """Entities written as CSV and read back."""
    path = f"{shared_dir(s)}/csv-{uuid.uuid4().hex}"
    sinks.write_csv(_ent(s, d), path)
    return readers.read(s, "csv", path=path, schema=schemas.ENTITIES)


@query
def json_round_trip(s, d):
    """Values with NaN at several depths as JSON lines and back."""
    path = f"{shared_dir(s)}/json-{uuid.uuid4().hex}"
    odd = F.when(F.col("p_size") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("p_size").cast("double"))
    rows = table(s, d, "part").select("p_partkey", odd.alias("v"), F.array(F.struct(odd.alias("w"))).alias("deep"))
    sinks.write_json(rows, path)
    back = readers.read(s, "json", path=path, schema="p_partkey bigint, v double, deep array<struct<w:double>>")
    return back.select("p_partkey", "v", F.get("deep", 0)["w"].alias("w"))


@query
def crosswalk_source(s, d):
    """The crosswalk from a CSV file, twice the same code in it, and from a file that is not there."""
    path = f"{shared_dir(s)}/gem-{uuid.uuid4().hex}"
    sinks.write_csv(fx.view(s, d, "SELECT * FROM (VALUES ('4019','X'), ('4019','I10'), ('25000','E119')) AS g(icd9_code, icd10_code)").coalesce(1), path)
    both = readers.read(s, "crosswalk", path=path).unionByName(readers.read(s, "crosswalk", path=path + "-absent"))
    return notes.icd_map(fx.view(s, d, fx.DIAG), both)


@query
def pdf_source(s, d):
    """Binary files to text by an extractor: the names of nations, written as files and read as bytes."""
    path = f"{shared_dir(s)}/pdf-{uuid.uuid4().hex}"
    table(s, d, "nation").select("n_name").write.text(path)
    return readers.read_pdf(s, path, extract=lambda b: b.decode()).select(F.explode(F.split(F.trim("text", F.lit("\n")), "\n")).alias("n_name"))


@query
def rows_source(s, d):
    """Uploaded files as note rows."""
    files = s.createDataFrame([("/in/a.pdf", "one"), ("/in/b.pdf", "two")], "path string, text string")
    return readers.uploaded_notes(files, 1, 2, "RR").unionByName(readers.read(s, "rows", rows=[(3, 4, "c", "discharge", "three")]))


@query
def relations_sink(s, d):
    """Relations by falling confidence: written, and read back with their place."""
    path = f"{shared_dir(s)}/relations-{uuid.uuid4().hex}"
    sinks.write_relations(_rel(s, d).select("note_id", "hadm_id", "relation_type", "model_confidence", "cui_1", "cui_2"), path)
    return s.read.parquet(path)


@query
def tracks_sink(s, d):
    """Both tracks written apart and read as one table."""
    path = f"{shared_dir(s)}/tracks-{uuid.uuid4().hex}"
    both = sinks.write_tracks({"ade": graph.ade_track(_rel(s, d)), "treatment": graph.treatment_track(_rel(s, d)).drop("target_semantic_valid")}, path)
    return both.select("track", "note_id", "hadm_id", "relation_type", "model_confidence", "cui_1", "cui_2", "target_semantic_valid")


@query
def edges_sink(s, d):
    """Edges as CSV, their lists as JSON text."""
    path = f"{shared_dir(s)}/edges-{uuid.uuid4().hex}"
    sinks.write_csv(_edges(s, d).select("hadm_id", "source_cui", "target_cui", "relation", "note_occurrences", "sections_found"), path)
    back = readers.read(s, "csv", path=path, schema="hadm_id bigint, source_cui string, target_cui string, relation string, note_occurrences string, sections_found string")
    texts = "array<string>"
    return back.withColumns({c: F.array_join(F.from_json(c, texts), "|") for c in ("note_occurrences", "sections_found")})


@query
def admission_exports(s, d):
    """Sentences exported by admission and read back."""
    path = f"{shared_dir(s)}/exports-{uuid.uuid4().hex}"
    out = sinks.export_admissions(_sent(s, d).select("hadm_id", "note_id", "section_ord", "sentence_index", "sentence_text"), path, "sentences")
    return s.read.options(header=True, multiLine=True, quote='"', escape='"').csv(out).select(F.col("hadm_id").cast("bigint").alias("hadm_id"), "note_id", F.col("sentence_index").cast("bigint").alias("sentence_index"), "sentence_text")


@query
def notes_stream(s, d):
    """Notes as a stream of JSON lines through the segmenter, all that has arrived; read from its output."""
    path = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    _notes(s, d).write.json(f"{path}/in")
    stream.process_notes(s, f"{path}/in", f"{path}/out", f"{path}/state", notes.segment_sections).awaitTermination()
    return s.read.parquet(f"{path}/out").drop("batch_id")


@query
def p3_found(s, d):
    done = units.convert(table(s, d, "measurements"), table(s, d, "quantity_ref"))
    return done.select("meas_id", "dim_no", F.floor(F.col("value") * 1000 + 0.5).cast("long").alias("milli_value"))


@query
def p3_converted(s, d):
    return units.convert(table(s, d, "measurements"), table(s, d, "quantity_ref"))


@query
def p3_spellings(s, d):
    return units.spelling_check(table(s, d, "measurements"), table(s, d, "quantity_ref"))


@query
def p3_unconverted(s, d):
    return units.unconverted(table(s, d, "measurements"), table(s, d, "quantity_ref"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
