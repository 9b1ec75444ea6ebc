"""Spans, relations, concepts and graphs: literal cases and properties."""

from chartloom import schemas
from chartloom.operators import entities, graph, ontology, radiology, relations


def ents(spark, *rows):
    """rows: note, sentence, group, word, start, end, score, source"""
    return spark.createDataFrame([(n, 1, s, g, w, a, b, p, m) for n, s, g, w, a, b, p, m in rows], schemas.ENTITIES)


def test_iou_uses_the_hull(spark):
    df = spark.createDataFrame([(0, 10, 5, 15), (3, 3, 3, 3), (0, 2, 5, 9)], "a int, b int, c int, d int")
    got = [r.x for r in df.select(entities.span_iou(df.a, df.b, df.c, df.d).alias("x")).collect()]
    assert got == [5 / 15, 0.0, 0.0]


def test_threshold_is_strict(spark):
    e = ents(spark, ("n", 0, "problem", "abcde", 0, 10, 0.5, "x"), ("n", 0, "problem", "abc", 0, 4, 0.5, "x"), ("n", 0, "problem", "abcd", 0, 5, 0.5, "x"))
    assert sorted(r.end_ for r in entities.merge_entities(e).collect()) == [4, 10]


def test_no_two_kept_spans_clash(spark):
    import random

    r = random.Random(5)
    rows = [("n%d" % (k % 7), k % 3, r.choice(["DRUG", "problem", "x"]), "w%d" % r.randrange(9), a := r.randrange(40), a + r.randrange(1, 12), r.random(), r.choice(["Med7", "ClinicalBERT"])) for k in range(400)]
    kept = entities.merge_entities(ents(spark, *rows)).collect()
    by = {}
    for k in kept:
        by.setdefault((k.note_id, k.sentence_index), []).append(k)
    med = lambda k: k.entity_group == "DRUG" or k.source_model == "Med7"
    for group in by.values():
        for i, a in enumerate(group):
            for b in group[:i]:
                met = max(0, min(a.end_, b.end_) - max(a.start, b.start)) / (max(a.end_, b.end_) - min(a.start, b.start))
                assert met <= (0.6 if med(a) and med(b) else 0.4)


def test_polish(spark):
    e = ents(spark, ("n", 0, "treatment", " Sepsis ", 0, 5, 1.0, "x"), ("n", 0, "STRENGTH", "10 mg", 6, 9, 1.0, "x"), ("n", 1, "DRUG", "Aspirin", 0, 5, 1.0, "x"), ("n", 1, "strength", "5 mg", 6, 9, 1.0, "x"), ("n", 1, "problem", "the", 0, 3, 1.0, "x"), ("n", 1, "LABEL_1", "foo", 0, 3, 1.0, "x"), ("n", 1, "problem", "##itis", 0, 3, 1.0, "x"))
    assert {(r.word, r.entity_group) for r in entities.polish_entities(e).collect()} == {("sepsis", "problem"), ("aspirin", "DRUG"), ("5 mg", "strength")}


def test_null_columns_do_not_crash(spark):
    e = spark.createDataFrame([(None, None, None, None, None, None, None, None, None), ("n", None, 0, None, "w", 1, 2, None, None)], schemas.ENTITIES)
    assert entities.merge_entities(e).count() == 2
    entities.polish_entities(e).count()
    entities.dedupe_entities(e, ["note_id"]).count()


def test_pairs_and_fallback(spark):
    e = ents(spark, ("n", 0, "DRUG", "aspirin", 0, 5, 1.0, "Med7"), ("n", 3, "problem", "rash", 9, 12, 1.0, "x"), ("n", 0, "problem", "rash", 9, 12, 1.0, "x"))
    s = spark.createDataFrame([("n", 1, 0, "PMH", 0, "given"), ("n", 1, 1, "HPI", 0, "rash due to aspirin"), ("n", 1, 0, "PMH", 3, "x")], schemas.SENTENCES)
    assert relations.cooccurrence_pairs(e, s, ["DRUG", "problem"], 1).first()["section_name"] == "HPI"  # the last section wins
    got = relations.relaxed_fallback(e, s).collect()
    assert [(r["pass"], r.relation_type, r.model_confidence) for r in got] == [("strict", "CAUSES", 0.68)]
    assert relations.extract_relations(e, s, relations.BATCH).count() == 0  # the strict section's threshold


def test_linking_prefers_valid_types(spark):
    kb = spark.createDataFrame([("lung", "A", "Lung", "Anatomical Structure", 0.99), ("lung", "B", "Lung disease", "Disease or Syndrome", 0.8)], schemas.CONCEPTS)
    m = spark.createDataFrame([("Lung", "problem", "TREATS"), ("x", "problem", "TREATS"), (None, "problem", "TREATS")], "word string, entity_group string, relation_type string")
    got = {r.word: r.cui for r in ontology.link_concepts(m, kb, "target").collect()}
    assert got == {"Lung": "B", "x": "UNMAPPED", None: "UNMAPPED"}


def test_linking_tries_aliases_of_any_length(spark):
    copd = "acute exacerbation of chronic obstructive pulmonary disease"
    kb = spark.createDataFrame([(copd, "A", "AECOPD", "Disease or Syndrome", 0.99), ("pulmonary disease", "B", "Lung disease", "Disease or Syndrome", 0.8)], schemas.CONCEPTS)
    m = spark.createDataFrame([(copd.title(), "problem", "TREATS"), (f"severe {copd} today", "problem", "TREATS"), ("pulmonary disease", "problem", "TREATS")], "word string, entity_group string, relation_type string")
    got = {r.word: r.cui for r in ontology.link_concepts(m, kb, "target").collect()}
    assert got == {copd.title(): "A", f"severe {copd} today": "A", "pulmonary disease": "B"}
    assert {r.cui for r in ontology.link_concepts(m, kb.limit(0), "target").collect()} == {"UNMAPPED"}


def edge(spark, base, notes, sections):
    row = [(1, "A", "a", "A", "a", "TREATS", notes, sections, len(notes), base)]
    return spark.createDataFrame(row, schemas.EDGES.rsplit(",", 1)[0])


def test_alignment(spark):
    assert graph.alignment_score(edge(spark, 0.98, ["1", "2", "3"], ["x", "y"])).first()["alignment_score"] == 1.0
    assert round(graph.alignment_score(edge(spark, 0.70, ["1", "2"], ["x", "y"])).first()["alignment_score"], 9) == 0.80


def test_boosts_of_notes_add_up_exactly(spark):
    for n, want in ((2, 0.05), (3, 0.1), (4, 0.15), (7, 0.3), (8, 0.35)):
        assert graph.alignment_score(edge(spark, 0.0, [str(k) for k in range(n)], ["x"])).first()["alignment_score"] == want


def test_loop_counts_twice(spark):
    assert graph.node_centrality(edge(spark, 0.7, ["1"], ["x"])).first()["centrality"] == 2


def test_empty_relations(spark):
    r = spark.createDataFrame([], schemas.RELATIONS)
    assert graph.longitudinal_edges(r).count() == 0
    assert ontology.mapping_coverage(r).first()["coverage"] == 0.0


def edge_mentions(spark, *confidences):
    """Edges 0, 1 and so on from lists of confidences, each value in a note of its own."""
    rows = [("%d" % i, k, "HPI", "TREATS", x, "A", "a", "B", "b", True) for k, values in enumerate(confidences) for i, x in enumerate(values)]
    return graph.longitudinal_edges(spark.createDataFrame(rows, schemas.RELATIONS))


def test_scores_do_not_depend_on_the_order_of_mentions(spark):
    from itertools import permutations

    edges = edge_mentions(spark, *permutations([0.87, 0.6599999999999999, 0.9, 0.84]))
    assert {r.base_confidence for r in edges.collect()} == {0.8175}
    links = graph.graph_rows(graph.alignment_score(edges)).where("part = 'edge'")
    assert [r.alignment_score for r in links.collect()] == [0.968] * 24


def test_mean_confidence_is_that_of_known_values(spark):
    import math

    nan, inf = float("nan"), float("inf")
    edges = edge_mentions(spark, [0.8, None, 0.6], [None, None], [0.8, nan], [0.8, inf], [1e9, 1.0], [1e-9, 3e-9])
    got = {r.hadm_id: (r.mention_count, r.base_confidence) for r in edges.collect()}
    assert got[0] == (3, 0.7) and got[1] == (2, None) and got[3] == (2, inf) and got[4] == (2, 500000000.5) and got[5] == (2, 2e-9)
    assert math.isnan(got[2][1])


def test_severity_last_entity_wins(spark):
    e = ents(spark, ("n", 0, "problem", "mass", 0, 4, 1.0, "x"), ("n", 1, "problem", "mass", 0, 4, 1.0, "x"))
    s = spark.createDataFrame([("n", 1, 0, "Findings", 0, "no evidence of mass"), ("n", 1, 0, "Findings", 1, "a mass")], schemas.SENTENCES)
    assert radiology.severity_map(e, s).first()["severity"] == "abnormal"


def test_pairs_by_buckets_equal_all_pairs(spark):
    import random

    r = random.Random(2)
    rows = [("n%d" % r.randrange(3), r.randrange(30), r.choice(["DRUG", "problem", "test"]), "w%d" % k, a := r.randrange(50), a + 3, 1.0, "x") for k in range(150)]
    s = spark.createDataFrame([], schemas.SENTENCES)
    for window in (0, 1, 4):
        got = {(x.note_id, x.word_1, x.word_2) for x in relations.candidate_pairs(ents(spark, *rows), s, ["DRUG", "problem", "test"], window).collect()}
        act = lambda g: g == "DRUG"
        want = {(a[0], a[3], b[3]) for a in rows for b in rows if a[0] == b[0] and a[4] < b[4] and abs(a[1] - b[1]) <= window and act(a[2]) != act(b[2])}
        assert got == want


def test_severity_lower_case_key_comes_first(spark):
    pairs = spark.createDataFrame([("n", 1, 0, "Mass", "problem", "Edema", "problem", "CAUSED_BY", 0.75)], "note_id string, hadm_id bigint, sentence_index bigint, entity_1 string, entity_type_1 string, entity_2 string, entity_type_2 string, relation_type string, confidence double")
    sev = spark.createDataFrame([("n", "Mass", "uncertain"), ("n", "mass", "abnormal"), ("n", "Edema", "normal")], "note_id string, word string, severity string")
    who = spark.createDataFrame([("n", 9)], "note_id string, subject_id bigint")
    row = radiology.radiology_edges(pairs, sev, who).first()
    assert (row.source_severity, row.target_severity, row.subject_id) == ("abnormal", "normal", 9)


def test_node_name_is_that_of_its_first_edge(spark):
    rows = [(1, "B", "late", "C", "c", "TREATS", ["1"], ["x"], 1, 0.7), (1, "A", "a", "B", "early", "TREATS", ["1"], ["x"], 1, 0.7)]
    got = {r.cui: r.name for r in graph.node_centrality(spark.createDataFrame(rows, schemas.EDGES.rsplit(",", 1)[0])).collect()}
    assert got == {"A": "a", "B": "early", "C": "c"}


def test_misspelt_mentions_find_concepts(spark):
    kb = spark.createDataFrame([("pneumonia", "P", "Pneumonia", "Disease or Syndrome", 0.97), ("sepsis", "S", "Sepsis", "Disease or Syndrome", 0.9)], schemas.CONCEPTS)
    m = spark.createDataFrame([("pneumonias", "problem", "TREATS"), ("sepsis", "problem", "TREATS"), ("zzz", "problem", "TREATS"), (None, "problem", "TREATS")], "word string, entity_group string, relation_type string")
    got = {r.word: r.cui for r in ontology.link_concepts(m, ontology.with_resembling(kb, m), "target").collect()}
    assert got == {"pneumonias": "P", "sepsis": "S", "zzz": "UNMAPPED", None: "UNMAPPED"}


def test_extra_columns_with_clashing_names_stay(spark):
    from pyspark.sql import functions as F

    from chartloom.functions import models
    from chartloom.operators import notes

    odd = {c: F.lit("mine") for c in ("label", "n", "has_drug", "tag", "is_stop", "single", "bucket", "spans", "prio", "med", "m", "salt")}
    e = ents(spark, ("n", 0, "DRUG", "aspirin", 0, 5, 1.0, "Med7"), ("n", 0, "problem", "rash", 9, 12, 1.0, "x"), ("n", 0, "problem", "sepsis", 14, 19, 1.0, "x")).withColumns(odd)
    s = spark.createDataFrame([("n", 1, 0, "HPI", 0, "rash due to aspirin")], schemas.SENTENCES).withColumns(odd)
    models.register("verbs", lambda: lambda words: [("VERB" if w == "sepsis" else "NOUN", False) for w in words])
    polished = entities.polish_entities(e, models.word_tags(e, "verbs"))
    assert {(r.word, r.label, r.n, r.tag) for r in polished.collect()} == {("aspirin", "mine", "mine", "mine"), ("rash", "mine", "mine", "mine")}
    assert entities.merge_entities(e).count() == 3 and entities.dedupe_entities(e, ["note_id"]).first()["n"] == "mine"
    assert relations.relaxed_fallback(e, s).count() == 2
    assert radiology.radiology_edges(radiology.finding_pairs(e, s), radiology.severity_map(e, s)).count() == 3
    assert entities.verify_drugs(e, spark.createDataFrame([(1, "Aspirin EC")], schemas.PRESCRIPTIONS).withColumns(odd), "DRUG").first()["status"] == "Verified"
    d = spark.createDataFrame([(1, 1, 1, "4019", "9")], schemas.DIAGNOSES).withColumns({"icd9_code": F.lit("x"), "icd10_code": F.lit("y"), "at": F.lit(1)})
    assert notes.icd_map(d, spark.createDataFrame([("4019", "I10")], schemas.CROSSWALK)).first()["icd_code"] == "I10"


def test_new_operators_on_empty_tables(spark):
    e, s = spark.createDataFrame([], schemas.ENTITIES), spark.createDataFrame([], schemas.SENTENCES)
    edges = radiology.radiology_edges(radiology.finding_pairs(e, s), radiology.severity_map(e, s))
    assert radiology.packed_graph(radiology.radiology_graph(e, edges)).count() == 0
    g = spark.createDataFrame([], schemas.EDGES)
    assert graph.graph_rows(g).count() == graph.edge_visuals(g).count() == graph.graph_visuals(graph.node_centrality(g)).count() == 0
    assert relations.relation_counts(spark.createDataFrame([], schemas.RELATIONS)).first()["relations"] == 0
    kb = spark.createDataFrame([], schemas.CONCEPTS)
    assert ontology.resembling_aliases(spark.createDataFrame([("a",), (None,)], "word string"), kb).count() == 0
