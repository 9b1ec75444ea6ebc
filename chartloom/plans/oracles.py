"""DuckDB SQL for the queries of the core, written apart from the Spark code."""

from __future__ import annotations

from chartloom.plans.fixtures import DIAG, ENT, GEM, KB, NOTES, REL, RX, SENT, cte

# The word lists, patterns and numbers in the SQL below are those of the operators, written out once more.
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sub(x: str, *rules: tuple[str, str], flags: str = "g") -> str:
    for pattern, to in rules:
        x = f"regexp_replace({x}, {_q(pattern)}, {_q(to)}, '{flags}')"
    return x


def _clean(x: str) -> str:
    x = _sub(f"coalesce({x}, '')", ("_{3,}", " "), (r"\[\*\*.*?\*\*\]", " "))
    short = [("HTN", "hypertension"), ("DM2", "type 2 diabetes mellitus"), ("CHF", "congestive heart failure"), ("pt", "patient"), ("dx", "diagnosis"), ("hx", "history"), ("s/p", "status post"), ("c/o", "complains of"), ("prn", "as needed"), ("BID", "twice a day"), ("TID", "three times a day"), ("QID", "four times a day"), ("sob", "shortness of breath")]
    x = _sub(x, *[(rf"\b{a}\b", b) for a, b in short], flags="gi")
    x = _sub(x, (r"([A-Za-z]+)\:\s*(\d+\.?\d*)\s*([a-zA-Z/%]+)", r"LABTEST \1: \2 \3"), (r"\[DEID\]", " "), (r"[ \t]+", " "))
    return _STRIP.format(x)


def _legacy(x: str) -> str:
    return _STRIP.format(_sub(f"coalesce({x}, '')", (r"\[\*\*.*?\*\*\]", "[PHI]"), ("_{3,}", " "), ("-{4,}", " "), (r"\*{3,}", " "), (r"\n{3,}", "\n\n"), (" {2,}", " ")))


_NORMAL = r"no\s+evidence\s+of|negative\s+for|rule\s+out|excluded|normal|unremarkable"
_ABNORMAL = "abnormal|abnormality|finding|lesion|mass|collection|thickening|enhancement|narrowing|stenosis|occlusion|fracture|dislocation|rupture|infarction|hemorrhage"


def _severity(x: str) -> str:
    return f"CASE WHEN regexp_matches(lower({x}), {_q(_NORMAL)}) THEN 'normal' WHEN regexp_matches(lower({x}), {_q(_ABNORMAL)}) THEN 'abnormal' ELSE 'uncertain' END"


_CAUSES = r"\bcaused\b|\bdue to\b|\bsecondary to\b|\badverse\b|\bside effect\b|\binduced\b|\bcomplication\b"
_TREATS = r"\btreated with\b|\bstarted on\b|\bgiven\b|\bprescribed\b|\bfor\b|\bimproved on\b|\bresponded to\b"


def _keyword(x: str) -> tuple[str, str]:
    c, t = f"regexp_matches(lower({x}), {_q(_CAUSES)})", f"regexp_matches(lower({x}), {_q(_TREATS)})"
    return f"CASE WHEN {c} THEN 'CAUSES' WHEN {t} THEN 'TREATS' ELSE 'UNRELATED' END", f"CASE WHEN {c} THEN CAST(0.68 AS DOUBLE) WHEN {t} THEN CAST(0.66 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END"


def _finding(x: str) -> str:
    x = f"lower(coalesce({x}, ''))"
    return (
        f"CASE WHEN regexp_matches({x}, 'caused by|due to|secondary to|resulting in|leading to') THEN 'CAUSED_BY' WHEN regexp_matches({x}, 'associated with|compatible with|in keeping with|consistent with') THEN 'CORRELATED_WITH' "
        f"WHEN regexp_matches({x}, 'no evidence of|negative for|without evidence of') THEN 'CONTRASTED_WITH' END"
    )


def _hits(source: str, key: str, text: str, pattern: str, groups: int) -> str:
    """key, i, start, end_, full, g1.. of all matches."""
    p = _q("(?i)" + pattern)
    g = "".join(f", nullif(g{k}[i + 1], '') AS g{k}" for k in range(1, groups + 1))
    gs = "".join(f", regexp_extract_all({text}, {p}, {k}) AS g{k}" for k in range(1, groups + 1))
    return f"""(SELECT {key}, i, CAST(st AS INTEGER) AS start, CAST(st + length(full_) AS INTEGER) AS end_, full_ {g} FROM (
      SELECT *, x[i + 1] AS full_, coalesce(list_sum(list_transform(gaps[1:i + 1], lambda v: length(v))), 0) + coalesce(list_sum(list_transform(x[1:i], lambda v: length(v))), 0) AS st FROM (
        SELECT *, unnest(range(0, len(x))) AS i FROM (
          SELECT {key}, regexp_split_to_array({text}, {p}) AS gaps, regexp_extract_all({text}, {p}, 0) AS x {gs} FROM {source} WHERE {text} IS NOT NULL))))"""


def _measurement_rows() -> str:
    a = _hits("n", "note_id", "text", r"(\d+\.?\d*)\s*x\s*(\d+\.?\d*)\s*(?:x\s*(\d+\.?\d*))?\s*(cm|mm|inches?)", 4)
    b = _hits("n", "note_id", "text", r"(\d+\.?\d*)\s*(cm|mm|inches?)\s*(?:in\s+)?(?:diameter|size)", 2)
    return f"""SELECT note_id, 1 AS form, full_ AS measurement, g1 AS dim_1, g2 AS dim_2, g3 AS dim_3, coalesce(g4, 'cm') AS unit, start, end_ FROM {a}
      UNION ALL SELECT note_id, 2, full_, g1, NULL, NULL, coalesce(g2, 'cm'), start, end_ FROM {b}"""


def _negation_rows() -> str:
    parts = [f"SELECT note_id, {k} AS pattern_no, 'normal_finding' AS negation_type, {_STRIP.format('coalesce(g1, $$$$)')} AS finding, full_ AS full_text, start, end_ FROM {_hits('n', 'note_id', 'text', p + r'\s+([a-zA-Z\s]+?)(?:[,.]|$)', 1)}" for k, p in enumerate(_NORMAL.split("|"))]
    return " UNION ALL ".join(parts)


_HEAD = [
    ("discharge", "Chief Complaint", "chief complaint|c/c"), ("discharge", "HPI", "history of present illness|hpi"), ("discharge", "PMH", "past medical history|pmh"),
    ("discharge", "Medications", "discharge medications|medications on admission"), ("discharge", "Assessment/Plan", "assessment and plan|a/p"), ("discharge", "Discharge Dx", "discharge diagnos(is|es)"),
    ("discharge", "Hospital Course", "brief hospital course|hospital course"), ("radiology", "Indication", "indication|reason for exam"), ("radiology", "Findings", "findings"), ("radiology", "Impression", "impression|conclusions"),
]
_HEADER = "CASE " + " ".join(f"WHEN note_type = '{t}' AND regexp_matches({_STRIP.format('line')}, '(?i)^({p})') THEN '{s}'" for t, s, p in _HEAD) + " END"
_SEGMENTS = f"""l AS (SELECT note_id, note_type, pos, lines[pos] AS line FROM (SELECT note_id, note_type, lines, unnest(range(1, len(lines) + 1)) AS pos FROM (SELECT note_id, note_type, string_split(text, chr(10)) AS lines FROM n))),
h AS (SELECT *, {_HEADER} AS header FROM l),
w AS (SELECT *, coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY note_id ORDER BY pos), 'full_text') AS section_name, sum(CASE WHEN header IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY note_id ORDER BY pos) AS run FROM h),
b AS (SELECT note_id, section_name, run, {_STRIP.format("string_agg(line, chr(10) ORDER BY pos)")} AS body FROM w WHERE header IS NULL GROUP BY ALL),
g AS (SELECT note_id, section_name, CAST(min(run) AS INTEGER) AS section_ord, arg_max(body, run) AS section_text FROM b GROUP BY ALL HAVING {_STRIP.format("arg_max(body, run)")} <> '')"""

_PRIO = """CASE lower(source_model) WHEN 'med7' THEN 300 WHEN 'clinicalbert' THEN 150 WHEN 'radbert' THEN 100 ELSE 0 END
 + CASE lower(entity_group) WHEN 'drug' THEN 300 WHEN 'medication' THEN 260 WHEN 'route' THEN 220 WHEN 'strength' THEN 210 WHEN 'frequency' THEN 200 WHEN 'dose' THEN 190 WHEN 'dosage' THEN 190 WHEN 'chemical' THEN 120
   WHEN 'treatment' THEN 110 WHEN 'problem' THEN 100 WHEN 'procedure' THEN 90 ELSE 0 END"""
_MED = "(lower(entity_group) IN ('drug', 'medication', 'chemical') OR lower(source_model) = 'med7')"
_POLISH = r"""p1 AS (SELECT *, lower(entity_group) AS lab FROM e WHERE NOT contains(word, '##') AND length(word) > 2),
p2 AS (SELECT * FROM p1 WHERE NOT contains(lab, 'label') AND trim(word) <> '' AND NOT (NOT contains(trim(word), ' ') AND lower(trim(word)) IN ('and', 'by', 'repair'))
  AND NOT (lab IN ('treatment', 'problem') AND NOT contains(trim(word), ' ') AND lower(trim(word)) IN ('a','an','the','all','this','that','these','those','other','some','any','each','every','either','neither'))),
p3 AS (SELECT * REPLACE (CASE WHEN lab = 'treatment' AND regexp_matches(lower(word), 'itis|osis|emia|infection|sepsis|pneumonia|cancer|failure|syndrome|fracture|stroke|hemorrhage|tumor|disease')
  AND NOT regexp_matches(lower(word), 'therapy|treatment|management|surgery|procedure|infusion|medication|dose') THEN 'problem' ELSE entity_group END AS entity_group) FROM p2),
p4 AS (SELECT *, max(CASE WHEN lower(entity_group) = 'drug' THEN 1 ELSE 0 END) OVER (PARTITION BY note_id, sentence_index) AS has_drug FROM p3),
p AS (SELECT note_id, hadm_id, sentence_index, entity_group, lower(trim(word)) AS word, start, end_, score, source_model FROM p4 WHERE lower(entity_group) NOT IN ('strength', 'dosage') OR has_drug = 1)"""

_E = ["sentence_index", "start", "end_", "entity_group", "word", "source_model", "score"]


def _pairs(name: str, types: str, window: int, sections: str | None) -> str:
    acts, sees = "('drug', 'treatment')", "('problem', 'test')"
    cols = ", ".join(f"a.{c} AS {c}_1, b.{c} AS {c}_2" for c in _E)
    keep = f"WHERE section_name IN ({sections})" if sections else ""
    order = ", ".join(f"{c}_{k}" for k in (1, 2) for c in _E)
    return f"""{name} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY note_id, start_1, start_2 ORDER BY {order}) AS rn FROM (
  SELECT x.*, coalesce(l.section_name, 'unknown') AS section_name FROM (
    SELECT a.note_id, a.hadm_id, {cols}, abs(a.sentence_index - b.sentence_index) AS sentence_diff FROM e a JOIN e b ON a.note_id = b.note_id AND a.hadm_id IS NOT DISTINCT FROM b.hadm_id
    WHERE a.entity_group IN ({types}) AND b.entity_group IN ({types}) AND a.start < b.start AND abs(a.sentence_index - b.sentence_index) <= {window}
      AND ((lower(a.entity_group) IN {acts} AND lower(b.entity_group) IN {sees}) OR (lower(a.entity_group) IN {sees} AND lower(b.entity_group) IN {acts}))) x
  LEFT JOIN lastsent l ON l.note_id = x.note_id AND l.sentence_index = x.sentence_index_1) {keep}) WHERE rn = 1)"""


_LAST = "lastsent AS (SELECT note_id, sentence_index, arg_max(section_name, section_ord) AS section_name, arg_max(sentence_text, section_ord) AS sentence_text FROM s GROUP BY ALL)"
_BATCH_S = "'HPI', 'Hospital Course', 'Assessment/Plan', 'Findings', 'Impression'"
_API_S = _BATCH_S + ", 'Medications'"
_API_T = "'DRUG', 'treatment', 'TREATMENT', 'problem', 'PROBLEM'"


def _relations(name: str, pairs: str, drugs: str, problems: str, least: str) -> str:
    rel, score = _keyword("context")
    return f"""{name} AS (SELECT * EXCLUDE (context), 'direct implication' AS evidence_type, CAST(0.55 AS DOUBLE) AS evidence_confidence FROM (SELECT *, {rel} AS relation_type, {score} AS model_confidence FROM (
  SELECT p.*, coalesce(a.sentence_text, '') || CASE WHEN p.sentence_diff = 0 THEN '' ELSE ' ' || coalesce(b.sentence_text, '') END AS context FROM {pairs} p
  LEFT JOIN lastsent a ON a.note_id = p.note_id AND a.sentence_index = p.sentence_index_1 LEFT JOIN lastsent b ON b.note_id = p.note_id AND b.sentence_index = p.sentence_index_2
  WHERE (p.entity_group_1 IN ({drugs}) AND p.entity_group_2 IN ({problems})) OR (p.entity_group_1 IN ({problems}) AND p.entity_group_2 IN ({drugs}))))
  WHERE relation_type IN ('TREATS', 'CAUSES') AND model_confidence >= {least})"""


_API_D, _API_P = "'DRUG', 'treatment', 'TREATMENT'", "'problem', 'PROBLEM'"
_STRICT = f"{_pairs('ps', _API_T, 2, _API_S)}, {_relations('rs', 'ps', _API_D, _API_P, '0.50')}"
_WIDE = f"{_pairs('pw', _API_T, 4, None)}, {_relations('rw', 'pw', _API_D, _API_P, '0.50')}"
_FALLBACK = f"{_LAST}, {_STRICT}, {_WIDE}, fb AS (SELECT *, 'strict' AS pass FROM rs UNION ALL SELECT *, 'relaxed' FROM rw WHERE note_id NOT IN (SELECT note_id FROM rs)), fr AS (SELECT * FROM fb WHERE model_confidence >= 0.60)"


def _link(name: str, mentions: str, role: str) -> str:
    """Linking with the small ontology: aliases are runs of words of the mention."""
    cond = "('Disease or Syndrome', 'Finding', 'Sign or Symptom', 'Injury or Poisoning')"
    pharma = "('Pharmacologic Substance', 'Clinical Drug')"
    target = f"+ CASE WHEN relation_type = 'TREATS' THEN CASE WHEN t_cond THEN 0.15 ELSE -0.25 END WHEN relation_type = 'CAUSES' THEN CASE WHEN t_cond OR t_adv THEN 0.10 ELSE -0.20 END ELSE 0.0 END" if role == "target" else ""
    return f"""{name} AS (SELECT m.word, m.entity_group, m.relation_type, coalesce(w.cui, 'UNMAPPED') AS cui, coalesce(w.canonical_name, 'UNMAPPED') AS canonical_name FROM (SELECT DISTINCT word, entity_group, relation_type FROM {mentions}) m LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word, entity_group, relation_type ORDER BY adj DESC, alias, rank) AS n FROM (
    SELECT *, round(score {target} + CASE WHEN lower(entity_group) IN ('drug', 'medication', 'chemical') THEN CASE WHEN t_pharma THEN 0.05 ELSE -0.10 END ELSE 0.0 END - CASE WHEN t_rej THEN 0.35 ELSE 0.0 END, 9) AS adj FROM (
      SELECT q.word, q.entity_group, q.relation_type, k.* FROM (SELECT DISTINCT word, entity_group, relation_type FROM {mentions}) q JOIN (
        SELECT *, row_number() OVER (PARTITION BY alias ORDER BY score DESC, cui) AS rank FROM (
          SELECT alias, kb.cui, max(score) AS score, min(canonical_name) AS canonical_name, bool_or(y.semantic_type IN {cond}) AS t_cond, bool_or(y.semantic_type = 'Adverse Event') AS t_adv, bool_or(y.semantic_type IN {pharma}) AS t_pharma,
            bool_or(y.semantic_type IN ('Therapeutic or Preventive Procedure')) AS t_ther, bool_or(y.semantic_type IN ('Diagnostic Procedure', 'Laboratory Procedure')) AS t_test, bool_or(y.semantic_type = 'Organic Chemical') AS t_org,
            bool_or(y.semantic_type IN ('Body Part', 'Body Location', 'Anatomical Structure')) AS t_rej
          FROM kb JOIN (SELECT cui, semantic_type FROM kb) y ON y.cui = kb.cui GROUP BY alias, kb.cui)) k
      ON k.rank <= 3 AND contains(' ' || lower(trim(q.word)) || ' ', ' ' || k.alias || ' ')
      WHERE NOT t_rej AND CASE lower(q.entity_group) WHEN 'drug' THEN t_pharma WHEN 'medication' THEN t_pharma WHEN 'chemical' THEN t_pharma OR t_org WHEN 'problem' THEN t_cond WHEN 'test' THEN t_test WHEN 'treatment' THEN t_ther OR t_pharma ELSE true END)))
  WHERE n = 1) w ON w.word = m.word AND w.entity_group = m.entity_group AND w.relation_type = m.relation_type)"""


_VALID = """(SELECT cui AS vc, bool_or(semantic_type IN ('Body Part', 'Body Location', 'Anatomical Structure')) AS rej, bool_or(semantic_type IN ('Disease or Syndrome', 'Finding', 'Sign or Symptom', 'Injury or Poisoning')) AS cond,
  bool_or(semantic_type = 'Adverse Event') AS adv FROM kb GROUP BY cui)"""
_IS_VALID = "CASE WHEN v.vc IS NULL THEN false WHEN v.rej THEN false WHEN relation_type = 'TREATS' THEN v.cond WHEN relation_type = 'CAUSES' THEN v.cond OR v.adv ELSE false END"

_EDGES = """ed AS (SELECT hadm_id, cui_1, cui_2, relation_type, arg_min(struct_pack(a := canonical_name_1, b := canonical_name_2), note_id || chr(1) || section_name || chr(1) || canonical_name_1 || chr(1) || canonical_name_2) AS nm,
  list_sort(list_distinct(list(note_id))) AS notes, list_sort(list_distinct(list(section_name))) AS secs, count(*) AS mention_count, avg(model_confidence) AS base
  FROM r WHERE cui_1 <> 'UNMAPPED' AND cui_2 <> 'UNMAPPED' AND target_semantic_valid AND hadm_id IS NOT NULL GROUP BY ALL HAVING count(*) > 0),
ed2 AS (SELECT hadm_id, cui_1, cui_2, relation_type, any_value(nm) AS nm, any_value(notes) AS notes, any_value(secs) AS secs, sum(mention_count) AS mention_count, any_value(base) AS base FROM ed GROUP BY ALL)"""
_ALIGN = "least(1.0, base + CASE WHEN len(notes) > 1 THEN (len(notes) - 1) * 0.05 ELSE 0 END + CASE WHEN len(secs) > 1 THEN 0.05 ELSE 0 END)"
_EDGES = _EDGES.replace(" GROUP BY ALL HAVING count(*) > 0)", " GROUP BY hadm_id, cui_1, cui_2, relation_type)").split(",\ned2")[0]

_FIRST = "fs AS (SELECT note_id, sentence_index, arg_min(sentence_text, section_ord) AS context FROM s GROUP BY ALL)"
_FPAIRS = f"""o AS (SELECT *, row_number() OVER (PARTITION BY note_id, sentence_index ORDER BY start, end_, entity_group, word, source_model, score) AS ord FROM e),
fp AS (SELECT a.note_id, a.hadm_id, a.sentence_index, a.word AS entity_1, a.entity_group AS entity_type_1, CAST(a.ord AS INTEGER) AS ord_1, b.word AS entity_2, b.entity_group AS entity_type_2, CAST(b.ord AS INTEGER) AS ord_2, {_finding("fs.context")} AS relation_type, CAST(0.75 AS DOUBLE) AS confidence
  FROM o a JOIN o b ON a.note_id = b.note_id AND a.sentence_index = b.sentence_index AND a.ord < b.ord LEFT JOIN fs ON fs.note_id = a.note_id AND fs.sentence_index = a.sentence_index)"""
_SEV = f"""sv AS (SELECT note_id, word, arg_max(sev, struct_pack(a := sentence_index, b := start, c := end_, d := entity_group, f := word, g := source_model, h := score)) AS severity
  FROM (SELECT e.*, {_severity("coalesce(fs.context, '') || ' ' || coalesce(e.word, '')")} AS sev FROM e LEFT JOIN fs ON fs.note_id = e.note_id AND fs.sentence_index = e.sentence_index) GROUP BY note_id, word)"""


_NODES = """en AS (SELECT hadm_id, cui_1 AS cui, nm.a AS name, cui_1 || chr(1) || cui_2 || chr(1) || relation_type || chr(1) || '0' AS ord_ FROM ed UNION ALL SELECT hadm_id, cui_2, nm.b, cui_1 || chr(1) || cui_2 || chr(1) || relation_type || chr(1) || '1' FROM ed),
nd AS (SELECT hadm_id, cui, arg_min(name, ord_) AS name, count(*) AS centrality FROM en GROUP BY 1, 2)"""
_REDGES = """re AS (SELECT hadm_id, fp.note_id AS source_note, lower(trim(entity_1)) AS entity_1, lower(trim(entity_2)) AS entity_2, relation_type, confidence AS model_confidence, entity_type_1 AS source_type, entity_type_2 AS target_type,
 coalesce(a.severity, c.severity) AS source_severity, coalesce(b.severity, d.severity) AS target_severity, round(0.6 + 0.35 * confidence, 4) AS alignment_score FROM fp
 LEFT JOIN sv a ON a.note_id = fp.note_id AND a.word = lower(trim(entity_1)) LEFT JOIN sv c ON c.note_id = fp.note_id AND c.word = trim(entity_1)
 LEFT JOIN sv b ON b.note_id = fp.note_id AND b.word = lower(trim(entity_2)) LEFT JOIN sv d ON d.note_id = fp.note_id AND d.word = trim(entity_2) WHERE relation_type IS NOT NULL AND confidence >= 0.5)"""
_RGRAPH = """rg AS (SELECT DISTINCT hadm_id, 'node' AS part, lower(trim(word)) AS source, NULL AS target, NULL AS relation_type, CAST(NULL AS DOUBLE) AS confidence FROM e WHERE trim(word) <> ''
 UNION ALL SELECT DISTINCT hadm_id, 'edge', entity_1, entity_2, relation_type, model_confidence FROM re)"""
_LEX = [("lisinopril|aspirin|heparin", "DRUG", "Med7"), ("pneumonia|sepsis|congestive heart failure|hypertension|infection|fracture|mass", "problem", "ClinicalBERT")]
_LEX_SCORE = "CASE lower(full_) WHEN 'pneumonia' THEN 0.9 WHEN 'sepsis' THEN 0.9 WHEN 'congestive heart failure' THEN 0.9 WHEN 'hypertension' THEN 0.85 WHEN 'infection' THEN 0.8 WHEN 'fracture' THEN 0.8 WHEN 'mass' THEN 0.7 ELSE 1.0 END"


def _lexicon(source: str, key: str, text: str) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{label}' AS entity_group, full_ AS word, CAST(start AS BIGINT) AS start, CAST(end_ AS BIGINT) AS end_, CAST({_LEX_SCORE} AS DOUBLE) AS score, '{model}' AS source_model FROM {_hits(source, key, text, chr(92) + 'b(?:' + words + ')' + chr(92) + 'b', 0)}" for words, label, model in _LEX)


def _rash(pattern: str, label: str, model: str, text: str = "sentence_text") -> str:
    return f"SELECT note_id, hadm_id, sentence_index, '{label}' AS entity_group, full_ AS word, CAST(start AS BIGINT) AS start, CAST(end_ AS BIGINT) AS end_, CAST(0.75 AS DOUBLE) AS score, '{model}' AS source_model FROM {_hits('q', 'note_id, hadm_id, sentence_index', text, pattern, 0)}"


def oracle_sql() -> dict[str, str]:
    rel, score = _keyword("text")
    out = {
        "scan_multi_note": cte(n=NOTES) + "SELECT subject_id, hadm_id, note_id, text FROM n WHERE hadm_id IS NOT NULL AND subject_id IN (SELECT subject_id FROM n WHERE hadm_id IS NOT NULL GROUP BY subject_id HAVING count(note_id) > 1 ORDER BY subject_id LIMIT 200) ORDER BY note_id, hadm_id, subject_id LIMIT 1000",
        "scan_diagnoses": cte(d=DIAG) + "SELECT hadm_id, seq_num, icd_code, icd_version, subject_id FROM d WHERE hadm_id IS NOT NULL ORDER BY ALL LIMIT 5000",
        "single_note": cte(n=NOTES) + "SELECT note_id, text FROM n WHERE text IS NOT NULL ORDER BY note_id, text LIMIT 1",
        "distinct_prescriptions": cte(x=RX) + "SELECT DISTINCT hadm_id, drug FROM x WHERE drug IS NOT NULL",
        "constant_query": "SELECT 1 AS test",
        "clean_text": cte(n=NOTES) + f"SELECT note_id, {_clean('text')} AS clean_text FROM n",
        "legacy_clean": f"SELECT doc_id, {_legacy('text')} AS cleaned_text FROM documents",
        "legacy_abbrev": cte(n=NOTES) + "SELECT note_id, " + _sub("text", *[(rf"\b{a}\b", b) for a, b in [("htn", "hypertension"), ("dm", "diabetes mellitus"), ("t2dm", "type 2 diabetes mellitus"), ("id-t2dm", "insulin-dependent type 2 diabetes mellitus"), ("bph", "benign prostatic hyperplasia"), ("lfts", "liver function tests"), ("rcc", "renal cell carcinoma"), ("n/v", "nausea vomiting"), ("abd", "abdominal")]], flags="gi") + " AS expanded FROM n",
        "expand_second": cte(n=NOTES) + "SELECT note_id, " + _sub("text || ' ivf and CT'", *[(rf"\b{a}\b", b) for a, b in [("HTN", "hypertension"), ("DM2", "type 2 diabetes mellitus"), ("CHF", "congestive heart failure"), ("pt", "patient"), ("dx", "diagnosis"), ("hx", "history"), ("s/p", "status post"), ("c/o", "complains of"), ("prn", "as needed"), ("BID", "twice a day"), ("TID", "three times a day"), ("QID", "four times a day"), ("sob", "shortness of breath"), ("ivf", "intravenous fluids"), ("ct", "computed tomography")]], flags="gi") + " AS expanded FROM n",
        "strip_dosage": cte(n=NOTES) + "SELECT note_id, " + _STRIP.format(_sub(_sub("text || ' 50 mg 2ml 3 units'", (r"\b\d+(\.\d+)?\s?(mg|ml|mcg|g|units?)\b", ""), flags="gi"), (r"\s+", " "))) + " AS stripped FROM n",
        "normalize_drug": cte(x=RX) + "SELECT drug, CASE lower(trim(drug)) WHEN 'ativan' THEN 'lorazepam' WHEN 'tylenol' THEN 'acetaminophen' WHEN 'paracetamol' THEN 'acetaminophen' ELSE lower(trim(drug)) END AS normalized, count(*) AS n FROM x GROUP BY ALL",
        "drug_noise": cte(e=ENT) + "SELECT word, lower(trim(word)) IN ('pt','nad','ctab','q8h','qhs','u-100','greasy','fen','hsq','pcp','sodium') OR length(trim(word)) < 4 OR contains(word, '/') AS noise, count(*) AS n FROM e GROUP BY ALL",
        "ocr_normalize": cte(n=NOTES) + "SELECT note_id, " + _STRIP.format(_sub("text", (r"\s*[-‐‑‒–—]\s*", " - "), (r"[ \t]+", " "))) + " AS text FROM n",
        "note_track": cte(n=NOTES) + "SELECT note_type, CASE WHEN note_type IN ('RR', 'radiology', 'Radiology Report') THEN 'radiology' ELSE 'discharge' END AS track, count(*) AS n FROM n GROUP BY ALL",
        "severity": cte(n=NOTES) + f"SELECT note_id, {_severity('text')} AS severity FROM n",
        "keyword_relation": cte(n=NOTES) + f"SELECT note_id, {rel} AS relation, {score} AS score FROM n",
        "finding_cue": cte(n=NOTES) + f"SELECT note_id, {_finding('text')} AS relation_type FROM n",
        "measurements": cte(n=NOTES) + _measurement_rows(),
        "negations": cte(n=NOTES) + _negation_rows(),
        "segment_sections": cte(n=NOTES)[:-1] + ", " + _SEGMENTS + " SELECT note_id, section_name, section_ord, section_text FROM g",
        "split_sentences": r"""WITH d AS (SELECT DISTINCT section_id, section_text FROM sections WHERE section_text IS NOT NULL), p AS (SELECT section_id, string_split(regexp_replace(section_text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS x FROM d),
q AS (SELECT section_id, i, x[i + 1] AS t FROM (SELECT section_id, x, unnest(range(0, len(x))) AS i FROM p)) SELECT section_id, CAST(i AS INTEGER) AS sentence_index, """ + r"regexp_replace(t, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS sentence_text FROM q WHERE length(regexp_replace(t, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) > 2",
        "melt_sections": cte(n=NOTES) + "SELECT note_id, 'Indication' AS section_name, note_type AS section_text FROM n WHERE trim(note_type) <> '' UNION ALL SELECT note_id, 'Findings', text FROM n WHERE trim(text) <> ''",
        "track_split": cte(s=SENT) + "SELECT section_name, CASE WHEN coalesce(section_name IN ('Indication', 'Findings', 'Impression'), false) THEN 'radiology' ELSE 'discharge' END AS track, count(*) AS n FROM s GROUP BY ALL",
        "icd_map": cte(d=DIAG, g=GEM) + """SELECT subject_id, hadm_id, seq_num, CASE WHEN icd_version = '9' THEN coalesce(icd10_code, trim(icd_code)) ELSE icd_code END AS icd_code, CASE WHEN icd_version = '9' AND icd10_code IS NOT NULL THEN '10' ELSE icd_version END AS icd_version,
 CASE icd_version WHEN '10' THEN false WHEN '9' THEN icd10_code IS NULL ELSE true END AS is_unmapped FROM d LEFT JOIN g ON icd_version = '9' AND trim(icd_code) = icd9_code""",
        "span_iou": cte(e=ENT) + """SELECT a.note_id, a.sentence_index, a.start AS start_1, a.end_ AS end_1, b.start AS start_2, b.end_ AS end_2, round(greatest(0, least(a.end_, b.end_) - greatest(a.start, b.start)) / (greatest(a.end_, b.end_) - least(a.start, b.start)), 6) AS iou
 FROM e a JOIN e b ON a.note_id = b.note_id AND a.sentence_index = b.sentence_index AND (a.start < b.start OR (a.start = b.start AND a.end_ < b.end_))""",
        "entity_priority": cte(e=ENT) + f"SELECT source_model, entity_group, {_PRIO} AS priority, {_MED} AS medication, count(*) AS n FROM e GROUP BY ALL",
        "merge_entities": cte(e=ENT) + f""", k AS (SELECT note_id, sentence_index, list(struct_pack(k1 := -prio, k2 := start - end_, k3 := -score, k4 := -length(word), start := start, end_ := end_, entity_group := entity_group, word := word, source_model := source_model, score := score, med := med, hadm_id := hadm_id)
   ORDER BY -prio, start - end_, -score, -length(word), start, end_, entity_group, word, source_model, score) AS arr FROM (SELECT *, {_PRIO} AS prio, {_MED} AS med FROM e) GROUP BY ALL),
 m AS (SELECT note_id, sentence_index, list_reduce(list_transform(arr, lambda x: [x]), lambda acc, y: CASE WHEN len(list_filter(acc, lambda a: greatest(0, least(a.end_, y[1].end_) - greatest(a.start, y[1].start)) / (greatest(a.end_, y[1].end_) - least(a.start, y[1].start)) > CASE WHEN a.med AND y[1].med THEN 0.6 ELSE 0.4 END)) > 0 THEN acc ELSE list_concat(acc, y) END) AS kept FROM k)
 SELECT note_id, x.hadm_id AS hadm_id, sentence_index, x.entity_group AS entity_group, x.word AS word, x.start AS start, x.end_ AS end_, x.score AS score, x.source_model AS source_model, x.entity_group AS entity_type, CAST(i AS INTEGER) AS accepted_no FROM (SELECT note_id, sentence_index, i, kept[i + 1] AS x FROM (SELECT *, unnest(range(0, len(kept))) AS i FROM m))""",
        "drop_unlinked_units": cte(e=ENT) + "SELECT note_id, hadm_id, sentence_index, entity_group, word, start, end_, score, source_model FROM e WHERE lower(entity_group) NOT IN ('strength', 'dosage') OR (note_id, sentence_index) IN (SELECT (note_id, sentence_index) FROM e WHERE lower(entity_group) = 'drug')",
        "polish_entities": cte(e=ENT)[:-1] + ", " + _POLISH + " SELECT * FROM p",
        "dedupe_entities": cte(e=ENT) + "SELECT note_id, hadm_id, sentence_index, entity_group, word, start, end_, score, source_model FROM (SELECT *, row_number() OVER (PARTITION BY note_id, lower(word), entity_group ORDER BY start, end_, entity_group, word, source_model, score, sentence_index) AS n FROM e) WHERE n = 1",
        "verify_drugs": cte(e=ENT, x=RX) + """, d AS (SELECT DISTINCT hadm_id, trim(word) AS drug FROM e WHERE entity_group = 'DRUG' AND NOT (length(trim(word)) < 4 OR contains(word, '/'))),
 p AS (SELECT DISTINCT hadm_id, lower(trim(drug)) AS g FROM x WHERE drug IS NOT NULL) SELECT d.hadm_id, d.drug, lower(d.drug) AS normalized, CASE WHEN coalesce(bool_or(contains(p.g, lower(d.drug)) OR contains(lower(d.drug), p.g)), false) THEN 'Verified' ELSE 'Unverified' END AS status
 FROM d LEFT JOIN p ON p.hadm_id = d.hadm_id GROUP BY d.hadm_id, d.drug""",
        "cooccurrence_pairs": cte(e=ENT, s=SENT)[:-1] + f", {_LAST}, {_pairs('p', chr(39) + 'DRUG' + chr(39) + ', ' + chr(39) + 'problem' + chr(39) + ', ' + chr(39) + 'treatment' + chr(39) + ', ' + chr(39) + 'test' + chr(39), 1, _BATCH_S)} SELECT * FROM p",
        "extract_relations": cte(e=ENT, s=SENT)[:-1] + f", {_LAST}, {_pairs('p', chr(39) + 'DRUG' + chr(39) + ', ' + chr(39) + 'problem' + chr(39), 1, _BATCH_S)}, " + _relations("r", "p", "'DRUG'", "'problem'", "CASE WHEN section_name IN ('HPI', 'Hospital Course') THEN 0.80 ELSE 0.65 END") + " SELECT * FROM r",
        "relaxed_fallback": cte(e=ENT, s=SENT)[:-1] + f", {_FALLBACK} SELECT * FROM fr",
        "link_concepts": cte(e=ENT, kb=KB)[:-1] + ", mm AS (SELECT word, entity_group, t AS relation_type FROM e CROSS JOIN (VALUES ('TREATS'), ('CAUSES'), ('NONE')) AS v(t)), " + _link("lk", "mm", "target") + " SELECT * FROM lk",
        "link_relations": cte(e=ENT, s=SENT, kb=KB)[:-1] + f", {_FALLBACK}, m1 AS (SELECT word_1 AS word, entity_group_1 AS entity_group, relation_type FROM fr), m2 AS (SELECT word_2 AS word, entity_group_2 AS entity_group, relation_type FROM fr), {_link('l1', 'm1', 'source')}, {_link('l2', 'm2', 'target')}" + f"""
 SELECT f.note_id, f.start_1, f.start_2, f.relation_type, l1.cui AS cui_1, l1.canonical_name AS canonical_name_1, l2.cui AS cui_2, l2.canonical_name AS canonical_name_2, {_IS_VALID.replace('relation_type', 'f.relation_type')} AS target_semantic_valid
 FROM fr f LEFT JOIN l1 ON l1.word = f.word_1 AND l1.entity_group = f.entity_group_1 AND l1.relation_type = f.relation_type LEFT JOIN l2 ON l2.word = f.word_2 AND l2.entity_group = f.entity_group_2 AND l2.relation_type = f.relation_type LEFT JOIN {_VALID} v ON v.vc = l2.cui""",
        "target_valid": cte(e=ENT, kb=KB)[:-1] + ", mm AS (SELECT word, entity_group, t AS relation_type FROM e CROSS JOIN (VALUES ('TREATS'), ('CAUSES'), ('NONE')) AS v(t)), " + _link("lk", "mm", "target") + f" SELECT word, entity_group, relation_type, cui, canonical_name, {_IS_VALID} AS target_semantic_valid FROM lk LEFT JOIN {_VALID} v ON v.vc = lk.cui",
        "linked_or_unmapped": cte(kb=KB) + "SELECT text, CASE WHEN s >= 0.95 THEN c ELSE 'UNMAPPED' END AS cui, CASE WHEN s >= 0.95 THEN n ELSE 'UNMAPPED' END AS canonical_name FROM (SELECT alias AS text, max(score) AS s, arg_max(cui, score) AS c, arg_max(canonical_name, score) AS n FROM kb GROUP BY alias)",
        "ade_track": cte(r=REL) + "SELECT * FROM r WHERE relation_type = 'CAUSES' AND model_confidence >= 0.75",
        "treatment_track": cte(r=REL) + "SELECT * FROM r WHERE relation_type = 'TREATS' AND model_confidence >= 0.65",
        "mapping_coverage": cte(r=REL) + "SELECT count(*) AS rows, round((sum(CASE WHEN cui_1 <> 'UNMAPPED' THEN 1 ELSE 0 END) + sum(CASE WHEN cui_2 <> 'UNMAPPED' THEN 1 ELSE 0 END)) / (2.0 * count(*)), 6) AS coverage FROM r",
        "longitudinal_edges": cte(r=REL)[:-1] + f", {_EDGES} SELECT hadm_id, cui_1 AS source_cui, nm.a AS source_name, cui_2 AS target_cui, nm.b AS target_name, relation_type AS relation, array_to_string(notes, '|') AS note_occurrences, array_to_string(secs, '|') AS sections_found, mention_count, round(base, 6) AS base_confidence FROM ed",
        "alignment_score": cte(r=REL)[:-1] + f", {_EDGES} SELECT hadm_id, cui_1 AS source_cui, cui_2 AS target_cui, relation_type AS relation, round({_ALIGN}, 6) AS alignment_score FROM ed",
        "node_centrality": cte(r=REL)[:-1] + f", {_EDGES}, {_NODES} SELECT * FROM nd",
        "edge_visuals": cte(r=REL)[:-1] + f", {_EDGES} SELECT hadm_id, cui_1 AS source_cui, cui_2 AS target_cui, relation_type AS relation, round(1.5 + {_ALIGN} * 2, 6) AS edge_width, CASE WHEN len(notes) > 1 OR len(secs) > 1 THEN '#f59e0b' ELSE '#2dd4bf' END AS edge_color FROM ed",
        "graph_rows": cte(r=REL)[:-1] + f""", {_EDGES}, {_NODES} SELECT hadm_id, 'node' AS part, cui AS source, NULL AS target, name, NULL AS relation, centrality, NULL AS alignment_score, NULL AS is_consensus FROM nd
 UNION ALL SELECT hadm_id, 'edge', cui_1, cui_2, NULL, relation_type, NULL, round({_ALIGN}, 3), len(notes) > 1 OR len(secs) > 1 FROM ed""",
        "knowledge_graph": cte(r=REL)[:-1] + f""", {_EDGES}, {_NODES}, n2 AS (SELECT hadm_id, count(*) AS total_nodes, string_agg(cui || '|' || name || '|' || centrality, ';' ORDER BY cui) AS nodes FROM nd GROUP BY 1)
 SELECT ed.hadm_id, CAST(any_value(total_nodes) AS INTEGER) AS total_nodes, CAST(count(*) AS INTEGER) AS total_edges, round(avg(CASE WHEN len(notes) > 1 OR len(secs) > 1 THEN 1.0 ELSE 0.0 END), 3) AS consensus_ratio, any_value(n2.nodes) AS nodes,
 string_agg(cui_1 || '|' || cui_2 || '|' || relation_type || '|' || array_to_string(secs, '+') || '|' || (len(notes) > 1 OR len(secs) > 1), ';' ORDER BY cui_1, cui_2, relation_type) AS edges FROM ed JOIN n2 ON n2.hadm_id = ed.hadm_id GROUP BY ed.hadm_id""",
        "graph_visuals": cte(r=REL)[:-1] + f", {_EDGES}, c AS (SELECT hadm_id, cui, count(*) AS centrality FROM (SELECT hadm_id, cui_1 AS cui FROM ed UNION ALL SELECT hadm_id, cui_2 FROM ed) GROUP BY hadm_id, cui) SELECT hadm_id, cui, round(14 + 28 * centrality / max(centrality) OVER (PARTITION BY hadm_id), 6) AS node_size FROM c",
        "graph_summary": cte(r=REL)[:-1] + f", {_EDGES}, c AS (SELECT hadm_id, count(DISTINCT cui) AS total_nodes FROM (SELECT hadm_id, cui_1 AS cui FROM ed UNION ALL SELECT hadm_id, cui_2 FROM ed) GROUP BY hadm_id) SELECT ed.hadm_id, CAST(any_value(total_nodes) AS INTEGER) AS total_nodes, CAST(count(*) AS INTEGER) AS total_edges, round(avg(CASE WHEN len(notes) > 1 OR len(secs) > 1 THEN 1.0 ELSE 0.0 END), 3) AS consensus_ratio FROM ed JOIN c ON c.hadm_id = ed.hadm_id GROUP BY ed.hadm_id",
        "finding_pairs": cte(e=ENT, s=SENT)[:-1] + f", {_FIRST}, {_FPAIRS} SELECT * FROM fp",
        "finding_relations": cte(e=ENT, s=SENT)[:-1] + f", {_FIRST}, {_FPAIRS} SELECT * FROM fp WHERE relation_type IS NOT NULL",
        "severity_map": cte(e=ENT, s=SENT)[:-1] + f", {_FIRST}, {_SEV} SELECT * FROM sv",
        "severity_counts": cte(e=ENT, s=SENT)[:-1] + f", {_FIRST}, {_SEV} SELECT severity, count(*) AS n FROM sv GROUP BY severity",
        "section_summary": cte(e=ENT) + "SELECT note_id, 'all_sections' AS section_name, string_agg(word, '|' ORDER BY a, b, c, word) AS words FROM (SELECT note_id, word, min(struct_pack(a := sentence_index, b := start, c := end_)).a AS a, min(struct_pack(a := sentence_index, b := start, c := end_)).b AS b, min(struct_pack(a := sentence_index, b := start, c := end_)).c AS c FROM e GROUP BY note_id, word) GROUP BY note_id",
        "radiology_edges": cte(e=ENT, s=SENT)[:-1] + f", {_FIRST}, {_FPAIRS}, {_SEV}, {_REDGES} SELECT * FROM re",
        "radiology_graph": cte(e=ENT, s=SENT)[:-1] + f", {_FIRST}, {_FPAIRS}, {_SEV}, {_REDGES}, {_RGRAPH} SELECT * FROM rg",
        "packed_radiology_graph": cte(e=ENT, s=SENT)[:-1] + f", {_FIRST}, {_FPAIRS}, {_SEV}, {_REDGES}, {_RGRAPH} SELECT hadm_id, string_agg(CASE WHEN part = 'node' THEN source END, '|' ORDER BY source) AS nodes, CAST(count(*) FILTER (part = 'edge') AS INTEGER) AS n_edges FROM rg GROUP BY hadm_id",
        "radiology_bundle": cte(n=NOTES, e=ENT, s=SENT)[:-1] + f""", {_FIRST}, {_FPAIRS}, {_SEV},
 mm AS ({_measurement_rows()}), ng AS ({_negation_rows()}),
 m2 AS (SELECT note_id, string_agg(measurement, '|' ORDER BY form, start, end_) AS x FROM mm GROUP BY 1), n2 AS (SELECT note_id, string_agg(finding, '|' ORDER BY pattern_no, start, end_) AS x FROM ng GROUP BY 1),
 w0 AS (SELECT note_id, word, min(struct_pack(a := sentence_index, b := start, c := end_)) AS ord_ FROM e GROUP BY 1, 2), w2 AS (SELECT note_id, string_agg(word, '|' ORDER BY ord_, word) AS x FROM w0 GROUP BY 1),
 r2 AS (SELECT note_id, string_agg(entity_1 || '>' || relation_type || '>' || entity_2, '|' ORDER BY sentence_index, ord_1, ord_2) AS x FROM fp WHERE relation_type IS NOT NULL GROUP BY 1), s2 AS (SELECT note_id, string_agg(word || '=' || severity, '|' ORDER BY word) AS x FROM sv GROUP BY 1)
 SELECT n.note_id, coalesce(m2.x, '') AS measurements, coalesce(n2.x, '') AS negations, coalesce(w2.x, '') AS words, coalesce(r2.x, '') AS relations, coalesce(s2.x, '') AS severities FROM (SELECT DISTINCT note_id FROM n) n
 LEFT JOIN m2 USING (note_id) LEFT JOIN n2 USING (note_id) LEFT JOIN w2 USING (note_id) LEFT JOIN r2 USING (note_id) LEFT JOIN s2 USING (note_id)""",
        "entity_type_counts": cte(e=ENT) + "SELECT entity_group, count(*) AS n FROM e GROUP BY ALL",
        "entities_by_sentence": cte(e=ENT) + "SELECT note_id, sentence_index, count(*) AS n, string_agg(DISTINCT word, '|' ORDER BY word) AS words FROM e GROUP BY ALL",
        "cosine_similarity": "WITH m AS (SELECT list(a ORDER BY i) AS c FROM (SELECT i, avg(x) AS a FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i)) SELECT vec_id, round(coalesce(list_cosine_similarity(embedding::DOUBLE[], c), 0.0), 6) AS cosine FROM embeddings, m",
        "relation_counts": cte(r=REL) + "SELECT count(*) AS relations, count(*) FILTER (relation_type = 'CAUSES') AS causes, count(*) FILTER (relation_type = 'TREATS') AS treats FROM r",
        "unmapped_count": cte(d=DIAG, g=GEM) + "SELECT count(*) AS codes, count(*) FILTER (NOT (icd_version = '10' OR (icd_version = '9' AND icd10_code IS NOT NULL))) AS unmapped FROM d LEFT JOIN g ON icd_version = '9' AND trim(icd_code) = icd9_code",
        "count_metrics": cte(e=ENT, r=REL)[:-1] + f""", {_EDGES}, {_NODES} SELECT 'entities' AS metric, count(*) AS value FROM e UNION ALL SELECT 'entity_types', count(DISTINCT entity_group) FROM e UNION ALL SELECT 'relations', count(*) FROM r
 UNION ALL SELECT 'edges', count(*) FROM ed UNION ALL SELECT 'nodes', count(*) FROM nd UNION ALL SELECT 'agreed_edges', count(*) FROM ed WHERE len(notes) > 1 OR len(secs) > 1""",
        "pair_dedup": cte(e=ENT)[:-1] + f""", x AS (SELECT a.note_id, {", ".join(f"a.{c} AS {c}_1, b.{c} AS {c}_2" for c in _E)} FROM e a JOIN e b ON a.note_id = b.note_id AND a.sentence_index = b.sentence_index AND a.start < b.start)
 SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY note_id, start_1, start_2 ORDER BY {", ".join(f"{c}_{k}" for k in (1, 2) for c in _E)}) AS n FROM x) WHERE n = 1""",
        "colliding_sections": cte(e0=ENT, s=SENT)[:-1] + f""", e AS (SELECT e0.*, o.section_ord FROM e0 JOIN (SELECT DISTINCT note_id, section_ord FROM s) o USING (note_id)),
 x AS (SELECT a.note_id, a.section_ord, a.hadm_id, {", ".join(f"a.{c} AS {c}_1, b.{c} AS {c}_2" for c in _E)}, abs(a.sentence_index - b.sentence_index) AS sentence_diff FROM e a JOIN e b ON a.note_id = b.note_id AND a.section_ord = b.section_ord AND a.hadm_id = b.hadm_id AND a.start < b.start
   AND abs(a.sentence_index - b.sentence_index) <= 1 AND ((a.entity_group = 'DRUG' AND b.entity_group = 'problem') OR (a.entity_group = 'problem' AND b.entity_group = 'DRUG'))),
 y AS (SELECT x.*, coalesce(s.section_name, 'unknown') AS section_name FROM x LEFT JOIN s ON s.note_id = x.note_id AND s.section_ord = x.section_ord AND s.sentence_index = x.sentence_index_1)
 SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY note_id, section_ord, start_1, start_2 ORDER BY {", ".join(f"{c}_{k}" for k in (1, 2) for c in _E)}) AS n FROM y) WHERE n = 1""",
        "polish_order": cte(e=ENT)[:-1] + ", " + _POLISH + " SELECT note_id, sentence_index, word, start, end_, CAST(row_number() OVER (PARTITION BY note_id, sentence_index ORDER BY word, start, end_, entity_group, source_model, score) AS INTEGER) AS place FROM p",
        "lexicon_entities": cte(n=NOTES)[:-1] + ", q AS (SELECT note_id, hadm_id, CAST(0 AS BIGINT) AS sentence_index, text FROM n) " + _lexicon("q", "note_id, hadm_id, sentence_index", "text"),
        "model_entities": cte(q=SENT) + _rash("rash", "problem", "ClinicalBERT"),
        "windowed_model": cte(q0=SENT)[:-1] + r", q AS (SELECT note_id, hadm_id, sentence_index, regexp_extract(sentence_text, '^\S+(\s+\S+){0,2}') AS sentence_text FROM q0) " + _rash("rash|drug", "FINDING", "RadBERT"),
        "legacy_recogniser": cte(q=SENT) + "SELECT note_id, hadm_id, sentence_index, 'CHEMICAL' AS entity_group, 'aspirin' AS word, CAST(strpos(sentence_text, 'aspirin') - 1 AS BIGINT) AS start, CAST(strpos(sentence_text, 'aspirin') + 6 AS BIGINT) AS end_, CAST(1.0 AS DOUBLE) AS score, 'bc5cdr' AS source_model FROM q WHERE contains(sentence_text, 'aspirin')",
        "recognisers_union": cte(q=SENT)[:-1] + ", u AS (" + _lexicon("q", "note_id, hadm_id, sentence_index", "sentence_text") + " UNION ALL " + _rash("rash", "problem", "ClinicalBERT") + ") SELECT source_model, entity_group, word, count(*) AS n FROM u GROUP BY ALL",
        "model_splitter": cte(n=NOTES) + r"SELECT note_id, CAST(i AS INTEGER) AS sentence_index, regexp_replace(p, '^\s+|\s+$', '', 'g') AS sentence_text FROM (SELECT note_id, x[i + 1] AS p, i FROM (SELECT note_id, x, unnest(range(0, len(x))) AS i FROM (SELECT note_id, string_split(regexp_replace(text, '\sof\b', chr(1) || 'of', 'g'), chr(1)) AS x FROM n))) WHERE length(regexp_replace(p, '^\s+|\s+$', '', 'g')) > 2",
        "tagged_polish": cte(e0=ENT)[:-1] + ", e AS (SELECT * FROM e0 WHERE lower(word) <> 'sepsis' AND NOT (lower(word) = 'pneumonia' AND lower(entity_group) IN ('treatment', 'problem'))), " + _POLISH + " SELECT * FROM p",
        "model_relations": cte(e=ENT, s=SENT)[:-1] + f""", {_LAST}, {_pairs('p', chr(39) + 'DRUG' + chr(39) + ', ' + chr(39) + 'problem' + chr(39), 1, _BATCH_S)}, c AS (SELECT p.*, coalesce(a.sentence_text, '') || CASE WHEN p.sentence_diff = 0 THEN '' ELSE ' ' || coalesce(b.sentence_text, '') END AS context FROM p
 LEFT JOIN lastsent a ON a.note_id = p.note_id AND a.sentence_index = p.sentence_index_1 LEFT JOIN lastsent b ON b.note_id = p.note_id AND b.sentence_index = p.sentence_index_2)
 SELECT * EXCLUDE (context), CASE WHEN lower(CASE WHEN entity_group_1 = 'DRUG' THEN word_1 ELSE word_2 END) = 'aspirin' THEN 'CAUSES' ELSE 'TREATS' END AS relation_type, CAST(CASE WHEN contains(context, 'due to') THEN 0.9 ELSE 0.7 END AS DOUBLE) AS model_confidence,
 CASE WHEN contains(context, 'drug') THEN 'clinical abbreviation' ELSE 'direct implication' END AS evidence_type, CAST(CASE WHEN contains(context, 'drug') THEN 0.8 ELSE 0.6 END AS DOUBLE) AS evidence_confidence FROM c""",
        "model_probe": "SELECT * FROM (VALUES ('rash', CAST(2 AS BIGINT)), ('absent', CAST(0 AS BIGINT))) AS v(name, there)",
        "resembling_concepts": cte(e=ENT, kb=KB)[:-1] + """, w AS (SELECT DISTINCT lower(word) || 'e' AS word FROM e), t AS (SELECT word, list_distinct(list_transform(range(1, length(word) + 1), lambda i: substring(' ' || word || ' ', CAST(i AS INTEGER), 3))) AS g FROM w),
 a AS (SELECT alias, list_distinct(list_transform(range(1, length(alias) + 1), lambda i: substring(' ' || alias || ' ', CAST(i AS INTEGER), 3))) AS h FROM (SELECT DISTINCT alias FROM kb)),
 j AS (SELECT word, alias, len(list_intersect(g, h)) AS met, len(g) AS n, len(h) AS k FROM t, a) SELECT word, alias, round(met / (n + k - met), 6) AS similarity FROM j WHERE met / (n + k - met) >= 0.6""",
        "csv_round_trip": cte(e=ENT) + "SELECT * FROM e",
        "json_round_trip": "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS v, CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS w FROM part",
        "crosswalk_source": cte(d=DIAG, g="SELECT * FROM (VALUES ('4019','I10'), ('25000','E119')) AS g(icd9_code, icd10_code)") + """SELECT subject_id, hadm_id, seq_num, CASE WHEN icd_version = '9' THEN coalesce(icd10_code, trim(icd_code)) ELSE icd_code END AS icd_code, CASE WHEN icd_version = '9' AND icd10_code IS NOT NULL THEN '10' ELSE icd_version END AS icd_version,
 CASE icd_version WHEN '10' THEN false WHEN '9' THEN icd10_code IS NULL ELSE true END AS is_unmapped FROM d LEFT JOIN g ON icd_version = '9' AND trim(icd_code) = icd9_code""",
        "pdf_source": "SELECT n_name FROM nation",
        "rows_source": "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(2 AS BIGINT), 'a.pdf', 'radiology', 'one'), (1, 2, 'b.pdf', 'radiology', 'two'), (3, 4, 'c', 'discharge', 'three')) AS v(subject_id, hadm_id, note_id, note_type, text)",
        "relations_sink": cte(r=REL) + "SELECT note_id, hadm_id, relation_type, model_confidence, cui_1, cui_2 FROM r",
        "tracks_sink": cte(r=REL) + "SELECT 'ade' AS track, note_id, hadm_id, relation_type, model_confidence, cui_1, cui_2, target_semantic_valid FROM r WHERE relation_type = 'CAUSES' AND model_confidence >= 0.75 UNION ALL SELECT 'treatment', note_id, hadm_id, relation_type, model_confidence, cui_1, cui_2, NULL FROM r WHERE relation_type = 'TREATS' AND model_confidence >= 0.65",
        "edges_sink": cte(r=REL)[:-1] + f", {_EDGES} SELECT hadm_id, cui_1 AS source_cui, cui_2 AS target_cui, relation_type AS relation, array_to_string(notes, '|') AS note_occurrences, array_to_string(secs, '|') AS sections_found FROM ed",
        "admission_exports": cte(s=SENT) + "SELECT hadm_id, note_id, sentence_index, sentence_text FROM s",
        "notes_stream": cte(n=NOTES)[:-1] + ", " + _SEGMENTS + " SELECT note_id, section_name, section_ord, section_text FROM g",
    }
    return out
