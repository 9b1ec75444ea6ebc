"""Schemas of the datasets; operators keep them on empty input too."""

NOTES = "subject_id bigint, hadm_id bigint, note_id string, note_type string, text string"
SECTIONS = NOTES + ", section_name string, section_ord int, section_text string"
SENTENCES = "note_id string, hadm_id bigint, section_ord bigint, section_name string, sentence_index bigint, sentence_text string"
DIAGNOSES = "subject_id bigint, hadm_id bigint, seq_num bigint, icd_code string, icd_version string"
CROSSWALK = "icd9_code string, icd10_code string"
ENTITIES = "note_id string, hadm_id bigint, sentence_index bigint, entity_group string, word string, start bigint, end_ bigint, score double, source_model string"
RELATIONS = (
    "note_id string, hadm_id bigint, section_name string, relation_type string, model_confidence double, cui_1 string, canonical_name_1 string, cui_2 string, canonical_name_2 string, target_semantic_valid boolean"
)
PRESCRIPTIONS = "hadm_id bigint, drug string"
CONCEPTS = "alias string, cui string, canonical_name string, semantic_type string, score double"
EDGES = (
    "hadm_id bigint, source_cui string, source_name string, target_cui string, target_name string, relation string, note_occurrences array<string>, "
    "sections_found array<string>, mention_count bigint, base_confidence double, alignment_score double"
)
JOBS = "job_id string, status string, result string, error string"
