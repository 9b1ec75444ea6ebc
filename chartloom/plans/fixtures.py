"""Clinical views templated from the relational tables. The same SQL runs in Spark and DuckDB; {name} stands for a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from chartloom.runtime import table

NOTES = """
SELECT o_custkey % 50 AS subject_id, o_custkey AS hadm_id, CAST(o_orderkey AS STRING) AS note_id,
 CASE WHEN o_orderkey % 4 = 0 THEN 'radiology' ELSE 'discharge' END AS note_type,
 concat('Name: ___ ', chr(10), 'History of Present Illness:', chr(10), 'pt with HTN and hx of ',
   CASE o_orderkey % 3 WHEN 0 THEN 'pneumonia' WHEN 1 THEN 'CHF' ELSE 'sepsis' END, ' treated with ',
   CASE o_custkey % 3 WHEN 0 THEN 'lisinopril' WHEN 1 THEN 'aspirin' ELSE 'heparin' END, '.', chr(10),
   'Sodium: ', CAST(120 + o_orderkey % 40 AS STRING), ' mEq/L. [**2101-1-1**]', chr(10),
   'FINDINGS:', chr(10), 'Mass 2.5 x ', CAST(1 + o_orderkey % 9 AS STRING), ' cm due to infection. No evidence of fracture.', chr(10),
   'Impression:', chr(10), CASE WHEN o_orderkey % 2 = 0 THEN 'abnormal enhancement, 3 mm in diameter.' ELSE 'Unremarkable study.' END) AS text
FROM {orders}
"""
ENT = """
SELECT CAST(l_orderkey AS STRING) AS note_id, l_orderkey % 97 AS hadm_id, CAST(l_linenumber % 3 AS BIGINT) AS sentence_index,
 CASE l_partkey % 6 WHEN 0 THEN 'DRUG' WHEN 1 THEN 'DRUG' WHEN 2 THEN 'problem' WHEN 3 THEN 'treatment' WHEN 4 THEN 'STRENGTH' ELSE 'test' END AS entity_group,
 CASE l_partkey % 6 WHEN 0 THEN 'Lisinopril' WHEN 1 THEN 'aspirin' WHEN 2 THEN 'Pneumonia' WHEN 3 THEN 'acute sepsis' WHEN 4 THEN '10 mg' ELSE 'ct' END AS word,
 CAST(l_partkey % 40 AS BIGINT) AS start, CAST(l_partkey % 40 + 3 + l_suppkey % 12 AS BIGINT) AS end_,
 CASE WHEN l_partkey % 6 IN (0,1,4) THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) + l_discount END AS score,
 CASE WHEN l_partkey % 6 IN (0,1,4) THEN 'Med7' ELSE 'ClinicalBERT' END AS source_model
FROM {lineitem}
"""
SENT = """
SELECT CAST(o.o_orderkey AS STRING) AS note_id, o.o_orderkey % 97 AS hadm_id, CAST(x.section_ord AS BIGINT) AS section_ord,
 CASE (o.o_orderkey + x.section_ord) % 4 WHEN 0 THEN 'HPI' WHEN 1 THEN 'Hospital Course' WHEN 2 THEN 'Assessment/Plan' ELSE 'PMH' END AS section_name,
 CAST(i.sentence_index AS BIGINT) AS sentence_index,
 concat('Note ', CAST(o.o_orderkey AS STRING), CASE (o.o_orderkey + i.sentence_index) % 4 WHEN 0 THEN ' rash due to aspirin' WHEN 1 THEN ' started on lisinopril' WHEN 2 THEN ' seen today' ELSE ' given drug for sepsis, adverse reaction' END) AS sentence_text
FROM {orders} o
CROSS JOIN (VALUES (0),(1)) AS x(section_ord)
CROSS JOIN (VALUES (0),(1),(2)) AS i(sentence_index)
WHERE x.section_ord = 0 OR o.o_orderkey % 3 = 0
"""
REL = """
SELECT CAST(l.l_orderkey AS STRING) AS note_id, o.o_custkey % 200 AS hadm_id,
 CASE l.l_linenumber % 3 WHEN 0 THEN 'HPI' WHEN 1 THEN 'Hospital Course' ELSE 'Assessment/Plan' END AS section_name,
 CASE WHEN l.l_returnflag = 'A' THEN 'CAUSES' ELSE 'TREATS' END AS relation_type,
 CAST(0.6 AS DOUBLE) + l.l_discount * 3 AS model_confidence,
 CASE WHEN l.l_partkey % 11 = 0 THEN 'UNMAPPED' ELSE concat('C', lpad(CAST(l.l_partkey % 20 AS STRING), 7, '0')) END AS cui_1,
 CASE WHEN l.l_partkey % 11 = 0 THEN 'UNMAPPED' ELSE concat('drug ', CAST(l.l_partkey % 20 AS STRING)) END AS canonical_name_1,
 CASE WHEN l.l_suppkey % 13 = 0 THEN 'UNMAPPED' ELSE concat('C', lpad(CAST(100 + l.l_suppkey % 12 AS STRING), 7, '0')) END AS cui_2,
 CASE WHEN l.l_suppkey % 13 = 0 THEN 'UNMAPPED' ELSE concat('problem ', CAST(l.l_suppkey % 12 AS STRING)) END AS canonical_name_2,
 CAST(l.l_quantity AS BIGINT) % 4 <> 0 AS target_semantic_valid
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
"""
DIAG = """
SELECT o_custkey % 50 AS subject_id, o_custkey AS hadm_id, CAST(o_orderkey % 10 AS BIGINT) AS seq_num,
 CASE o_orderkey % 5 WHEN 0 THEN 'I10' WHEN 1 THEN ' 4019 ' WHEN 2 THEN '25000' WHEN 3 THEN '99999' ELSE '4280' END AS icd_code,
 CASE o_orderkey % 5 WHEN 0 THEN '10' WHEN 4 THEN '8' ELSE '9' END AS icd_version
FROM {orders}
"""
GEM = "SELECT * FROM (VALUES ('4019','I10'), ('25000','E119'), ('4280','I509')) AS g(icd9_code, icd10_code)"
RX = """
SELECT CAST(p_partkey % 50 AS BIGINT) AS hadm_id,
 CASE p_size % 5 WHEN 0 THEN 'Lorazepam' WHEN 1 THEN 'Acetaminophen (Liquid)' WHEN 2 THEN 'Heparin' WHEN 3 THEN NULL ELSE 'Aspirin EC' END AS drug
FROM {part}
"""
KB = """
SELECT * FROM (VALUES
 ('aspirin','C0004057','aspirin','Pharmacologic Substance', CAST(0.99 AS DOUBLE)),
 ('lisinopril','C0065374','lisinopril','Pharmacologic Substance', CAST(0.98 AS DOUBLE)),
 ('pneumonia','C0032285','Pneumonia','Disease or Syndrome', CAST(0.97 AS DOUBLE)),
 ('pneumonia','C0024109','Lung','Anatomical Structure', CAST(0.99 AS DOUBLE)),
 ('acute sepsis','C0243026','Sepsis','Disease or Syndrome', CAST(0.90 AS DOUBLE))
) AS k(alias, cui, canonical_name, semantic_type, score)
"""


def view(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """A fixture over the tables of a folder."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: table(spark, d, n) for n in names}) if names else spark.sql(sql)


def cte(**views: str) -> str:
    """WITH clause of fixtures for DuckDB."""
    return "WITH " + ",\n".join(f"{k} AS ({re.sub(r'[{}]', '', v)})" for k, v in views.items()) + "\n"
