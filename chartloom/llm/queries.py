"""Queries p1 to p9 over the tables of a data folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.llm import canonical, leakage, mixing, neardup, pii, repetition, sentences, splitting
from chartloom.runtime import cut_lineage, table

#: Share of repeated words from which a document counts as repetitive.
REPETITIVE = 0.3
#: The curriculum of the mixture: how much more (or less) of a source towards the end.
TILTS = {"glossary": -0.5, "drug_leaflets": -0.3, "trial_abstracts": 0.4, "imaging_reports": 0.3}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "sections"), "section_id", "section_text").select("section_id", "sent_start", "sent_end")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "sections"), "section_id", "section_text", with_text=False).select("section_id").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "sections"), "section_id", "section_text")


def p2_quality(spark: SparkSession, d: str) -> DataFrame:
    """Of each split section whether its pieces keep the limit, cover the text from end to end and overlap by about 150."""
    sections = table(spark, d, "sections")
    pieces = splitting.split_oversized(sections, "section_id", "section_text", with_text=False)
    size = sections.groupBy("section_id").agg(F.max(F.length("section_text")).alias("n"))
    place = Window.partitionBy("section_id").orderBy("piece_no")
    p = pieces.withColumn("met", F.lag("piece_end").over(place) - F.col("piece_start"))
    seen = p.groupBy("section_id").agg(
        F.max(F.col("piece_end") - F.col("piece_start")).alias("longest"), F.min("piece_start").alias("first"), F.max("piece_end").alias("last"), F.min("met").alias("least"), F.max("met").alias("most"))
    return seen.join(size, "section_id").select("section_id", (F.col("longest") <= 1500).alias("within"), ((F.col("first") == 0) & (F.col("last") == F.col("n"))).alias("whole"), ((F.col("least") >= 100) & (F.col("most") <= 200)).alias("overlap"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.similar_pairs(table(spark, d, "sections"), "section_id", "section_text", words=3, share=0.6, least_words=40)
    return pairs.select(F.col("id_a").alias("section_id_a"), F.col("id_b").alias("section_id_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = neardup.similar_groups(table(spark, d, "sections"), "section_id", "section_text", words=3, share=0.6, least_words=40)
    return groups.withColumnRenamed("id", "section_id")


def _slots(relations: DataFrame) -> DataFrame:
    one = relations.select("rel_id", "word_1", "word_2").dropDuplicates(["rel_id"])
    return one.select("rel_id", F.explode(F.array(*[F.struct(F.lit(k).alias("slot_no"), F.col(f"word_{k}").alias("word")) for k in (1, 2)])).alias("s")).select("rel_id", "s.*")


def p5_mapped(spark: SparkSession, d: str) -> DataFrame:
    slots = _slots(table(spark, d, "relations_normalized_ade"))
    found = canonical.map_values(slots, "word", table(spark, d, "concept_ref"), "cui", ["canonical_name", "synonyms"])
    joined = slots.join(found, "word", "left")
    unmapped = F.lit(canonical.UNMAPPED)
    return joined.select("rel_id", "slot_no", "word", F.coalesce("matched_id", unmapped).alias("cui"), F.coalesce("matched_name", unmapped).alias("matched_name"), "cost")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_mapped(spark, d).select("rel_id", "slot_no", "cui")


def p5_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every entry within the threshold of each distinct value."""
    slots = _slots(table(spark, d, "relations_normalized_ade"))
    return canonical.entries_within(slots, "word", table(spark, d, "concept_ref"), "cui", ["canonical_name", "synonyms"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [("sections", "section_id", "section_text"), ("sentences", "sentence_id", "sentence_text")]
    found = [pii.pii_spans(table(spark, d, t), i, x).select(F.lit(t).alias("table_name"), "row_id", "pii_type", "start_pos", "end_pos") for t, i, x in parts]
    return found[0].unionByName(found[1])


def p6_redacted_sections(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "sections"), "section_id", "section_text")


def p6_redacted_sentences(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "sentences"), "sentence_id", "sentence_text")


#: Key of the surrogates of these queries, unless the session names one; a run on real data must.
SURROGATE_KEY = "key of the test tables"


def _key(spark: SparkSession) -> str:
    return spark.conf.get("spark.chartloom.surrogates.key", SURROGATE_KEY)


def p6_surrogates(spark: SparkSession, d: str) -> DataFrame:
    also = (table(spark, d, "sentences"), "sentence_id", "sentence_text")
    return pii.surrogates(table(spark, d, "sections"), "section_id", "section_text", _key(spark), also=(also,))


def p6_surrogates_sentences(spark: SparkSession, d: str) -> DataFrame:
    also = (table(spark, d, "sections"), "section_id", "section_text")
    return pii.surrogates(table(spark, d, "sentences"), "sentence_id", "sentence_text", _key(spark), also=(also,))


def p6_surrogate_check(spark: SparkSession, d: str) -> DataFrame:
    """Of each type, entities that share a stand-in or stand for themselves: none."""
    both = ((table(spark, d, "sections"), "section_id", "section_text"), (table(spark, d, "sentences"), "sentence_id", "sentence_text"))
    return pii.surrogate_check(pii.surrogate_map(pii.known_entities(*both), _key(spark)))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, d, "documents").withColumn("source", mixing.source_name("source"))
    counted = cut_lineage(mixing.token_counts(docs, "doc_id", "text", ["source"]))
    sizes = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("records"))
    plan = mixing.demand(sizes, table(spark, d, "mix_targets"), TILTS)
    return mixing.mixture(counted, plan, "doc_id"), plan, sizes


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    mixed, plan, sizes = _mixture(spark, d)
    return mixing.shares(mixed, plan, sizes)


def p8_targets(spark: SparkSession, d: str) -> DataFrame:
    """Whether each listed source meets its share and keeps its repeats."""
    mixed, plan, sizes = _mixture(spark, d)
    return mixing.targets_met(mixing.shares(mixed, plan, sizes), plan)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repeated_share(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_shares(spark, d).where((F.col("n_units") > 0) & (F.col("n_repeated") >= REPETITIVE * F.col("n_units"))).select("doc_id")


def p9_perplexity(spark: SparkSession, d: str) -> DataFrame:
    return repetition.perplexity_bands(table(spark, d, "documents"), "doc_id", "text", "lang")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        p1_found, p2_found, p2_pieces, p2_quality, p4_found, p4_groups, p5_found, p5_mapped, p5_candidates, p6_found, p6_redacted_sections, p6_redacted_sentences,
        p6_surrogates, p6_surrogates_sentences, p6_surrogate_check, p7_found, p8_mixture, p8_shares, p8_targets, p9_found, p9_shares, p9_perplexity,
    ]
    return {f.__name__: f for f in named}


_P4 = """
WITH s AS (SELECT section_id, any_value(section_text) AS t FROM sections WHERE section_text IS NOT NULL GROUP BY section_id),
w AS (SELECT section_id, regexp_extract_all(lower(t), '[\\p{L}\\p{Nd}]+') AS w FROM s),
g AS (SELECT section_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 40),
e AS (SELECT section_id, len(g) AS n, unnest(g) AS x FROM g),
p AS (SELECT a.section_id AS section_id_a, b.section_id AS section_id_b, a.n AS na, b.n AS nb, count(*) AS met
      FROM e a JOIN e b ON a.x = b.x AND a.section_id < b.section_id GROUP BY ALL)
SELECT section_id_a, section_id_b FROM p WHERE met >= 0.6 * (na + nb - met)
"""


_P9 = """
WITH d AS (SELECT doc_id, coalesce(any_value(text), '') AS t FROM documents GROUP BY doc_id),
w AS (SELECT doc_id, regexp_matches(t, '[㐀-䶿一-鿿豈-﫿]') AS han, regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+') AS w FROM d),
u AS (SELECT doc_id, CASE WHEN han THEN 16 ELSE 8 END AS k, CASE WHEN han AND len(w) > 0 THEN string_split(array_to_string(w, ''), '') ELSE w END AS u FROM w),
r AS (SELECT doc_id, k, unnest(range(1, len(u) - k + 2)) AS i, unnest(list_transform(range(1, len(u) - k + 2), lambda i: array_to_string(u[i : i + k - 1], ' '))) AS run FROM u WHERE len(u) > k),
a AS (SELECT doc_id, k, i FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS n FROM r) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS covered FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM a) GROUP BY doc_id),
s AS (SELECT u.doc_id, CAST(len(u) AS INTEGER) AS n_units, CAST(coalesce(covered, 0) AS INTEGER) AS n_repeated FROM u LEFT JOIN c ON c.doc_id = u.doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": "SELECT DISTINCT section_id FROM sections WHERE length(section_text) > 1500",
        "p2_quality": "SELECT section_id, true AS within, true AS whole, true AS overlap FROM sections GROUP BY section_id HAVING max(length(section_text)) > 1500",
        "p4_found": _P4,
        "p9_shares": _P9 + "SELECT doc_id, n_units, n_repeated, CASE WHEN n_units > 0 THEN n_repeated / n_units ELSE CAST(0 AS DOUBLE) END AS share FROM s",
        "p9_found": _P9 + "SELECT doc_id FROM s WHERE n_units > 0 AND n_repeated >= 0.3 * n_units",
        "p8_targets": r"SELECT DISTINCT t.source, true AS met, true AS repeats_kept FROM (SELECT regexp_replace(lower(trim(source)), '[\s_-]+', '_', 'g') AS source FROM mix_targets WHERE max_repeats > 0) t JOIN (SELECT regexp_replace(lower(trim(source)), '[\s_-]+', '_', 'g') AS source FROM documents WHERE trim(text) <> '') d ON d.source = t.source",
        "p6_surrogate_check": "SELECT unnest(['EMAIL', 'GIVEN', 'ID', 'NAME', 'PHONE', 'PLACE']) AS pii_type, CAST(0 AS BIGINT) AS collisions, CAST(0 AS BIGINT) AS unchanged",
    }
