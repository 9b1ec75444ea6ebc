"""Linking mentions to concepts, with semantic gates and context-aware ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.operators.entities import norm

UNMAPPED = "UNMAPPED"
# Semantic types that each label may have, types that are rejected, and types of valid targets.
PHARMA = ["Pharmacologic Substance", "Clinical Drug"]
CONDITION = ["Disease or Syndrome", "Finding", "Sign or Symptom", "Injury or Poisoning"]
CONSTRAINTS = {
    "drug": PHARMA,
    "medication": PHARMA,
    "chemical": [*PHARMA, "Organic Chemical"],
    "problem": CONDITION,
    "test": ["Diagnostic Procedure", "Laboratory Procedure"],
    "treatment": ["Therapeutic or Preventive Procedure", "Clinical Drug", "Pharmacologic Substance"],
}
REJECTED = ["Body Part", "Body Location", "Anatomical Structure"]
TARGETS = {"TREATS": CONDITION, "CAUSES": [*CONDITION, "Adverse Event"]}
#: Candidates of a mention.
TOP_K = 3
#: Least Jaccard similarity of the trigrams of a mention and an alias that resembles it.
LEAST_ALIKE = 0.7


def _any(types: Column, names: list[str]) -> Column:
    return F.arrays_overlap(types, F.array(*[F.lit(n) for n in names]))


def semantic_gate(types: Column, label: Column) -> Column:
    """No rejected type; for a label with constraints, one of its types (or none known)."""
    fits = F.lit(True)
    for name, allowed in CONSTRAINTS.items():
        fits = F.when(label == name, _any(types, allowed) | (F.size(types) == 0)).otherwise(fits)
    return ~_any(types, REJECTED) & fits


def adjusted_score(base: Column, types: Column, label: Column, relation: Column, role: str) -> Column:
    out = base
    if role == "target":
        out = out + F.when(relation == "TREATS", F.when(_any(types, TARGETS["TREATS"]), 0.15).otherwise(-0.25)).when(relation == "CAUSES", F.when(_any(types, TARGETS["CAUSES"]), 0.10).otherwise(-0.20)).otherwise(0.0)
    out = out + F.when(label.isin("drug", "medication", "chemical"), F.when(_any(types, PHARMA), 0.05).otherwise(-0.10)).otherwise(0.0)
    return out - F.when(_any(types, REJECTED), 0.35).otherwise(0.0)


def concept_types(kb: DataFrame) -> DataFrame:
    return kb.groupBy("cui").agg(F.sort_array(F.collect_set("semantic_type")).alias("types"))


def link_concepts(mentions: DataFrame, kb: DataFrame, role: str) -> DataFrame:
    """word, entity_group, relation_type, cui, canonical_name for each different (word, entity_group, relation_type).

    Every run of words of a mention that is an alias, up to as many as the longest alias of ``kb`` has and always the whole
    mention, brings its ``TOP_K`` best concepts; they are gated by type, re-ranked by context, and the first is taken; else ``UNMAPPED``. Different mentions are linked once, by an equi-join on alias.
    """
    m = mentions.select("word", "entity_group", "relation_type").distinct()
    longest = kb.agg(F.coalesce(F.max(F.size(F.split("alias", r"\s+"))), F.lit(1)).alias("longest")).scalar()
    words = F.split(norm("word"), r"\s+")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.least("longest", F.size(words))), lambda k: F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))
    parts = m.withColumn("longest", longest).withColumn("alias", F.explode(F.array_distinct(F.concat(runs, F.array(F.array_join(words, " ")))))).drop("longest")
    known = kb.join(concept_types(kb), "cui").groupBy("alias", "cui").agg(F.max("score").alias("score"), F.min("canonical_name").alias("canonical_name"), F.first("types").alias("types"))
    first = Window.partitionBy("alias").orderBy(F.desc("score"), "cui")
    top = known.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= TOP_K)
    label = norm("entity_group")
    cand = parts.join(top, "alias").where(semantic_gate(F.col("types"), label))
    cand = cand.withColumn("adjusted", F.round(adjusted_score(F.col("score"), F.col("types"), label, F.col("relation_type"), role), 9))
    best = Window.partitionBy("word", "entity_group", "relation_type").orderBy(F.desc("adjusted"), "alias", "rank")
    won = cand.withColumn("n", F.row_number().over(best)).where("n = 1").select("word", "entity_group", "relation_type", "cui", "canonical_name")
    out = m.alias("m").join(won.alias("w"), [F.col("m.word").eqNullSafe(F.col("w.word")), F.col("m.entity_group").eqNullSafe(F.col("w.entity_group")), F.col("m.relation_type").eqNullSafe(F.col("w.relation_type"))], "left")
    return out.select("m.word", "m.entity_group", "m.relation_type", F.coalesce("w.cui", F.lit(UNMAPPED)).alias("cui"), F.coalesce("w.canonical_name", F.lit(UNMAPPED)).alias("canonical_name"))


def trigrams(c: Column) -> Column:
    """The different runs of three characters of a text in lower case, with a blank at both ends."""
    padded = F.concat(F.lit(" "), norm(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, 3)))


def resembling_aliases(words: DataFrame, kb: DataFrame, least: float = LEAST_ALIKE) -> DataFrame:
    """word, alias, similarity: the aliases whose trigrams resemble those of a word by ``least`` or more (Jaccard).

    Of each side only the rarest trigrams meet (two sets of that similarity share one of the first ``n - ceil(least * n) +
    1`` in any common order, here by the number of aliases that have a trigram), then the whole sets are compared; a trigram
    that many aliases have so joins nothing, unless a name has no rarer one."""
    texts = words.select("word").where(F.col("word").isNotNull()).distinct().withColumn("g", trigrams(F.col("word")))
    names = kb.select("alias").where(F.col("alias").isNotNull()).distinct().withColumn("g", trigrams(F.col("alias")))
    often = names.select(F.explode("g").alias("t")).groupBy("t").agg(F.count("*").alias("c"))

    def leading(rows: DataFrame, key: str) -> DataFrame:
        first = Window.partitionBy(key).orderBy(F.coalesce("c", F.lit(0)), "t")
        ranked = rows.select(key, F.size("g").alias("n"), F.explode("g").alias("t")).join(often, "t", "left").withColumn("r", F.row_number().over(first))
        return ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select(key, "t")

    met = leading(texts, "word").join(leading(names, "alias"), "t").select("word", "alias").distinct()
    both = met.join(texts, "word").join(names.withColumnRenamed("g", "h"), "alias")
    shared = F.size(F.array_intersect("g", "h"))
    return both.withColumn("similarity", shared / (F.size("g") + F.size("h") - shared)).where(F.col("similarity") >= least).select("word", "alias", "similarity")


def with_resembling(kb: DataFrame, words: DataFrame, least: float = LEAST_ALIKE) -> DataFrame:
    """``kb`` with further aliases: each word that equals no alias but resembles one, its score lowered by the similarity. To
    be given to ``link_concepts`` in the place of ``kb``, so that misspelt mentions find concepts too."""
    lost = words.select(norm("word").alias("word")).distinct().join(kb.select(F.col("alias").alias("word")), "word", "left_anti")
    near = resembling_aliases(lost, kb, least)
    more = near.join(kb, "alias").select(F.col("word").alias("alias"), "cui", "canonical_name", "semantic_type", F.round(F.col("score") * F.col("similarity"), 9).alias("score"))
    return kb.select("alias", "cui", "canonical_name", "semantic_type", "score").unionByName(more)


def target_valid(rows: DataFrame, kb: DataFrame, cui_col: str) -> DataFrame:
    """``rows`` with ``target_semantic_valid``: the concept is known, has no rejected type, and a valid type for the
    relation (or no type)."""
    t = concept_types(kb).withColumnRenamed("cui", "kb_cui")
    j = rows.join(t, F.col(cui_col) == F.col("kb_cui"), "left")
    types = F.col("types")
    valid = F.when(F.col("relation_type") == "TREATS", _any(types, TARGETS["TREATS"])).when(F.col("relation_type") == "CAUSES", _any(types, TARGETS["CAUSES"])).otherwise(False)
    ok = F.when(types.isNull(), False).when(_any(types, REJECTED), False).otherwise(valid | (F.size(types) == 0))
    return j.withColumn("target_semantic_valid", ok).drop("types", "kb_cui")


def link_relations(relations: DataFrame, kb: DataFrame) -> DataFrame:
    """Relations with cui_N and canonical_name_N for both sides and target_semantic_valid."""
    out = relations
    for k, role in ((1, "source"), (2, "target")):
        side = relations.select(F.col(f"word_{k}").alias("word"), F.col(f"entity_group_{k}").alias("entity_group"), "relation_type")
        linked = link_concepts(side, kb, role).select(F.col("word").alias(f"word_{k}"), F.col("entity_group").alias(f"entity_group_{k}"), "relation_type", F.col("cui").alias(f"cui_{k}"), F.col("canonical_name").alias(f"canonical_name_{k}"))
        out = out.join(linked, [f"word_{k}", f"entity_group_{k}", "relation_type"], "left")
    return target_valid(out, kb, "cui_2")


def mapping_coverage(relations: DataFrame) -> DataFrame:
    """One row: slots mapped over all slots; 0 for an empty table."""
    hit = sum(F.sum(F.when(F.col(c) != UNMAPPED, 1).otherwise(0)) for c in ("cui_1", "cui_2"))
    return relations.agg(F.count("*").alias("rows"), F.coalesce(F.round(F.try_divide(hit.cast("double"), 2 * F.count("*")), 6), F.lit(0.0)).alias("coverage"))
