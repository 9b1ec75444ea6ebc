"""Mixtures: shares, caps, curriculum."""

import pytest
from pyspark.sql import functions as F

from chartloom.llm import mixing

TARGETS = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 4), ("none", 0.05, 3)]


@pytest.fixture(scope="module")
def parts(spark):
    rows = [(i, " A " if i % 2 else "a", f"text number {i} " * 20) for i in range(600)] + [(1000 + i, "b", f"b {i} " * 30) for i in range(200)] + [(2000 + i, "c", f"c {i} " * 25) for i in range(60)]
    rows += [(3000, "x", "unlisted " * 9), (3001, None, "no source"), (3002, "a", None), (3003, "a", " "), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("source", mixing.source_name("source"))
    counted = mixing.token_counts(docs, "doc_id", "text", ["source"]).cache()
    sizes = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("records"))
    plan = mixing.demand(sizes, spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int"), {"c": 0.6})
    return counted, sizes, plan


def test_shares_and_caps(parts):
    counted, sizes, plan = parts
    mixed = mixing.mixture(counted, plan, "doc_id").cache()
    assert mixed.groupBy("doc_id", "copy_no").count().where("count > 1").count() == 0
    most = {r.source: r.m for r in mixed.groupBy("source").agg((F.max("copy_no") + 1).alias("m")).collect()}
    assert all(most[s] <= m for s, _, m in TARGETS if s in most)
    rep = {r.source: r for r in mixing.shares(mixed, plan, sizes).collect()}
    live = 0.95
    for s, share, _ in TARGETS[:3]:
        assert abs(rep[s].actual_share - share / live) < 0.02
    assert rep["none"].actual_share == 0 and rep["x"].tokens_used == 0 and rep["x"].tokens_available > 0


def test_curriculum_and_order(parts):
    counted, _, plan = parts
    rows = mixing.mixture(counted, plan, "doc_id").collect()
    at = [r.position for r in rows]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    late = lambda s: sum(r.n_tokens for r in rows if r.source == s and r.position > 0.5) / sum(r.n_tokens for r in rows if r.source == s)
    assert late("c") > 0.55 > 0.5 > late("a")


def test_counts_are_the_tokenizers(spark):
    enc = mixing.encoding(f"{mixing.TOKENIZERS}/{mixing.VOCABULARY}")
    t = "Fever 38.5 °C, 患者。 <|endoftext|>"
    df = spark.createDataFrame([(1, t)], "doc_id bigint, text string")
    assert mixing.token_counts(df, "doc_id", "text", []).first()["n_tokens"] == len(enc.encode_ordinary(t))
    assert enc.decode(enc.encode_ordinary(t)) == t


def test_empty(spark, parts):
    counted, _, plan = parts
    assert mixing.mixture(counted.limit(0), plan, "doc_id").count() == 0
