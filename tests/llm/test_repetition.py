"""Repetition against brute force; the Kneser-Ney model sums to one."""

import random
from math import exp

from pyspark.sql import functions as F

from chartloom.llm import repetition as rp


def brute(text):
    words, k = rp.units(text or "")
    seen, covered = set(), [False] * len(words)
    for i in range(len(words) - k + 1):
        g = tuple(words[i : i + k])
        if g in seen:
            covered[i : i + k] = [True] * k
        seen.add(g)
    return len(words), sum(covered)


def test_equals_brute_force(spark):
    r = random.Random(6)
    phrase = "the quick brown fox jumps over a very lazy dog"
    texts = [None, "", " ", "a", "a " * 100, phrase, phrase + ". " + phrase.upper(), "患者发热三天，患者发热三天，今天好转，患者发热三天，患者发热三天，今天好转。" * 3, "x" * 50_000]
    texts += [" ".join(r.choice([phrase, "alpha beta", "gamma", "Größe_7"]) for _ in range(r.randrange(40))) for _ in range(60)]
    df = spark.createDataFrame([*enumerate(texts), (5, texts[5])], "doc_id bigint, text string")
    got = {x.doc_id: (x.n_units, x.n_repeated) for x in rp.repeated_share(df, "doc_id", "text").collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_model_sums_to_one(spark):
    rows = [("en", a, b, c, n) for a, b, c, n in [(1, 2, 3, 4), (1, 2, 4, 1), (2, 3, 5, 2), (2, 4, 5, 1), (3, 5, 3, 3), (3, 5, 4, 1), (4, 5, 3, 1)]]
    counts = spark.createDataFrame(rows, "lang string, h1 bigint, h2 bigint, h3 bigint, n bigint")
    model = rp.kneser_ney(counts).collect()
    assert len(model) == len(rows) and all(0 < exp(m.logp) <= 1 for m in model)
    for ctx in {(m.h1, m.h2) for m in model}:
        assert sum(exp(m.logp) for m in model if (m.h1, m.h2) == ctx) <= 1 + 1e-9


def test_bands(spark):
    usual = [(i, "the patient was seen on the ward and went home", "en") for i in range(60)]
    odd = [(100, " ".join(f"zq{k}x" for k in range(30)), "EN "), (101, "", "en"), (102, None, None)]
    got = {x.doc_id: x for x in rp.perplexity_bands(spark.createDataFrame(usual + odd, "doc_id bigint, text string, lang string"), "doc_id", "text", "lang").collect()}
    assert got[100].verdict == "high" and got[100].perplexity > got[0].perplexity and got[0].verdict == "kept"
    assert rp.perplexity_bands(spark.createDataFrame([], "doc_id bigint, text string, lang string"), "doc_id", "text", "lang").count() == 0


def test_hot_keys_change_nothing(spark, monkeypatch):
    left = spark.createDataFrame([("a", k % 3 if k % 2 else 0, k) for k in range(200)], "lang string, h int, v int")
    right = left.groupBy("lang", "h").count().withColumnRenamed("count", "rows").selectExpr("lang", "h", "h * 10 as x", "rows")
    plain = sorted(tuple(r) for r in left.join(right.drop("rows"), ["lang", "h"]).select("lang", "h", "v", "x").collect())
    for hot in (0.001, 0.3, 2.0):
        monkeypatch.setattr(rp, "HOT", hot)
        assert sorted(tuple(r) for r in rp.skewed_join(left, right, ["lang", "h"], "rows").select("lang", "h", "v", "x").collect()) == plain
