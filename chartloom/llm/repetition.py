"""Repetition inside single documents, and perplexity bands.

``repeated_share`` measures the share of a document's words that lie in a run of words begun earlier in the same document.
A perplexity cannot give that share: a model counted over the corpus rates how usual a text is, not whether the document
has said it before (see the README for measured figures). It is built beside it as ``perplexity_bands``: modified
Kneser-Ney, counted by Spark over all documents, kept as arrays sorted by hash and sharded by hash range.

Defined results: null, blank or short texts have share 0; documents without any n-gram get no perplexity and are kept;
repeated ids give one result; texts are processed whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from chartloom.runtime import cut_lineage

WORD = re.compile(r"[^\W_]+")
HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")
RUN_WORDS, RUN_CHARS = 8, 16
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Hashes(dict):
    """64-bit hashes of words, each word hashed once per worker; forgotten when the vocabulary outgrows the memory meant for it."""

    most = 2_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxh64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    return x ^ (x >> np.uint64(29))


def units(text: str) -> tuple[list[str] | str, int]:
    """The words of a text and the run length; for texts with Chinese characters the letters and digits strung together."""
    words = WORD.findall(text.lower())
    if HAN.search(text):
        return "".join(words), RUN_CHARS
    return words, RUN_WORDS


def window_hashes(x: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` (a power of two) values, by doubling."""
    step = 1
    while step < width:
        x = mix(x[: len(x) - step] * _M2 + mix(x[step:])) if len(x) > step else x[:0]
        step *= 2
    return x


def repeated(values: np.ndarray, width: int) -> tuple[int, int]:
    """(values in a run that began earlier too, all values) of one sequence of hashes."""
    n = len(values)
    if n <= width:
        return 0, n
    h = window_hashes(values, width)
    order = np.argsort(h, kind="stable")
    s = h[order]
    again = np.zeros(len(h), bool)
    again[order[1:]] = s[1:] == s[:-1]
    if not again.any():
        return 0, n
    edge = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(again)
    edge[at] += 1
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum()), n


def repeated_share(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col``, ``n_units``, ``n_repeated``, ``share``; only later occurrences count as repeated."""
    kind = df.schema[id_col].dataType.simpleString()
    vocab = Hashes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = []
            for t in b.column(1).to_pylist():
                words, width = units(t or "")
                if isinstance(words, str):
                    v = np.frombuffer(words.encode("utf-32-le"), np.uint32).astype(np.uint64)
                    v = mix(v + np.uint64(1))
                else:
                    v = np.array([vocab[w] for w in words], np.uint64)
                counts.append(repeated(v, width))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c[1] for c in counts], pa.int32()), pa.array([c[0] for c in counts], pa.int32())], names=["id", "n_units", "n_repeated"])

    found = df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, n_units int, n_repeated int")
    one = found.groupBy("id").agg(F.max("n_units").alias("n_units"), F.max("n_repeated").alias("n_repeated"))
    share = F.when(F.col("n_units") > 0, F.col("n_repeated") / F.col("n_units")).otherwise(F.lit(0.0))
    return one.select(F.col("id").alias(id_col), "n_units", "n_repeated", share.alias("share"))


# ---------------------------------------------------------------- modified Kneser-Ney

ORDER = 3


def _ngrams(df: DataFrame, id_col: str, text_col: str, lang: str, per_doc: bool) -> DataFrame:
    """Counted trigrams as hashes of their three words (h1, h2, h3), summed per Arrow block before anything is shuffled."""
    kind = df.schema[id_col].dataType.simpleString()
    vocab = Hashes()
    out = pa.schema([("id", pa.int64() if kind == "bigint" else pa.string()), ("lang", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("h3", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, langs, texts = (b.column(k).to_pylist() for k in range(3))
            flat: list[int] = []
            spans = []
            for i, (t, lg) in enumerate(zip(texts, langs)):
                words, _ = units(t or "")
                if len(words):
                    flat += [1, 2]
                    flat += [vocab[w] for w in words]
                    spans.append((i, lg, len(words)))
            if not spans:
                continue
            v = np.array(flat, np.uint64)
            size = np.array([s[2] for s in spans])
            first = np.concatenate([[0], np.cumsum(size + 2)[:-1]])
            at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            tri = np.stack([v[at], v[at + 1], v[at + 2]], 1).astype(np.int64)
            group = np.repeat(np.arange(len(spans)), size) if per_doc else np.repeat([hash_lang(s[1]) for s in spans], size)
            key = mix(mix(tri[:, 0].astype(np.uint64) * _M2 + mix(tri[:, 1].astype(np.uint64))) * _M2 + tri[:, 2].astype(np.uint64)) ^ mix(group.astype(np.int64).astype(np.uint64) + _M1)
            _, pick, n = np.unique(key, return_index=True, return_counts=True)
            g = group[pick]
            names = {hash_lang(s[1]): s[1] for s in spans}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[spans[x][0]] for x in g] if per_doc else [None] * len(pick), out.field(0).type),
                    pa.array([spans[x][1] for x in g] if per_doc else [names[int(x)] for x in g], pa.string()),
                    *[pa.array(tri[pick, k]) for k in range(3)],
                    pa.array(n),
                ],
                schema=out,
            )

    return df.select(id_col, lang, text_col).mapInArrow(run, f"id {kind}, lang string, h1 bigint, h2 bigint, h3 bigint, n bigint")


def hash_lang(lang: str | None) -> int:
    return xxh64_intdigest(lang or "") >> 1


def _discounts(df: DataFrame, count: str) -> DataFrame:
    """Chen and Goodman's discounts of one order, per language, from the counts of counts."""
    n = [F.sum(F.when(F.col(count) == k, 1).otherwise(0)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    d = df.groupBy("lang").agg(*n)
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
    cut = lambda k: F.greatest(F.lit(0.05), F.lit(float(k)) - (k + 1) * y * F.col(f"n{k + 1}") / F.greatest(F.col(f"n{k}"), F.lit(1.0)))
    return d.select("lang", *[F.least(cut(k), F.lit(k - 0.05)).alias(f"d{k}") for k in (1, 2, 3)])


#: A context is hot if more than this share of all n-grams has it (so at most 1 / HOT are); tasks among which it is dealt.
HOT, SALTS = 0.001, 16


def skewed_join(left: DataFrame, right: DataFrame, on: list[str], rows: str) -> DataFrame:
    """``left`` joined with the one row of ``right`` of each key. ``rows``: the column of ``right`` that says how many rows of
    ``left`` meet it; it stays out of the result. The hot keys, at most 1 / HOT of them, are broadcast; their rows are dealt
    out over SALTS tasks, each with a copy of the right row. ``right`` is read several times and should be a written table."""
    total = right.agg(F.sum(rows).alias("total")).scalar()
    hot = F.broadcast(right.where(F.col(rows) > HOT * total).select(*on, F.lit(True).alias("hot")))
    share = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")
    dealt = left.join(hot, on, "left").withColumn("salt", F.when(F.col("hot"), share).otherwise(0)).drop("hot")
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = right.join(hot, on, "left").withColumn("salt", F.explode(copies)).drop("hot", rows)
    return dealt.join(copied, [*on, "salt"]).drop("salt")


def kneser_ney(counts: DataFrame) -> DataFrame:
    """``lang, h1, h2, h3, logp`` of every counted trigram under interpolated modified Kneser-Ney.

    ``counts``: lang, h1, h2, h3, n summed over the corpus. The lower orders use continuation counts. Everything is joins
    and sums of counted n-grams, so cost follows the number of different n-grams, not the corpus; contexts that very many
    n-grams share are split. Discount tables have one row per language; unigram totals are one row per language.
    """
    bi = cut_lineage(counts.groupBy("lang", "h2", "h3").agg(F.count("*").alias("c2")))  # different words before (h2, h3)
    uni = bi.groupBy("lang", "h3").agg(F.count("*").alias("c1"))  # different words before h3
    total = uni.groupBy("lang").agg(F.sum("c1").alias("t1"), F.count("*").alias("v1"))
    d3, d2 = _discounts(counts, "n"), _discounts(bi, "c2")
    cut = lambda c: F.when(F.col(c) == 1, F.col("d1")).when(F.col(c) == 2, F.col("d2")).otherwise(F.col("d3"))
    p1 = cut_lineage(uni.join(F.broadcast(total), "lang").select("lang", "h3", "c1", ((F.col("c1") + 0.5) / (F.col("t1") + 0.5 * F.col("v1"))).alias("p1")))
    two = bi.join(F.broadcast(d2), "lang").withColumn("gone", cut("c2")).drop("d1", "d2", "d3")
    ctx2 = cut_lineage(two.groupBy("lang", "h2").agg(F.sum("c2").alias("s2"), F.sum("gone").alias("g2"), F.count("*").alias("rows")))
    own = F.greatest(F.col("c2") - F.col("gone"), F.lit(0.0))
    p2 = skewed_join(skewed_join(two, ctx2, ["lang", "h2"], "rows"), p1, ["lang", "h3"], "c1")
    p2 = cut_lineage(p2.select("lang", "h2", "h3", ((own + F.col("g2") * F.col("p1")) / F.col("s2")).alias("p2"), F.col("c2").alias("rows")))
    three = counts.select("lang", "h1", "h2", "h3", "n").join(F.broadcast(d3), "lang").withColumn("gone", cut("n")).drop("d1", "d2", "d3")
    ctx3 = cut_lineage(three.groupBy("lang", "h1", "h2").agg(F.sum("n").alias("s3"), F.sum("gone").alias("g3"), F.count("*").alias("rows")))
    full = skewed_join(skewed_join(three, ctx3, ["lang", "h1", "h2"], "rows"), p2, ["lang", "h2", "h3"], "rows")
    own = F.greatest(F.col("n") - F.col("gone"), F.lit(0.0))
    return full.select("lang", "h1", "h2", "h3", F.log((own + F.col("g3") * F.col("p2")) / F.col("s3")).alias("logp"))


def perplexity_bands(df: DataFrame, id_col: str, text_col: str, lang_col: str, lower: float = 0.02, upper: float = 0.98) -> DataFrame:
    """``id_col, lang, n_words, perplexity, verdict``: verdict ``low``, ``high`` or ``kept`` by the language's own bands.

    The bands are the ``lower`` and ``upper`` quantiles (to 1/10000 of the rows) of the language's documents. The model is
    joined by trigram; trigrams are summed per document before the join, and those of very many documents are split.
    """
    lang = F.regexp_extract(F.lower(F.trim(F.coalesce(F.col(lang_col), F.lit("")))), "^[a-z]{2}", 0)
    base = df.select(F.col(id_col), F.when(lang == "", "und").otherwise(lang).alias("lang"), F.col(text_col)).where(F.col(text_col).isNotNull())
    gram = ["lang", "h1", "h2", "h3"]
    seen = cut_lineage(_ngrams(base, id_col, text_col, "lang", True).groupBy("id", *gram).agg(F.max("n").alias("n")))
    counts = cut_lineage(seen.groupBy(*gram).agg(F.sum("n").alias("n"), F.count("*").alias("docs")))
    model = cut_lineage(kneser_ney(counts).join(counts.select(*gram, "docs"), gram))
    score = skewed_join(seen, model, gram, "docs").groupBy("id", "lang").agg(F.sum("n").alias("n_words"), F.sum(F.col("n") * F.col("logp")).alias("lp"))
    score = score.select("id", "lang", "n_words", F.exp(-F.col("lp") / F.col("n_words")).alias("perplexity"))
    bands = score.groupBy("lang").agg(F.percentile_approx("perplexity", [lower, upper], 10000).alias("band"))
    verdict = F.when(F.col("perplexity") < F.col("band")[0], "low").when(F.col("perplexity") > F.col("band")[1], "high").otherwise("kept")
    return score.join(F.broadcast(bands), "lang").select(F.col("id").alias(id_col), "lang", "n_words", "perplexity", verdict.alias("verdict"))
