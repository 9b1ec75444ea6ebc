"""Mixing sources to target weights, as a time-varying curriculum.

Each source has a weight schedule over training time; its integral is the source's token demand. The records of a source
(repeated in rounds, each in another order) are laid out along its cumulative tokens; inverting the cumulative demand
gives each record's training position, and the records are range-sorted by it. Running sums are made in two steps (sums
of hash buckets, then within a bucket), so no source, however large, goes through one task; the number of a source's
buckets follows from the number of its records.

Defined results: null and blank texts have no tokens and are not used; records of unlisted sources are not used and
reported; a listed source without records gets nothing and is reported, and the others share its part; repeated ids are
used once a round; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Folder of the public vocabularies on the driver, which sends the one that is used to the executors.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pre-splitting pattern that belongs to the public byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Records of a hash bucket of a source's round, for running sums; bytes that a vocabulary file has at most.
IN_BUCKET, MOST_VOCABULARY = 4096, 1 << 26


def encoding(path: str):
    return _encoding(Path(path).read_bytes())


@lru_cache(maxsize=2)
def _encoding(raw: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: str, text_col: str, keep: list[str], tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``id_col``, the kept columns and ``n_tokens``; one row per id."""
    fields = [df.schema[c] for c in (id_col, *keep)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    raw = Path(tokenizers, vocabulary).read_bytes()
    if len(raw) > MOST_VOCABULARY:
        raise ValueError(f"a vocabulary of {len(raw)} bytes; at most {MOST_VOCABULARY} are sent to the executors")
    shared = df.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(shared.value)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"])

    texts = df.select(id_col, *keep, text_col).where(F.trim(F.col(text_col)) != "")
    return texts.mapInArrow(run, f"{schema}, n_tokens bigint").dropDuplicates([id_col])


def source_name(c: str | Column) -> Column:
    """One written form of a source: lower case, underscores, no blanks around."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")


def demand(sizes: DataFrame, targets: DataFrame, slopes: dict[str, float] | None = None, total_tokens: int | None = None) -> DataFrame:
    """One row per listed source: its tokens, its share among the sources that have records, its demand and schedule.

    ``total_tokens``: size of the mixture; by default the largest for which every source with records meets its share
    within its repeats. Both tables have one row per source.
    """
    tilt = F.lit(0.0)
    for name, s in (slopes or {}).items():
        tilt = F.when(F.col("source") == name, F.lit(float(s))).otherwise(tilt)
    t = targets.select(source_name("source").alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    d = t.join(sizes, "source", "left").fillna(0, ["tokens", "records"])
    everywhere = Window.partitionBy(F.lit(1))  # a handful of rows: one per source
    live = F.when((F.col("tokens") > 0) & (F.col("max_repeats") > 0), F.col("target_share")).otherwise(0.0)
    d = d.withColumn("share", live / F.sum(live).over(everywhere))
    most = F.min(F.when(F.col("share") > 0, F.col("tokens") * F.col("max_repeats") / F.col("share"))).over(everywhere)
    d = d.withColumn("total", F.coalesce(F.lit(total_tokens).cast("double"), most))
    d = d.withColumn("demand", F.least(F.col("total") * F.col("share"), F.col("tokens") * F.col("max_repeats").cast("double")))
    d = d.withColumn("tilt", tilt)
    # the tilts are balanced, so that the weights sum to one at every moment, and then drawn in together until none is
    # steeper than one, so that no weight falls below zero and the sum stays
    d = d.withColumn("tilt", F.col("tilt") - F.sum(F.col("tilt") * F.col("share")).over(everywhere))
    steepest = F.max(F.when(F.col("share") > 0, F.abs("tilt"))).over(everywhere)
    return d.withColumn("tilt", F.when(F.col("share") > 0, F.col("tilt") / F.greatest(F.lit(1.0), steepest)).otherwise(0.0))


def mixture(docs: DataFrame, plan: DataFrame, id_col: str, seed: int = 17) -> DataFrame:
    """``id_col, source, copy_no, n_tokens, position`` (0 to 1), range-sorted by position.

    ``docs``: id_col, source, n_tokens; ``plan``: the rows of ``demand``. Weight of a source at time t: share * (1 + tilt
    * (2t - 1)); its integral demand * (t + tilt * (t*t - t)) is inverted in closed form.
    """
    p = plan.where("demand > 0").select("source", "tokens", "demand", "tilt", F.greatest(F.lit(1), F.ceil(F.col("records") / IN_BUCKET)).cast("bigint").alias("buckets"))
    rows = docs.join(F.broadcast(p), "source")  # one row per source
    rounds = F.ceil(F.col("demand") / F.col("tokens")).cast("int")
    rows = rows.withColumn("copy_no", F.explode(F.sequence(F.lit(0), rounds - 1)))
    rows = rows.withColumn("h", F.xxhash64(id_col, F.col("copy_no") + F.lit(seed))).withColumn("bucket", F.pmod(F.shiftright("h", 20), F.col("buckets")))
    sums = rows.groupBy("source", "copy_no", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("copy_no", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))  # a row for IN_BUCKET records
    inside = Window.partitionBy("source", "copy_no", "bucket").orderBy("h", id_col).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    rows = rows.join(sums.select("source", "copy_no", "bucket", "before"), ["source", "copy_no", "bucket"])
    mid = F.col("before") + F.col("within") + F.col("n_tokens") / 2
    rows = rows.withColumn("u", mid / F.col("demand")).where("u <= 1")
    a = F.col("tilt")
    root = (-(1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * F.col("u"))) / (2 * a)
    rows = rows.withColumn("position", F.when(F.abs(a) < 1e-9, F.col("u")).otherwise(root))
    return rows.select(id_col, "source", "copy_no", "n_tokens", "position").orderBy("position", id_col, "copy_no")


def targets_met(share: DataFrame, plan: DataFrame, within: float = 0.02) -> DataFrame:
    """``source, met, repeats_kept`` of each listed source with a share: whether its actual share lies within ``within`` of its
    target among the sources with records, and whether no record is used more often than allowed."""
    p = plan.where("share > 0").select("source", F.col("share").alias("wanted"), "max_repeats")
    return p.join(share, "source").select("source", (F.abs(F.col("actual_share") - F.col("wanted")) <= within).alias("met"), (F.col("times_used") <= F.col("max_repeats")).alias("repeats_kept"))


def shares(mixed: DataFrame, plan: DataFrame, counted: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, tokens_used, records_used, times_used, tokens_available``: one row per listed
    source, and one per unlisted source with records (target 0)."""
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens_used"), F.count("*").alias("records_used"), (F.max("copy_no") + 1).alias("times_used"))
    all_sources = plan.select("source", "target_share").join(counted.select("source", F.col("tokens").alias("tokens_available")), "source", "full")
    out = all_sources.join(used, "source", "left").fillna(0, ["target_share", "tokens_used", "records_used", "times_used", "tokens_available"])
    total = F.sum("tokens_used").over(Window.partitionBy(F.lit(1)))
    return out.select("source", "target_share", F.when(total > 0, F.col("tokens_used") / total).otherwise(0.0).alias("actual_share"), "tokens_used", "records_used", "times_used", "tokens_available")
