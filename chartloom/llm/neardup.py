"""Near-duplicate records: an exact set-similarity join over word n-grams by a distributed prefix tree.

Every text becomes its set of n-gram hashes; equal sets form one class and are joined once. The n-grams have one global
order, rare ones first. In a prefix tree of all ordered sets, two sets of similarity t or more must share a node within
the first (1-t) share of their n-grams, so the tree's upper levels are spread over the cluster: one group per leading
n-gram. Within a group, subtrees are pruned before they are walked, by length, by position, and by a bound of the
remaining overlap that parity bitmaps of the sets give (a lower bound of their symmetric difference). The pairs left are
verified by walking a prefix tree of each probe's partners, sharing partial overlaps and pruning by remaining length.
No step drops, caps or samples: the result equals the brute-force join.

Frequencies: counted over all sets. The heaviest ``MOST_HEAVY`` n-grams (a fixed bound) are broadcast with their counts; of
n-grams that are equally heavy at the bound, those of the lowest hashes. The rest come before them in hash order, and each
counts as as heavy as the lightest of the heavy ones. A group of one n-gram with many sets is split into block pairs, so no
task holds more than two blocks of it. The number of parts follows from the number of postings.

Defined results: null, empty and short texts take part in no pair and get no class; repeated ids count once; exact copies
are one class; texts are processed whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from chartloom.llm.repetition import Hashes, mix
from chartloom.runtime import cut_lineage, shuffle_parts

WORD = re.compile(r"[^\W_]+")
#: N-grams whose counts are broadcast at most (16 bytes each), and counts from which they are told apart only roughly.
MOST_HEAVY, EXACT = 1 << 18, 65535
#: Postings of a part.
PART = 4_000_000
#: Sets of one n-gram's group at most before it is split into block pairs.
BLOCK = 8192
#: Bits of a set's parity bitmap: the first for sets of up to TIER n-grams, the next for twice as many, and so on.
BITS = (256, 512, 1024)
TIER = 150
#: N-grams that two similar sets must share among their leading ones (fewer where their whole overlap is smaller).
SHARED = 4
#: Counted n-grams held by a task before they are handed on.
HELD = 2_000_000
#: Partners per prefix tree of one probe, and shares into which a probe's partners are spread.
TREE, SPREAD = 400, 8
_ODD = [np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B185EBCA87), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)]


def gram_sets(df: DataFrame, id_col: str, text_col: str, words: int, least_words: int) -> DataFrame:
    """``id, sig, n, grams``: the sorted distinct n-gram hashes of each text (8 bytes each) and the hash of the set."""
    kind = df.schema[id_col].dataType.simpleString()
    vocab = Hashes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat: list[int] = []
            spans: list[tuple[int, int, int]] = []
            for i, t in enumerate(b.column(1).to_pylist()):
                w = WORD.findall(t.lower())
                if len(w) >= max(least_words, words):
                    spans.append((i, len(flat), len(flat) + len(w) - words + 1))
                    flat.extend([vocab[x] for x in w])
            if not spans:
                continue
            v = np.array(flat, np.uint64)
            h = v[: len(v) - words + 1] * _ODD[0]
            for k in range(1, words):
                h = mix(h) * _ODD[k % len(_ODD)] + v[k : len(v) - words + 1 + k]
            h = mix(h)
            sets = [np.unique(h[x:y]) for _, x, y in spans]
            raw = [s.tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array([s[0] for s in spans], pa.int64())),
                    pa.array(np.array([xxh64_intdigest(r) for r in raw], np.uint64).view(np.int64)),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(raw, pa.binary()),
                ],
                names=["id", "sig", "n", "grams"],
            )

    return df.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull()).mapInArrow(run, f"id {kind}, sig bigint, n int, grams binary")


def _counts(sets: DataFrame) -> DataFrame:
    """``h, c``: in how many sets each n-gram lies (equal sets of one block once), summed in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(h: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(h), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 200_000].view(np.int64)), pa.array(c[i : i + 200_000].astype(np.int64))], names=["h", "c"])

        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            sig = b.column(0).to_numpy(zero_copy_only=False)
            _, first = np.unique(sig, return_index=True)
            raw = b.column(1)
            for i in first.tolist():
                g = np.frombuffer(raw[i].as_buffer(), np.uint64)
                held.append(g)
                size += len(g)
                if size >= HELD:
                    yield from out(*np.unique(np.concatenate(held), return_counts=True))
                    held, size = [], 0
        if held:
            yield from out(*np.unique(np.concatenate(held), return_counts=True))

    parts = sets.select("sig", "grams").mapInArrow(run, "h bigint, c bigint")
    return parts.groupBy("h").agg(F.sum("c").alias("c")).where("c > 1")


class Order:
    """The global order of n-grams: those not among the heavy ones first, by hash; then the heavy ones by count and hash.
    A heavy n-gram is written as its rank (1 and up), any other as its hash with the top bit set."""

    def __init__(self, h: np.ndarray, c: np.ndarray, complete: bool, others: int = 1):
        by = np.argsort(h)
        self.h = h[by]
        up = np.lexsort((self.h, c[by]))
        self.rank = np.empty(len(h), np.uint32)
        self.rank[up] = np.arange(1, len(h) + 1)
        self.count = np.concatenate([[1], c[by][up]])  # by rank
        self.others = others  # how many sets an n-gram that is not heavy lies in at most
        self.complete = complete  # every n-gram of two sets is among the heavy ones: the others cannot be shared

    def split(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(other hashes, ranks) of a set, both in order."""
        if not len(self.h):
            return g, np.empty(0, np.uint32)
        at = np.searchsorted(self.h, g)
        at[at == len(self.h)] = 0
        hit = self.h[at] == g
        return g[~hit], np.sort(self.rank[at[hit]])


def global_order(sets: DataFrame) -> Order:
    counts = cut_lineage(_counts(sets))
    # exact counts up to EXACT, above it 64 steps for every doubling: some 70,000 levels at most
    level = F.when(F.col("c") <= EXACT, F.col("c")).otherwise(EXACT + F.floor(64 * F.log2(F.col("c") / EXACT)))
    steps = counts.groupBy(level.cast("bigint").alias("level")).agg(F.count("*").alias("k"), F.max("c").alias("top")).collect()
    room, cut, share, others = MOST_HEAVY, 1 << 62, 0, 1
    for level_, k, top in sorted(((r["level"], r["k"], r["top"]) for r in steps), reverse=True):
        others = top
        if k > room:  # of the level at the bound only a share of the hashes, a little less than there is room for
            share = int(1024 * 0.95 * room / k)
            break
        room, cut, others = room - k, level_, 1
    low = F.pmod(F.xxhash64("h"), F.lit(1024)) < share
    heavy = counts.where((level >= cut) | ((level == max((r["level"] for r in steps if r["level"] < cut), default=-1)) & low)).select("h", "c").toArrow()
    if heavy.num_rows > MOST_HEAVY:
        raise ValueError(f"{heavy.num_rows} heavy n-grams; at most {MOST_HEAVY} are sent")
    return Order(heavy.column("h").to_numpy().view(np.uint64), heavy.column("c").to_numpy(), others == 1, others)


def _thin(x: np.ndarray) -> bytes:
    """Rising numbers as their differences, byte planes apart, so that the storage's compression finds the zeros."""
    d = np.diff(x, prepend=x[:1] * 0)
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, d.itemsize).T).tobytes()


def _thick(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(raw, np.uint8).reshape(size, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(kind), dtype=kind)


def coded_sets(sets: DataFrame, order, kind: str) -> DataFrame:
    """``id, sig, n, ranks, rest``: each set in the global order; ``rest`` (n-grams that are not heavy) is left out where
    those cannot be shared. ``n`` counts all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = order.value
        for b in batches:
            parts = [by.split(np.frombuffer(x.as_buffer(), np.uint64)) for x in b.column(3)]
            ranks = pa.array([_thin(r) for _, r in parts], pa.binary())
            rest = pa.array([None if by.complete else _thin(np.sort(h | _TOP)) for h, _ in parts], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], ranks, rest], names=["id", "sig", "n", "ranks", "rest"])

    return sets.mapInArrow(run, f"id {kind}, sig bigint, n int, ranks binary, rest binary")


_TOP = np.uint64(1 << 63)


def _tokens(ranks: bytes, rest: bytes | None) -> np.ndarray:
    r = _thick(ranks, np.uint32).astype(np.uint64)
    return r if not rest else np.concatenate([_thick(rest, np.uint64), r])


def _fold(bitmap: np.ndarray) -> np.ndarray:
    """A parity bitmap of half the bits."""
    half = bitmap.shape[1] // 2
    return bitmap[:, :half] ^ bitmap[:, half:]


def _tier(n: np.ndarray) -> np.ndarray:
    return np.clip(np.ceil(np.log2(np.maximum(n, 1) / TIER)), 0, len(BITS) - 1).astype(np.int64)


def _postings(coded: DataFrame, order, share: float, parts: int) -> DataFrame:
    """``part, docs, posts``: for each part of the leading n-grams, the sets of a block (sig, sizes, bitmap) once and their
    postings (group, set, position), packed."""
    top = BITS[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = order.value
        for b in batches:
            sig = b.column(0).to_numpy(zero_copy_only=False)
            _, first = np.unique(sig, return_index=True)  # equal sets of the block are sent once
            sig = sig[first].view(np.uint64)
            n = b.column(1).to_numpy(zero_copy_only=False)[first].astype(np.int64)
            ranks, rest = b.column(2), b.column(3)
            gs = [_tokens(ranks[i].as_py(), rest[i].as_py()) for i in first.tolist()]
            m = np.array([len(g) for g in gs], np.int64)
            g = np.concatenate(gs) if gs else np.empty(0, np.uint64)
            doc = np.repeat(np.arange(len(gs)), m)
            bits = np.bincount(doc * top + (mix(g) >> np.uint64(13)).astype(np.int64) % top, minlength=len(gs) * top).astype(np.uint8) & 1
            bitmap = np.packbits(bits.reshape(len(gs), top), axis=1)
            pos = np.arange(len(g)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(n - m, m)
            probe = n - np.ceil(share * n - 1e-9).astype(np.int64) + SHARED
            keep = pos < probe[doc]
            g, doc, pos = g[keep], doc[keep], pos[keep]
            heavy = g < _TOP
            count = np.full(len(g), by_rank.others, np.int64)
            count[heavy] = by_rank.count[g[heavy].astype(np.int64)]
            # a hot n-gram: its sets fall into blocks, and every pair of blocks is a group of its own
            blocks = -(-count // BLOCK)
            own = (mix(sig)[doc] % np.maximum(blocks, 1).astype(np.uint64)).astype(np.int64)
            other = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            g, doc, pos, own, blocks = (np.repeat(x, blocks) for x in (g, doc, pos, own, blocks))
            split = blocks > 1
            key = np.where(split, mix(g + mix((np.minimum(own, other) * 1_000_003 + np.maximum(own, other) + 1).astype(np.uint64))) | _TOP, g)
            flags = (split & (own != other)).astype(np.uint8) + 2 * (split & (own > other)).astype(np.uint8)
            part = (mix(key) % np.uint64(parts)).astype(np.int64)
            by = np.lexsort((key, part))
            edges = np.searchsorted(part[by], np.arange(parts + 1))
            rows: tuple[list, list, list] = ([], [], [])
            for p in range(parts):
                sel = by[edges[p] : edges[p + 1]]
                if len(sel):
                    used, local = np.unique(doc[sel], return_inverse=True)
                    rows[0].append(p)
                    rows[1].append(_pack_docs(sig[used], n[used], m[used], bitmap[used]))
                    rows[2].append(_pack_posts(key[sel], local, pos[sel], flags[sel]))
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], names=["part", "docs", "posts"])

    return coded.select("sig", "n", "ranks", "rest").mapInArrow(run, "part int, docs binary, posts binary")


def _pack(*columns: bytes) -> bytes:
    body = [pa.compress(c, "zstd", asbytes=True) for c in columns]
    head = np.array([x for c, z in zip(columns, body) for x in (len(c), len(z))], np.int64)
    return len(columns).to_bytes(8, "little") + head.tobytes() + b"".join(body)


def _unpack(raw: bytes) -> list[bytes]:
    k = int.from_bytes(raw[:8], "little")
    head = np.frombuffer(raw, np.int64, 2 * k, 8)
    at, out = 8 + 16 * k, []
    for size, packed in head.reshape(k, 2).tolist():
        out.append(pa.decompress(raw[at : at + packed], size, "zstd", asbytes=True))
        at += packed
    return out


def _planes(x: np.ndarray, kind: type) -> bytes:
    x = x.astype(kind)
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplanes(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _pack_docs(sig, n, m, bitmap) -> bytes:
    tier, maps, b = _tier(n), [], bitmap
    for t in range(len(BITS) - 1, -1, -1):
        maps.append(b[tier == t].tobytes())
        b = _fold(b)
    return _pack(sig.tobytes(), _planes(n, np.uint32), _planes(m, np.uint32), *maps)


def _unpack_docs(raw: bytes) -> list[np.ndarray]:
    """sig, n, m and the bitmaps of every tier (zeros above a set's own)."""
    sig, n, m, *maps = _unpack(raw)
    sig, n, m = np.frombuffer(sig, np.uint64), _unplanes(n, np.uint32).astype(np.int64), _unplanes(m, np.uint32).astype(np.int64)
    tier, out = _tier(n), []
    above = None
    for t, body in zip(range(len(BITS) - 1, -1, -1), maps):
        b = np.zeros((len(n), BITS[t] // 8), np.uint8)
        b[tier == t] = np.frombuffer(body, np.uint8).reshape(-1, BITS[t] // 8)
        if above is not None:
            b[tier > t] = _fold(above)[tier > t]
        out.append(b)
        above = b
    return [sig, n, m, *out[::-1]]


def _pack_posts(key, doc, pos, flags) -> bytes:
    return _pack(_thin(key), _planes(doc, np.uint32), _planes(pos, np.uint32), flags.tobytes())


def _unpack_posts(raw: bytes) -> list[np.ndarray]:
    key, doc, pos, flags = _unpack(raw)
    return [_thick(key, np.uint64), _unplanes(doc, np.uint32).astype(np.int64), _unplanes(pos, np.uint32).astype(np.int64), np.frombuffer(flags, np.uint8)]


def pruned_pairs(docs: list[np.ndarray], posts: list[np.ndarray], share: float) -> tuple[np.ndarray, ...]:
    """(a, b, groups, need) of pairs of sets that meet in a group and survive the bounds by length, position and bitmap:
    in how many groups they meet, and the overlap that they need."""
    sig, n, size, *maps = docs
    key, doc, pos, flags = posts
    s, m, k = sig[doc], n[doc], size[doc]
    by = np.lexsort((s, m, key))
    key, doc, pos, flags, s, m, k = (x[by] for x in (key, doc, pos, flags, s, m, k))
    own = np.ones(len(key), bool)  # one posting per set and group; equal sets come from several blocks of rows
    own[1:] = (key[1:] != key[:-1]) | (s[1:] != s[:-1])
    key, doc, pos, flags, s, m, k = (x[own] for x in (key, doc, pos, flags, s, m, k))
    words = [np.ascontiguousarray(b).view(np.uint64) for b in maps]
    tier = _tier(n)[doc]
    early = pos < m - np.ceil(2 * share / (1 + share) * m - 1e-9).astype(np.int64) + SHARED
    last = np.searchsorted(key, key, side="right")
    act = np.flatnonzero(early & (np.arange(len(key)) + 1 < last))  # the smaller set leads with the n-gram early
    left, right, wanted = [], [], []
    d = 1
    while len(act):
        j = act + d
        ok = j < last[act]
        act, j = act[ok], j[ok]
        ok = m[act] >= share * m[j] - 1e-9  # sorted by size: the later ones are larger still
        act, j = act[ok], j[ok]
        if len(act):
            need = np.ceil(share / (1 + share) * (m[act] + m[j]) - 1e-9).astype(np.int64)
            fit = np.minimum(pos[act], pos[j]) + np.minimum(m[act] - pos[act], m[j] - pos[j]) >= need
            fit &= (flags[act] & 1 == 0) | ((flags[act] ^ flags[j]) & 2 > 0)
            a, c, need = act[fit], j[fit], need[fit]
            most = k[a] + k[c] - 2 * need
            level = np.minimum(tier[a], tier[c])
            good = np.zeros(len(a), bool)
            for t, w in enumerate(words):
                at = np.flatnonzero(level == t)
                if len(at):
                    good[at] = np.bitwise_count(w[doc[a[at]]] ^ w[doc[c[at]]]).sum(1) <= most[at]
            left.append(s[a[good]])
            right.append(s[c[good]])
            wanted.append(need[good])
        d += 1
    if not left or not sum(map(len, left)):
        none = np.empty(0, np.uint64)
        return none, none, np.empty(0, np.int64), np.empty(0, np.int64)
    a, c, need = np.concatenate(left), np.concatenate(right), np.concatenate(wanted)
    low, high = np.minimum(a, c), np.maximum(a, c)
    by = np.lexsort((high, low))
    low, high, need = low[by], high[by], need[by]
    new = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
    return low[new], high[new], np.diff(np.append(new, len(low))), need[new]


def _candidates(postings: DataFrame, share: float, parts: int) -> DataFrame:
    """``a, b`` (a < b as unsigned hashes): pairs that meet in enough groups of all parts together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, posts, base = [], [], 0
        for batch in batches:
            for x, y in zip(batch.column(1), batch.column(2)):
                d, p = _unpack_docs(x.as_py()), _unpack_posts(y.as_py())
                p[1] = p[1] + base
                base += len(d[0])
                docs.append(d)
                posts.append(p)
        if docs:
            found = pruned_pairs([np.concatenate(c) for c in zip(*docs)], [np.concatenate(c) for c in zip(*posts)], share)
            for i in range(0, len(found[0]), 200_000):
                a, b, groups, need = (c[i : i + 200_000] for c in found)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(groups.astype(np.int32)), pa.array(need.astype(np.int32))], names=["a", "b", "met", "need"])

    met = postings.repartitionById(parts, F.col("part")).mapInArrow(run, "a bigint, b bigint, met int, need int")
    return met.groupBy("a", "b").agg(F.sum("met").alias("met"), F.max("need").alias("need")).where(F.col("met") >= F.least(F.col("need"), F.lit(SHARED))).select("a", "b")


class PrefixTree:
    """Ordered sequences sharing their prefixes; edges hold runs of tokens. Each node knows the sizes of the sets below."""

    __slots__ = ("edge", "ends", "kids", "least", "most")

    def __init__(self, rows: list[tuple[tuple, int, int]], at: int = 0):
        """rows: (sequence, size of the set, name) sorted by sequence; all share their first ``at`` tokens."""
        self.least = min(r[1] for r in rows)
        self.most = max(len(r[0]) for r in rows)
        first, last = rows[0][0], rows[-1][0]
        to = at
        stop = min(len(first), len(last))
        while to < stop and first[to] == last[to]:
            to += 1
        self.edge = first[at:to]
        self.ends = [r[1:] for r in rows if len(r[0]) == to]
        self.kids = []
        i = len(self.ends)
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][0][to] == rows[i][0][to]:
                j += 1
            self.kids.append(PrefixTree(rows[i:j], to))
            i = j

    def walk(self, probe: frozenset, size: int, share: float, met: int, depth: int, out: list) -> None:
        for t in self.edge:
            if t in probe:
                met += 1
        depth += len(self.edge)
        if met + min(self.most - depth, len(probe) - met) < share / (1 + share) * (size + self.least) - 1e-9:
            return
        for n, name in self.ends:
            if met >= share / (1 + share) * (size + n) - 1e-9:
                out.append((name, met, n))
        for kid in self.kids:
            kid.walk(probe, size, share, met, depth, out)


def _verify(rows: DataFrame, share: float) -> DataFrame:
    """``a, b, met, n_a, n_b`` for rows ``a, b, kind, n, ranks, rest`` sorted by (a, kind): kind 0 is the probe's own set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe, size, at, partners = frozenset(), 0, None, []
        out: list[tuple] = []

        def flush() -> None:
            if partners:
                found: list = []
                partners.sort()
                PrefixTree(partners).walk(probe, size, share, 0, 0, found)
                out.extend((at, b, met, size, n) for b, met, n in found)
                partners.clear()

        for batch in batches:
            for a, b, kind, n, ranks, rest in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "kind", "n", "ranks", "rest"))):
                tokens = _tokens(ranks, rest).tolist()
                if kind == 0:
                    flush()
                    at, probe, size = a, frozenset(tokens), n
                else:
                    partners.append((tuple(tokens), n, b))
                    if len(partners) >= TREE:
                        flush()
            flush()
            cols = list(zip(*out)) or [[]] * 5
            out.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["a", "b", "met", "n_a", "n_b"])

    return rows.mapInArrow(run, "a bigint, b bigint, met int, n_a int, n_b int")


def similar_classes(df: DataFrame, id_col: str, text_col: str, words: int = 5, share: float = 0.8, least_words: int = 1) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: ``id, sig`` for each text that takes part; links: ``a, b, met, n_a, n_b, similarity``
    between the classes (sig) of different sets whose similarity is ``share`` or more, each pair once."""
    spark = df.sparkSession
    sets = gram_sets(df, id_col, text_col, words, least_words)  # made twice: to be counted, and to be written in order
    order = spark.sparkContext.broadcast(global_order(sets))
    coded = cut_lineage(coded_sets(sets, order, df.schema[id_col].dataType.simpleString()))
    postings = coded.select((F.col("n") - F.ceil(F.col("n") * share - 1e-9) + SHARED).alias("p")).agg(F.sum("p").alias("p")).first()["p"] or 0
    parts = shuffle_parts(spark, -(-int(postings) // PART))
    pairs = cut_lineage(_candidates(_postings(coded, order, share, parts), share, parts))
    used = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
    columns = ["n", "ranks", "rest"]
    full = cut_lineage(coded.join(used, "sig", "left_semi").groupBy("sig").agg(*[F.first(c).alias(c) for c in columns]))
    salt = F.pmod(F.xxhash64("b"), F.lit(SPREAD)).cast("int")
    partner = pairs.join(full.withColumnRenamed("sig", "b"), "b").select("a", "b", F.lit(1).alias("kind"), salt.alias("s"), *columns)
    heads = pairs.select("a", salt.alias("s")).distinct()
    probe = heads.join(full.withColumnRenamed("sig", "a"), "a").select("a", F.lit(None).cast("bigint").alias("b"), F.lit(0).alias("kind"), "s", *columns)
    rows = partner.unionByName(probe).repartition(parts, "a", "s").sortWithinPartitions("a", "s", "kind").select("a", "b", "kind", *columns)
    links = _verify(rows, share).withColumn("similarity", F.col("met") / (F.col("n_a") + F.col("n_b") - F.col("met")))
    return coded.select("id", "sig").distinct(), links


def similar_pairs(df: DataFrame, id_col: str, text_col: str, words: int = 5, share: float = 0.8, least_words: int = 1) -> DataFrame:
    """``id_a, id_b`` (id_a < id_b): all pairs of similar texts, those of equal sets included. ``similar_groups`` is the form
    for collections with large classes of copies: its result grows with the texts, not with their pairs."""
    members, links = similar_classes(df, id_col, text_col, words, share, least_words)
    left = members.select(F.col("id").alias("x"), F.col("sig").alias("a"))
    right = members.select(F.col("id").alias("y"), F.col("sig").alias("b"))
    across = links.select("a", "b").join(left, "a").join(right, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    many = members.groupBy("sig").count().where("count > 1").select("sig")
    copies = members.join(many, "sig", "left_semi")
    # a class of copies, however large, is paired by SPREAD tasks: each its share of the left members with all right ones
    left = copies.select(F.col("id").alias("id_a"), "sig", F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int").alias("s"))
    right = copies.select(F.col("id").alias("id_b"), "sig", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("s"))
    same = left.join(right, ["sig", "s"]).where("id_a < id_b").select("id_a", "id_b")
    return across.unionByName(same)


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``sig, label``: the least sig of each connected group. Labels spread along links and double their reach by
    following labels of labels; each round is written to the shared folder."""
    both = cut_lineage(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut_lineage(nodes.select("sig", F.col("sig").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("sig", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "sig"), "sig", "left").select("sig", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("mid"))
        jump = step.select(F.col("sig").alias("mid"), F.col("mid").alias("far"))
        new = cut_lineage(step.join(jump, "mid", "left").select("sig", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")))
        labels = new.select("sig", "label")
        if not new.where("old <> label").limit(1).count():
            return labels


def similar_groups(df: DataFrame, id_col: str, text_col: str, words: int = 5, share: float = 0.8, least_words: int = 1) -> DataFrame:
    """``id, class_id, group_id, n_links``: the class of equal sets and the group of linked classes of each text, named by
    the least id in them, and the number of other texts that it is similar to."""
    members, links = similar_classes(df, id_col, text_col, words, share, least_words)
    members, links = cut_lineage(members), cut_lineage(links)
    classes = members.groupBy("sig").agg(F.min("id").alias("class_id"), F.count("*").alias("size"))
    both = links.select("a", "b").union(links.select("b", "a"))
    outer = both.join(classes.select(F.col("sig").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("far")).withColumnRenamed("a", "sig")
    group = components(links, classes.select("sig")).join(classes, "sig")
    name = group.groupBy("label").agg(F.min("class_id").alias("group_id"))
    full = group.join(name, "label").join(outer, "sig", "left").select("sig", "class_id", "group_id", (F.col("size") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    return members.join(full, "sig").select("id", "class_id", "group_id", "n_links")
