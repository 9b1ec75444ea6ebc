"""Evaluation passages that leak into training documents: a distributed positional inverted index of the training tokens.

The index is stored: blocks of documents, and for each term of a block the sorted list of its positions (``training_index``).
The test items are cut into shards; the posting lists of a shard's terms are brought together per (block, shard) by a join
on the term, salted by block, as common terms lie in every block. There the lists are intersected, offset by the term's
place in the passage and beginning with the list of the rarest term: a phrase of PHRASE neighbouring words stands where the
shifted lists agree. Rare phrases come first: those of an item without its commonest ones, which together cover fewer words
than must stand unaltered, so no document that holds an item can be without all of them. Only pairs of a document and an
item that share such a phrase are looked at with all phrases. Phrases whose shifted places agree (proximity, a few words of drift) are
joined to stretches; the words of the item that the stretches cover, and those met in them, decide. Items of fewer than
LEAST_STRETCH words are exact matches: all their lists must agree at one place.

Defined results: null or blank documents and passages match nothing; repeated ids give one result; an empty item table
gives an empty result; an item that many items resemble, or that is there several times, is found like any other; texts are
processed whole, and one text is never split over blocks; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.repetition import Hashes
from chartloom.runtime import cut_lineage, shuffle_parts

WORD = re.compile(r"[^\W_]+")
MARKUP = re.compile(r"<[/!?]?[a-zA-Z][^<>]*>|&(?:[a-zA-Z]{2,10}|#\d{1,6});")
HAN = re.compile(r"([぀-ヿ㐀-鿿])")
#: Words of one phrase whose shifted lists are intersected.
PHRASE = 3
#: Share of an item's words that must stand in the document, and of those that must stand unaltered.
LEAST_COVER, LEAST_EXACT = 0.5, 0.4
#: Share of the words inside the stretches, gaps included, that may be altered ("about a tenth").
MOST_ALTERED = 0.15
#: Words by which neighbouring phrases may drift apart, and words that may be altered between two of them.
DRIFT, GAP = 6, 4
#: Phrases of one stretch at least, and its words at least; shorter items must stand whole.
LEAST_RUN, LEAST_STRETCH = 4, 9
#: Places of phrases in items that are held at a time (more if a single document has more).
MOST_SPREAD = 2_000_000
#: Tokens of a block (more if a single document has more), and words of the items of one shard.
BLOCK_TOKENS, SHARD_WORDS = 1_000_000, 1 << 18
#: Copies of an item shard's terms over which the blocks of a common term are spread in a shuffled join.
SALTS = 64
#: Stands for the list of a block's documents; no term has this hash.
DOCUMENTS = 0


def tokens(text: str) -> list[str]:
    """Words in lower case without markup; each Chinese or Japanese character is a word."""
    if "<" in text or "&" in text:
        text = MARKUP.sub(" ", text)
    text = text.lower()
    if HAN.search(text):
        text = HAN.sub(r" \1 ", text)
    return WORD.findall(text)


def term_hashes(words: list[str], vocab: Hashes) -> np.ndarray:
    h = np.fromiter(map(vocab.__getitem__, words), np.uint64, len(words)).view(np.int64)
    return np.where(h == DOCUMENTS, 1, h)


def distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers of ``x``, in order."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


# ---------------------------------------------------------------- the stored index


def packed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, all but the last of a number marked; and how many bytes each takes."""
    size = np.ones(len(x), np.int64)
    for k in range(1, 5):
        size += x >= 1 << (7 * k)
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(x) else 0, np.uint8)
    for k in range(5):
        has = size > k
        if has.any():
            out[(end - size)[has] + k] = ((x[has] >> (7 * k)) & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, size


def unpacked(raw: np.ndarray) -> np.ndarray:
    end = np.flatnonzero(raw < 128)
    if not len(end):
        return np.empty(0, np.int64)
    first = np.concatenate([[0], end[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, end - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first)


def posting_lists(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(terms, counts, packed position lists) of one block. ``flat``: its terms, with PHRASE places of DOCUMENTS after each
    document; the first list is that of the documents' ends."""
    at = np.flatnonzero(flat != DOCUMENTS)
    order = np.argsort(flat[at], kind="stable")
    term, pos = flat[at][order], at[order]
    new = np.concatenate([[True], term[1:] != term[:-1]]) if len(term) else np.empty(0, bool)
    gap = pos.copy()
    gap[1:] = np.where(new[1:], pos[1:], pos[1:] - pos[:-1])
    gap = np.concatenate([np.diff(ends, prepend=0), gap])
    first = np.concatenate([[0], len(ends) + np.flatnonzero(new)])
    data, size = packed(gap)
    edges = np.concatenate([np.concatenate([[0], np.cumsum(size)])[first], [len(data)]]).astype(np.int64)
    lists = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(edges), pa.py_buffer(data)])
    return np.concatenate([[DOCUMENTS], term[new]]).astype(np.int64), np.diff(np.append(first, len(gap))), lists


def training_index(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``block, term, n, postings, ids``: one row per term of a block of documents, written by the task that read them; the
    row of DOCUMENTS has the ends of the block's documents and their ids."""
    kind = docs.schema[doc_id].dataType.simpleString()
    vocab = Hashes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        ids, flat, size, ends = [], [], 0, []

        def block(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            nonlocal name, size
            term, n, lists = posting_lists(np.concatenate(flat), np.array(ends))
            table = pa.table([pa.array(np.full(len(term), name)), pa.array(term), pa.array(n.astype(np.int32)), lists.cast(pa.binary())], ["block", "term", "n", "postings"])
            whose = pa.concat_arrays([pa.array([ids], pa.list_(id_type)), pa.nulls(len(term) - 1, pa.list_(id_type))])
            yield from table.append_column("ids", whose).to_batches(max_chunksize=20_000)
            name += 1
            size = 0
            for held in (ids, flat, ends):
                held.clear()

        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = tokens(t)
                if words:
                    flat += [term_hashes(words, vocab), np.full(PHRASE, DOCUMENTS)]
                    size += len(words) + PHRASE
                    ids.append(i)
                    ends.append(size)
                if size >= BLOCK_TOKENS:
                    yield from block(id_type)
        if ids:
            yield from block(id_type)

    return docs.select(F.col(doc_id), F.col(text)).where(F.col(text).isNotNull()).mapInArrow(run, f"block bigint, term bigint, n int, postings binary, ids array<{kind}>")


# ---------------------------------------------------------------- the test side


def item_places(items: DataFrame, item_id: str, passage: str) -> DataFrame:
    """``item, term, off, words``: each word of each passage."""
    kind = items.schema[item_id].dataType.simpleString()
    vocab = Hashes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = [term_hashes(tokens(t), vocab) for t in b.column(1).to_pylist()]
            n = [len(s) for s in seqs]
            which = np.repeat(np.arange(len(n)), n)
            off = np.concatenate([np.arange(k) for k in n]) if n else np.empty(0, int)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(which)), pa.array(np.concatenate(seqs) if n else np.empty(0, np.int64), pa.int64()), pa.array(off.astype(np.int32)), pa.array(np.repeat(n, n).astype(np.int32), pa.int32())],
                names=["item", "term", "off", "words"],
            )

    one = items.where(F.col(passage).isNotNull()).groupBy(item_id).agg(F.min(passage).alias("passage"))
    return one.select(item_id, "passage").mapInArrow(run, f"item {kind}, term bigint, off int, words int")


def item_terms(places: DataFrame, shards: int) -> DataFrame:
    """``term, shard, places``: where each term stands in the items of each shard; DOCUMENTS once for every shard."""
    shard = F.pmod(F.xxhash64("item"), F.lit(shards)).alias("shard")
    lists = places.select("*", shard).groupBy("term", "shard").agg(F.collect_list(F.struct("item", "off", "words")).alias("places"))  # at most a shard's words
    every = places.select(shard).distinct().select(F.lit(DOCUMENTS).cast("bigint").alias("term"), "shard", F.lit(None).cast(lists.schema["places"].dataType).alias("places"))
    return lists.unionByName(every)


class Shard:
    """The items of one shard as they can stand in one block: sequences of the block's terms (-2 for terms that the block
    does not have), and their phrases with the (item, offset) places of each."""

    def __init__(self, item: np.ndarray, off: np.ndarray, words: np.ndarray, term: np.ndarray, count: np.ndarray):
        k = int(item.max()) + 1 if len(item) else 0
        self.length = np.zeros(k, np.int64)
        self.length[item] = words
        self.first = np.cumsum(self.length) - self.length
        self.flat = np.full(int(self.length.sum()), -2, np.int64)
        self.flat[self.first[item] + off] = term
        owner = np.repeat(np.arange(k), self.length)
        place = np.arange(len(self.flat)) - np.repeat(self.first, self.length)
        ok = (place + PHRASE <= self.length[owner]) & (self.length[owner] >= LEAST_STRETCH)
        at = np.flatnonzero(ok)
        parts = np.stack([self.flat[at + j] for j in range(PHRASE)]) if len(at) else np.empty((PHRASE, 0), np.int64)
        here = (parts >= 0).all(0)
        at, parts = at[here], parts[:, here]
        base = len(count) + 1
        key = np.zeros(len(at), np.int64)
        for p in parts:  # at most SHARD_WORDS terms: three of them fit into 64 bits
            key = key * base + p
        by = np.argsort(key, kind="stable")
        _, lead, self.reps = np.unique(key[by], return_index=True, return_counts=True)
        self.head = lead  # of each phrase, its first place among item and off
        self.item, self.off = owner[at][by], place[at][by]
        self.terms = parts[:, by][:, lead]
        self.rarest = np.argmin(count[self.terms], axis=0) if len(lead) else np.empty(0, np.int64)

    def rare(self, hits: np.ndarray) -> np.ndarray:
        """For each place of a phrase in an item whether the phrase is one of the item's rare ones, given how often each
        phrase stands in the block: all but the commonest that together cover fewer than LEAST_EXACT of the item's words."""
        often = np.repeat(hits, self.reps)
        rare = np.ones(len(often), bool)
        by = np.lexsort((-often, self.item))
        edges = np.searchsorted(self.item[by], np.arange(len(self.length) + 1))
        offs = self.off[by].tolist()
        for i in np.flatnonzero(np.diff(edges)).tolist():
            need, seen = LEAST_EXACT * int(self.length[i]), set()
            for j in range(edges[i], edges[i + 1]):
                seen.update(range(offs[j], offs[j] + PHRASE))
                if len(seen) >= need:
                    break
                rare[by[j]] = False
        return rare

    def seq(self, i: int) -> np.ndarray:
        return self.flat[self.first[i] : self.first[i] + self.length[i]]


class Block:
    """The posting lists of one block that a shard asked for."""

    def __init__(self, count: np.ndarray, raw: np.ndarray, ends: np.ndarray):
        gap = unpacked(raw)
        self.count, self.head, self.ends = count, np.cumsum(count) - count, ends
        total = np.cumsum(gap)
        self.pos = (total - np.repeat((total - gap)[self.head], count)).astype(np.int32) if len(gap) else gap.astype(np.int32)
        #: The lists laid out by position: one look tells whether a shifted place is in another list.
        self.words = np.full(int(ends[-1]) + PHRASE if len(ends) else PHRASE, -1, np.int32)
        self.words[self.pos] = np.repeat(np.arange(len(count), dtype=np.int32), count)

    def intersect(self, terms: np.ndarray, rarest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, phrase), by position, of the places where the shifted lists of a phrase's terms agree: the places of
        its rarest list that the other two hold as well."""
        where, which = [], []
        lead = terms[rarest, np.arange(terms.shape[1])]
        todo = self.count[lead]
        cuts = np.flatnonzero(np.diff(np.cumsum(todo) // MOST_SPREAD)) + 1
        for part in np.split(np.arange(len(lead)), cuts):
            n = todo[part]
            p = np.repeat(part, n)
            at = self.pos[np.repeat(self.head[lead[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())] - rarest[p]
            ok = at >= 0
            at, p = at[ok], p[ok]
            for step in range(1, PHRASE):
                j = (rarest[p] + step) % PHRASE
                ok = self.words[at + j] == terms[j, p]
                at, p = at[ok], p[ok]
            where.append(at)
            which.append(p)
        if not where:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, p = np.concatenate(where), np.concatenate(which)
        by = np.argsort(at, kind="stable")
        return at[by], p[by]

    def whole(self, seq: np.ndarray) -> np.ndarray:
        """The places where all words of ``seq`` stand one after another, by the lists from the rarest on."""
        if (seq < 0).any():
            return np.empty(0, np.int64)
        order = np.argsort(self.count[seq], kind="stable")
        t = seq[order[0]]
        at = self.pos[self.head[t] : self.head[t] + self.count[t]] - order[0]
        at = at[(at >= 0) & (at + len(seq) <= len(self.words))]
        for j in order[1:]:
            at = at[self.words[at + j] == seq[j]]
        return at


def matches(block: Block, shard: Shard) -> list[tuple[int, int, float]]:
    """(document, item, share of the item's words) of one block and one shard of items."""
    out: list[tuple[int, int, float]] = []
    k = len(shard.length)
    for i in np.flatnonzero((shard.length > 0) & (shard.length < LEAST_STRETCH)).tolist():
        at = block.whole(shard.seq(i))
        out += [(d, i, 1.0) for d in np.unique(np.searchsorted(block.ends, at, side="right")).tolist()]
    at, p = block.intersect(shard.terms, shard.rarest)
    if not len(at):
        return out
    doc = np.searchsorted(block.ends, at, side="right")
    rare = shard.rare(np.bincount(p, minlength=len(shard.reps)))

    def spread(p: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each hit its places in items: (index of the hit, index of the place)."""
        n = reps[p]
        return np.repeat(np.arange(len(p)), n), np.repeat((np.cumsum(reps) - reps)[p] - (np.cumsum(n) - n), n) + np.arange(n.sum())

    of_rare, reps = shard.item[rare], np.add.reduceat(rare.astype(np.int64), shard.head)
    wanted: list[np.ndarray] = []
    for x, y in parts(doc, reps[p]):
        hit, place = spread(p[x:y], reps)
        wanted.append(distinct(doc[x:y][hit] * k + of_rare[place]))
    pairs = distinct(np.concatenate(wanted)) if wanted else np.empty(0, np.int64)
    if not len(pairs):
        return out
    mask = np.zeros(len(block.ends), bool)
    mask[pairs // k] = True
    own = mask[doc]
    at, p, doc = at[own], p[own], doc[own]
    for x, y in parts(doc, shard.reps[p]):
        hit, place = spread(p[x:y], shard.reps)
        pair = doc[x:y][hit] * k + shard.item[place]
        slot = np.searchsorted(pairs, pair)
        sel = pairs[np.minimum(slot, len(pairs) - 1)] == pair
        pair, off, a = pair[sel], shard.off[place[sel]], at[x:y][hit[sel]]
        order = np.lexsort((a, a - off, pair))
        pair, off, a = pair[order], off[order], a[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (np.diff(a - off) > DRIFT)
        run = np.cumsum(new) - 1
        sel = (np.bincount(run) >= LEAST_RUN)[run] if len(run) else new  # shorter runs count in no stretch
        pair, off, a, run = pair[sel], off[sel], a[sel], run[sel]
        sel = np.isin(pair, may_hold(shard.length, pair, off))
        pair, off, a, run = pair[sel], off[sel], a[sel], run[sel]
        cut = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1], [True]])) if len(pair) else np.zeros(1, int)
        for u, v in zip(cut[:-1], cut[1:]):
            d, i = divmod(int(pair[u]), k)
            n = int(shard.length[i])
            covered, exact, met = stretches(off[u:v], a[u:v], run[u:v], shard.seq(i), block.words)
            if covered >= LEAST_COVER * n and exact >= LEAST_EXACT * n and met >= (1 - MOST_ALTERED) * covered:
                out.append((d, i, covered / n))
    return out


def parts(doc: np.ndarray, count: np.ndarray) -> list[tuple[int, int]]:
    """Neighbouring places of whole documents, with about MOST_SPREAD (item, offset) places in all their phrases."""
    if not len(doc):
        return []
    heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    group = (np.cumsum(np.add.reduceat(count, heads)) - 1) // MOST_SPREAD
    cuts = heads[np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))].tolist()
    return list(zip(cuts, [*cuts[1:], len(doc)]))


def may_hold(length: np.ndarray, pair: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The (document, item) pairs whose phrases, over all runs together, cover LEAST_EXACT of the item's words.

    The words that ``stretches`` counts as met are covered by some of these phrases, so no pair that it accepts is lost.
    """
    if not len(pair):
        return pair
    wide = int(length.max()) + PHRASE
    key = distinct(pair * wide + off)
    pair, off = key // wide, key % wide
    first = np.ones(len(pair), bool)
    first[1:] = pair[1:] != pair[:-1]
    words = np.full(len(pair), PHRASE, np.int64)
    words[1:] = np.where(first[1:], PHRASE, np.minimum(PHRASE, np.diff(off)))
    heads = np.flatnonzero(first)
    return pair[heads][np.add.reduceat(words, heads) >= LEAST_EXACT * length[pair[heads] % len(length)]]


def stretches(off: np.ndarray, at: np.ndarray, run: np.ndarray, item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Words of the item that lie in its stretches (small altered gaps included), those met in whole phrases, and those met
    at all, where a word in a gap may stand at the shift of either neighbouring phrase."""
    n = len(item)
    exact, inside, met = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    for r in distinct(run):
        sel = run == r
        o, p = off[sel], at[sel]
        k = np.lexsort((o, p))
        o, p = o[k], p[k]
        new = (np.diff(o) > PHRASE + GAP) | (np.diff(o) <= 0) | (np.diff(p) > PHRASE + GAP + DRIFT)
        for s in np.split(np.arange(len(o)), np.flatnonzero(new) + 1):
            a, b = int(o[s[0]]), int(o[s[-1]]) + PHRASE
            if len(s) < LEAST_RUN or b - a < LEAST_STRETCH:
                continue
            inside[a:b] = True
            exact[(o[s][:, None] + np.arange(PHRASE)).ravel()] = True
            place = np.arange(a, b)
            k = np.searchsorted(o[s], place, side="right") - 1
            for shift in (p - o)[s][k], (p - o)[s][np.minimum(k + 1, len(s) - 1)]:
                met[a:b] |= words[np.clip(place + shift, 0, len(words) - 1)] == item[a:b]
    return int(inside.sum()), int(exact.sum()), int((met | exact).sum())


# ---------------------------------------------------------------- the query


def _searched(lists: DataFrame, id_kind: str, item_kind: str) -> DataFrame:
    """``doc_id, item_id, cover`` from the lists of all (block, shard), each in one piece."""

    def group(table: pa.Table) -> pa.RecordBatch | None:
        table = table.combine_chunks()
        head = np.flatnonzero(table.column("term").to_numpy() == DOCUMENTS)
        if len(head) != 1:
            raise ValueError(f"a block with {len(head)} lists of documents")
        if table.num_rows == 1:
            return None
        h = int(head[0])
        ends, ids = np.cumsum(unpacked(np.frombuffer(table.column("postings")[h].as_buffer(), np.uint8))), table.column("ids")[h].values
        rest = pa.concat_tables([table.slice(0, h), table.slice(h + 1)]).combine_chunks()
        lists, places = rest.column("postings").chunk(0), rest.column("places").chunk(0)
        size = pc.binary_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        buffers = lists.buffers()
        begin = int(np.frombuffer(buffers[1], np.int32, 1, 4 * lists.offset)[0])
        block = Block(rest.column("n").to_numpy().astype(np.int64), np.frombuffer(buffers[2], np.uint8, int(size.sum()), begin), ends)
        flat = places.flatten()
        code = flat.field(0).dictionary_encode()
        term = np.repeat(np.arange(rest.num_rows), pc.list_value_length(places).to_numpy(zero_copy_only=False))
        shard = Shard(code.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(2).to_numpy(zero_copy_only=False), term, block.count)
        found = matches(block, shard)
        if not found:
            return None
        d, i, cover = zip(*found)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(d)), code.dictionary.take(pa.array(i)), pa.array(cover, pa.float64())], names=["doc_id", "item_id", "cover"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for b in batches:
            key = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()])
            cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [b.num_rows]])
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if y > x:
                    if at is not None and tuple(key[:, x]) != at and (found := group(pa.Table.from_batches(held))):
                        yield found
                    if tuple(key[:, x]) != at:
                        held = []
                    at = tuple(key[:, x])
                    held.append(b.slice(x, y - x))
        if held and (found := group(pa.Table.from_batches(held))):
            yield found

    return lists.mapInArrow(run, f"doc_id {id_kind}, item_id {item_kind}, cover double")


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """``doc_id``, ``item_id``, ``cover``: documents that hold an item's passage, fully or in good part."""
    spark = docs.sparkSession
    places = cut_lineage(item_places(items, item_id, passage))
    shards = max(1, -(-places.count() // SHARD_WORDS))
    terms = item_terms(places, shards)
    index = cut_lineage(training_index(docs, doc_id, text))
    if shards == 1:  # at most SHARD_WORDS places of terms
        met = index.join(F.broadcast(terms), "term")
    else:
        copies = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = index.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int")).join(copies, ["term", "salt"])
    lists = met.select("block", "shard", "term", "n", "postings", "ids", "places").repartition(shuffle_parts(spark), "block", "shard").sortWithinPartitions("block", "shard")
    found = _searched(lists, docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString())
    return found.groupBy("doc_id", "item_id").agg(F.max("cover").alias("cover"))
