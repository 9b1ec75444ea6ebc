"""Mapping free-entered values to a canonical list.

A BK-tree over the reference names, under the unrestricted Damerau-Levenshtein distance (a true metric: it satisfies the
triangle inequality, which the common restricted form does not), returns every entry within a threshold (``entries_within``);
the best one is taken (``map_values``). Which names there are, short forms included, is settled over the whole list; then it
is sharded by hash, each shard's tree is built once and travels as one row to the values that are searched in it, and the
winners of the shards are merged by (distance, name, id). Nothing is collected to the driver or broadcast.

Each distinct value is searched once. Several readings of a value are tried (without leading and trailing words that
belong to no name, with its words turned around at a comma, with separators removed); the cheapest wins.

Defined results: null, blank and unmatched values come out as ``UNMAPPED``; ties go to the smaller name, then id;
repeated ids give one result; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.runtime import cut_lineage, shuffle_parts

UNMAPPED = "UNMAPPED"
#: Reference names of one shard; a worker holds one shard at a time.
SHARD = 50_000

# Words around a name that are no part of it.
LEADING = frozenset("a an the some any his her my our their its this that home oral severe mild moderate worsening worse new old known possible probable suspected ongoing persistent topical iv generic brand high-dose low-dose".split())
TRAILING = frozenset(
    """nos hcl hydrochloride sodium potassium calcium tablets tablet tabs tab capsules capsule caps cap drops cream gel patch spray injection infusion solution syrup i.v. iv p.o. po i.m. s.c.
    i.v p.o i.m s.c mg mcg ug g ml daily bd tds prn stat today unspecified er xr sr cr oral topical left right sic stable""".split()
)
_SINCE = re.compile(r"\s+(?:since|for|after|before|during|in|on|at|from|last|this)\s.*$")
_DOSE = re.compile(r"\s*\b\d[\d.,]*\s*(?:mg|mcg|µg|ug|g|ml|iu|units?|%)?(?:/\w+)?\b")
# British and American spellings brought together.
SPELLING = (("haem", "hem"), ("oedem", "edem"), ("oesoph", "esoph"), ("anaem", "anem"), ("diarrhoea", "diarrhea"), ("leucocyt", "leukocyt"), ("tumour", "tumor"), ("paed", "ped"), ("caec", "cec"), ("foet", "fet"))


def plain(value: str) -> str:
    """Lower case, one blank between words, marks and typographic variants removed."""
    v = unicodedata.normalize("NFKC", value).lower()
    v = re.sub(r"[_/]+", " ", v)
    v = re.sub(r"[*?!.;:\"'()\[\]]+(?=\s|$)|(?<=\s)[*?!.;:\"'()\[\]]+|^[*?!.;:\"'()\[\]]+", " ", v)
    v = re.sub(r"\s+", " ", v).strip(" -,")
    for a, b in SPELLING:
        v = v.replace(a, b)
    return v


def readings(value: str) -> list[tuple[str, float]]:
    """The readings of a value, each with what it costs to take it."""
    v = plain(value)
    if not v:
        return []
    out: dict[str, float] = {}

    def add(x: str, cost: float) -> None:
        x = x.strip(" -,")
        if len(x) > 2 and cost < out.get(x, 9):
            out[x] = cost

    def variants(x: str, cost: float) -> None:
        add(x, cost)
        if "," in x:
            a, b = (y.strip() for y in x.split(",", 1))
            add(f"{b} {a}", cost + 0.01)
        if "-" in x:
            add(x.replace("-", " "), cost + 0.01)
            add(x.replace("-", ""), cost + 0.01)
        if " " in x:
            add(x.replace(" ", ""), cost + 0.5)

    variants(v, 0.0)
    cut = _DOSE.sub(" ", _SINCE.sub("", v))
    words = re.sub(r"\s+", " ", cut).strip(" -,").split(" ")
    while len(words) > 1 and words[-1].strip(".") in TRAILING or len(words) > 1 and words[-1] in TRAILING:
        words.pop()
    while len(words) > 1 and words[0] in LEADING:
        words.pop(0)
    variants(" ".join(words), 0.02)
    return list(out.items())


def distance(a: str, b: str, most: int) -> int:
    """Unrestricted Damerau-Levenshtein distance; any number above ``most`` may be returned as ``most + 1``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return max(len(a), len(b))
    n, big = len(b), len(a) + len(b)
    seen: dict[str, int] = {}
    rows = [[big] * (n + 2), [big, *range(n + 1)]]
    for i, x in enumerate(a, 1):
        row = [big, i] + [0] * n
        before = rows[i]
        match = 0
        for j in range(1, n + 1):
            y = b[j - 1]
            k = seen.get(y, 0)
            swap = rows[k][match] + (i - k - 1) + 1 + (j - match - 1)
            if x == y:
                cost = before[j]
                match = j
            else:
                cost = min(before[j], before[j + 1], row[j]) + 1
            row[j + 1] = swap if swap < cost else cost
        rows.append(row)
        seen[x] = i
        if min(row[1:]) > most + 1 and min(before[1:]) > most + 1:
            return most + 1
    return rows[-1][n + 1]


def letters(word: str) -> int:
    """The letters of a word as bits."""
    out = 0
    for c in set(word):
        out |= 1 << (ord(c) % 61)
    return out


def places(word: str) -> dict[str, int]:
    """Of each letter of a word its places as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(word):
        out[c] = out.get(c, 0) | 1 << i
    return out


def levenshtein(word: dict[str, int], n: int, name: str) -> int:
    """Levenshtein distance of a word (its ``places`` and length) and a name, all rows of a column at once as bits. It is at
    least the unrestricted Damerau-Levenshtein distance and at most twice that, as it makes two edits of a swap."""
    full = (1 << n) - 1
    top, up, down, score = 1 << (n - 1), full, 0, n
    get = word.get
    for c in name:
        same = get(c, 0)
        x = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(x | up)), up & x
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more, less = (more << 1) | 1, less << 1
        same |= down
        up, down = (less | ~(same | more)) & full, more & same & full
    return score


class BKTree:
    """Entries by their distance to an entry above; all within a radius are found by the triangle inequality."""

    def __init__(self, entries: list[tuple[str, str]] = ()):
        """entries: (name, id); equal names keep all their ids."""
        self.names: list[str] = []
        self.ids: dict[str, list[str]] = {}
        self.kids: list[dict[int, int]] = []
        self.known: dict[str, list[tuple[int, str]]] = {}
        for name, key in entries:
            if name in self.ids:
                self.ids[name].append(key)
                continue
            self.ids[name] = [key]
            at = 0
            while self.names:
                d = distance(name, self.names[at], 1 << 30)
                if d not in self.kids[at]:
                    self.kids[at][d] = len(self.names)
                    break
                at = self.kids[at][d]
            self.names.append(name)
            self.kids.append({})
        self._finish()

    def _finish(self) -> None:
        self.mask = [letters(n) for n in self.names]

    def rows(self) -> list[dict]:
        """The nodes in the order in which they came: name, ids, the node above and the distance to it."""
        above = {kid: (at, step) for at, kids in enumerate(self.kids) for step, kid in kids.items()}
        return [{"name": n, "ids": self.ids[n], "above": above.get(i, (-1, 0))[0], "step": above.get(i, (-1, 0))[1]} for i, n in enumerate(self.names)]

    @classmethod
    def of(cls, rows: list[dict]) -> BKTree:
        tree = cls()
        for i, r in enumerate(rows):
            tree.names.append(r["name"])
            tree.ids[r["name"]] = list(r["ids"])
            tree.kids.append({})
            if r["above"] >= 0:
                tree.kids[r["above"]][r["step"]] = i
        tree._finish()
        return tree

    def nearest(self, word: str, most: int) -> list[tuple[int, str]]:
        """All entries at the least distance that is at most ``most``; a small radius visits few nodes, so it is tried
        first. Many values share a reading, so the answers of a block are kept."""
        if word not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            found: list[tuple[int, str]] = []
            seen: dict[int, int] = {}
            for k in range(1, most + 1):
                found = self.within(word, k, seen)
                if found:
                    least = min(found)[0]
                    found = [f for f in found if f[0] == least]
                    break
            self.known[word] = found
        return [f for f in self.known[word] if f[0] <= most]

    def within(self, word: str, radius: int, seen: dict[int, int] | None = None) -> list[tuple[int, str]]:
        """All entries within a radius, as (distance, name).

        ``distance`` lies between half the Levenshtein distance and all of it; the cheaper one prunes, by the triangle
        inequality over that interval, and the true one decides on the entries that are left. ``seen``: Levenshtein
        distances of earlier searches for the word."""
        if word in self.ids and radius == 0:
            return [(0, word)]
        found: list[tuple[int, str]] = []
        if not self.names or not word:
            return [(0, word)] if word in self.ids else found
        seen = {} if seen is None else seen
        own, n, bits = letters(word), len(word), places(word)
        stack = [0]
        while stack:
            i = stack.pop()
            name, kids, other = self.names[i], self.kids[i], self.mask[i]
            near = abs(len(name) - n) <= radius and (own & ~other).bit_count() <= radius and (other & ~own).bit_count() <= radius
            if not kids and not near:
                continue  # an edit brings in or takes away one letter at most
            lev = seen.get(i)
            if lev is None:
                lev = seen[i] = levenshtein(bits, n, name)
            low, high = (lev + 1) // 2, lev
            if near and low <= radius:
                low = high = distance(word, name, 1 << 30)
                if low <= radius:
                    found.append((low, name))
            for step, kid in kids.items():
                if low - radius <= step <= high + radius:
                    stack.append(kid)
        return found


def radius(word: str) -> int:
    """Edits allowed for a name of this length."""
    n = len(word)
    return 0 if n < 4 else 1 if n < 7 else 2 if n < 12 else 3 if n < 22 else 4


def best(tree: BKTree, value: str) -> tuple[float, str, str] | None:
    """(cost, name, id) of the best entry for a value in this tree."""
    tries = sorted(readings(value), key=lambda r: r[1])
    hits = [(cost, word, min(tree.ids[word])) for word, cost in tries if word in tree.ids]
    top = min(hits, default=None)
    for word, cost in tries:
        room = radius(word)
        if top is not None:
            room = min(room, int(top[0] - cost) if top[0] > cost else -1)
        if room < 1:
            continue
        for d, name in tree.nearest(word, radius(word)):
            if d > room:
                continue
            got = (d + cost, name, min(tree.ids[name]))
            if top is None or got < top:
                top = got
    return top


def short_names(entries: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """``reference_names`` over a list in memory: the entries and their short forms."""
    full = {name for name, _ in entries}
    tails: dict[str, set[str]] = {}
    for name, key in entries:
        if name.count(" ") >= 2:
            tails.setdefault(name.split(" ", 1)[1], set()).add(key)
    return entries + [(t, next(iter(k))) for t, k in sorted(tails.items()) if len(k) == 1 and t not in full]


def all_within(tree: BKTree, value: str) -> list[tuple[float, str, str]]:
    """(cost, name, id) of every entry of this tree within the threshold of one of a value's readings, each by its cheapest."""
    out: dict[tuple[str, str], float] = {}
    for word, cost in readings(value):
        for d, name in tree.within(word, radius(word)):
            for key in tree.ids[name]:
                out[name, key] = min(out.get((name, key), 1e9), d + cost)
    return sorted((c, n, k) for (n, k), c in out.items())


def reference_names(reference: DataFrame, key_col: str, name_cols: list[str]) -> DataFrame:
    """``name, id``: the plain names of the whole list, and each name of three words or more without its first word, if that
    leaves a form of one entry only that is no name itself."""
    raw = reference.select(F.col(key_col).cast("string").alias("id"), F.explode(F.array(*name_cols)).alias("name")).where(F.col("name").isNotNull() & (F.trim("name") != ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([plain(n) for n in b.column(1).to_pylist()], pa.string())], names=["id", "name"])

    full = cut_lineage(raw.mapInArrow(run, "id string, name string").where("name <> ''").distinct()).select("name", "id")
    tail = full.where(F.size(F.split("name", " ")) >= 3).select(F.regexp_replace("name", "^[^ ]* ", "").alias("name"), "id")
    short = tail.groupBy("name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").select("name", "id")
    return full.unionByName(short.join(full, "name", "left_anti"))


_TREE = "array<struct<name:string,ids:array<string>,above:int,step:int>>"
_FOUND = pa.schema([("value", pa.string()), ("cost", pa.float64()), ("name", pa.string()), ("id", pa.string())])


def _search(values: DataFrame, value_col: str, reference: DataFrame, key_col: str, name_cols: list[str], look) -> DataFrame:
    """``value, cost, name, id``: what ``look`` (tree, value) finds for each distinct value in each shard of the reference.

    A shard of about SHARD names is one row with its tree; it is sent once to each share of the values, ahead of them, so a
    task holds one tree at a time and reads its values as they come."""
    names = cut_lineage(reference_names(reference, key_col, name_cols))
    shards = max(1, -(-names.count() // SHARD))
    parts = shuffle_parts(values.sparkSession)
    chunks = max(1, -(-parts // shards))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees = [BKTree([(e["name"], e["id"]) for e in entries]).rows() for entries in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees, pa.list_(pa.struct([("name", pa.string()), ("ids", pa.list_(pa.string())), ("above", pa.int32()), ("step", pa.int32())])))], names=["shard", "tree"])

    one = names.withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int")).groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("name", "id"))).alias("entries"))
    trees = cut_lineage(one.mapInArrow(build, f"shard int, tree {_TREE}")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    distinct = values.select(F.col(value_col).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()
    asked = distinct.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("chunk", F.pmod(F.xxhash64("value"), F.lit(chunks)).cast("int"))
    rows = trees.select("shard", "chunk", F.lit(None).cast("string").alias("value"), "tree").unionByName(asked.select("shard", "chunk", "value", F.lit(None).cast(_TREE).alias("tree")))
    dealt = rows.repartitionById(shards * chunks, (F.col("shard") * chunks + F.col("chunk")).cast("int")).sortWithinPartitions("shard", "chunk", F.col("tree").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = BKTree()
        for b in batches:
            out = []
            for v, t in zip(b.column(2).to_pylist(), b.column(3)):
                if v is None:
                    tree = BKTree.of(t.as_py())
                else:
                    out += [{"value": v, "cost": c, "name": n, "id": k} for c, n, k in look(tree, v)]
            yield pa.RecordBatch.from_pylist(out, _FOUND)

    return dealt.select("shard", "chunk", "value", "tree").mapInArrow(run, "value string, cost double, name string, id string")


def map_values(values: DataFrame, value_col: str, reference: DataFrame, key_col: str, name_cols: list[str]) -> DataFrame:
    """``value_col, matched_id, matched_name, cost`` for each distinct value: the best entry within the threshold.

    ``reference``: ``key_col`` and one or more name columns (nulls allowed)."""
    found = _search(values, value_col, reference, key_col, name_cols, lambda tree, v: [m] if (m := best(tree, v)) else [])
    win = found.groupBy("value").agg(F.min(F.struct("cost", "name", "id")).alias("w"))
    distinct = values.select(F.col(value_col).alias("value")).where(F.col("value").isNotNull()).distinct()
    return (
        distinct.join(win, "value", "left")
        .select(F.col("value").alias(value_col), F.coalesce("w.id", F.lit(UNMAPPED)).alias("matched_id"), F.coalesce("w.name", F.lit(UNMAPPED)).alias("matched_name"), F.col("w.cost").alias("cost"))
    )


def entries_within(values: DataFrame, value_col: str, reference: DataFrame, key_col: str, name_cols: list[str]) -> DataFrame:
    """``value_col, id, name, cost``: every entry within the threshold of each distinct value."""
    found = _search(values, value_col, reference, key_col, name_cols, all_within)
    return found.groupBy(F.col("value").alias(value_col), "id", "name").agg(F.min("cost").alias("cost"))
