"""Splitting oversized texts at natural boundaries, with overlap.

Boundary positions (paragraphs, sentences, lines, clauses, words, single characters) carry cut penalties; dynamic
programming over them finds the pieces with the least sum of penalties and size imbalance, no piece above the limit, and
each next piece beginning with about the wanted number of last characters of the one before.

Defined results: null and blank texts give no piece; a text within the limit gives itself; repeated ids give one result;
texts of any length are processed whole; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.sentences import segment

#: What a cut costs at each kind of boundary.
PARAGRAPH, SENTENCE, LINE, CLAUSE, WORD, CHARACTER = 0.0, 0.3, 0.6, 1.5, 3.0, 10.0
#: Weight of a piece's deviation from equal sizes.
BALANCE = 2.0
_CLAUSE = re.compile(r"[,;:、，；：](?:\s+|(?=[぀-鿿]))")
_SPACE = re.compile(r"\s+")


def boundaries(text: str, size: int, overlap: int) -> tuple[list[int], list[float]]:
    """Cut positions (where the next text begins) in order, and their penalties. Finer kinds are only added where the
    coarser ones lie too far apart."""
    cost: dict[int, float] = {}
    sents = segment(text)
    for (_, a), (b, _) in zip(sents, sents[1:]):
        gap = text[a:b]
        cost[b] = PARAGRAPH if gap.count("\n") > 1 else SENTENCE
    for m in re.finditer(r"\n\s*", text):
        if 0 < m.end() < len(text):
            cost.setdefault(m.end(), PARAGRAPH if m.group().count("\n") > 1 else LINE)
    reach = max(1, (size - overlap) // 3)

    def fill(pattern: re.Pattern, price: float) -> None:
        at = [0, *sorted(cost), len(text)]
        for a, b in zip(at, at[1:]):
            if b - a > reach:
                for m in pattern.finditer(text, a, b):
                    if a < m.end() < b:
                        cost.setdefault(m.end(), price)

    fill(_CLAUSE, CLAUSE)
    fill(_SPACE, WORD)
    at = [0, *sorted(cost), len(text)]
    step = max(1, reach // 4)
    for a, b in zip(at, at[1:]):
        if b - a > reach:
            for x in range(a + step, b, step):
                while x < b and (unicodedata.combining(text[x]) or text[x] in "‍️" or text[x - 1] == "‍" or unicodedata.category(text[x]) in ("Mc", "Mn")):
                    x += 1
                if x < b:
                    cost.setdefault(x, CHARACTER)
    where = sorted(cost)
    return where, [cost[x] for x in where]


def _restart(text: str, cut: int, overlap: int, floor: int) -> int:
    """Where the piece after a cut begins: about ``overlap`` characters before it, at the start of a word if one is near."""
    want = max(floor + 1, cut - overlap)
    best = None
    for m in _SPACE.finditer(text, max(floor + 1, want - 40), min(cut, want + 40)):
        if m.end() < cut and (best is None or abs(m.end() - want) < abs(best - want)):
            best = m.end()
    at = best if best is not None else want
    while at < cut and unicodedata.category(text[at]) in ("Mc", "Mn"):
        at += 1
    return at


def split_text(text: str, size: int = 1500, overlap: int = 150) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text``."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    n = len(text)
    if n <= size:
        return [(0, n)] if text.strip() else []
    cuts, price = boundaries(text, size, overlap)
    count = max(2, -(-(n - overlap) // max(1, size - overlap)))
    ideal = min(size, (n + overlap * (count - 1)) / count)
    # nodes: 0 = text start, i = after cuts[i - 1], last = text end
    ends = [0, *cuts, n]
    prices = [0.0, *price, 0.0]
    starts = [0] + [-1] * (len(ends) - 1)
    best = [0.0] + [float("inf")] * (len(ends) - 1)
    back = [0] * len(ends)
    for i in range(len(ends) - 1):
        if best[i] == float("inf"):
            continue
        if starts[i] < 0:
            starts[i] = _restart(text, ends[i], overlap, starts[back[i]])
        s = starts[i]
        for j in range(bisect_right(ends, ends[i]), bisect_left(ends, s + size + 1)):
            length = ends[j] - s
            c = best[i] + prices[j] + BALANCE * ((length - ideal) / ideal) ** 2
            if c < best[j]:
                best[j], back[j] = c, i
        # a node is left only once all nodes before it are done, so its best path, and with it its start, is settled
    out, j = [], len(ends) - 1
    if best[j] == float("inf"):
        return _plain(text, size, overlap)
    while j:
        i = back[j]
        out.append((starts[i], ends[j]))
        j = i
    out.reverse()
    return out if all(b - a <= size for a, b in out) else _plain(text, size, overlap)


def _plain(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces of full size, cut at single characters: the way out for texts with no place to cut within a piece's reach
    (``boundaries`` adds single characters, so that only runs of combining marks longer than a piece leave none)."""
    out, at = [], 0
    while at + size < len(text):
        out.append((at, at + size))
        at += size - overlap
    return [*out, (at, len(text))]


def split_oversized(df: DataFrame, id_col: str, text_col: str, size: int = 1500, overlap: int = 150, only_oversized: bool = True, with_text: bool = True) -> DataFrame:
    """``id_col, piece_no, piece_start, piece_end`` and, unless ``with_text`` is off, ``piece_text``: the pieces of each text
    (of more than ``size`` characters). Repeated ids are dropped by id; without texts only the places cross the network."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.list_(pa.struct([("piece_start", pa.int32()), ("piece_end", pa.int32())] + ([("piece_text", pa.string())] if with_text else [])))
        for b in batches:
            rows = [[{"piece_start": s, "piece_end": e} | ({"piece_text": t[s:e]} if with_text else {}) for s, e in split_text(t, size, overlap)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, struct)], names=["id", "pieces"])

    texts = df.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull())
    if only_oversized:
        texts = texts.where(F.length(text_col) > size)
    found = texts.mapInArrow(run, f"id {kind}, pieces array<struct<piece_start:int,piece_end:int{',piece_text:string' if with_text else ''}>>")
    one = found.groupBy("id").agg(F.first("pieces").alias("pieces"))
    return one.select(F.col("id").alias(id_col), F.posexplode("pieces").alias("piece_no", "p")).select(id_col, "piece_no", "p.*")
