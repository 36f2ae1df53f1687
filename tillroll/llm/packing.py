"""Best-fit packing of token sequences by exact complements.

The plan depends on how many pieces there are of each length, at most `capacity` numbers: it is made from
that table. Longest pieces first, the gap of a sequence is filled exactly by one, two or three lengths
whose sum it is, as often as their counts allow; what remains is placed best fit, longest first. A plan
is a list of patterns (lengths and how many sequences look so). Pieces are then numbered within their
length, and the number says which sequence and place a piece has.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.llm.scratch import stored
from tillroll.llm.token_ids import END_ID, default_tokenizer, encoder

CAPACITY = 1024
CELL_ROWS = 1000
MOST_CELLS = 65_536
MOST_BROADCAST_ROWS = 200_000


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones at the end, the first takes what is left over."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def _cut_pieces(path: str, capacity: int, also: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(path).encode_all
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                row, piece, start, length, ids = [], [], [], [], []
                for i, found in enumerate(encode_all(item.as_py() or "" for item in part.column(1))):
                    found += end
                    for k, (at, n) in enumerate(cut(len(found) // 4, capacity)):
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(n)
                        ids.append(found[4 * at : 4 * (at + n)])
                at_row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at_row), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
                    + [part.column(2 + k).take(at_row) for k in range(len(also))],
                    ["doc_id", "piece", "start", "length", "ids", *also],
                )

    return run


def token_pieces(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, also: Sequence[str] = ()
) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of every document, and the columns
    `also` of its row.

    The ids of the whole text and the end id. Only documents longer than capacity are cut. A null text
    counts as empty and is the end id alone; repeated rows and rows without doc_id are cut like others.
    """
    plain = docs.select("doc_id", "text", *also)
    kinds = {c: plain.schema[c].dataType.simpleString() for c in ("doc_id", *also)}
    return plain.mapInArrow(
        _cut_pieces(tokenizer or default_tokenizer(), capacity, also),
        ", ".join([f"doc_id {kinds['doc_id']}, piece int, start long, length long, ids binary", *[f"{c} {kinds[c]}" for c in also]]),
    )


class SumIndex:
    """Which free lengths add up to a sum: one, two or three of them.

    Pairs are listed by their sum, the longest first part first. A list is walked from its head: a pair that
    is used up, or whose first part is longer than may be asked for from now on, never comes back, so its place
    is passed for good. A triple is a free length and a pair of what is missing.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.free = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.free[length] = n
        lengths = np.array(sorted(counts), np.int64)
        high, low = (x.ravel() for x in np.meshgrid(lengths, lengths))
        here = (high >= low) & (high + low < capacity)
        high, low = high[here], low[here]
        order = np.lexsort((-high, high + low))
        self.high = high[order].tolist()
        ends = np.searchsorted((high + low)[order], np.arange(capacity + 2)).tolist()
        self.head, self.end = ends[:-1], ends[1:]
        self.lengths = sorted(counts, reverse=True)

    def single(self, total: int) -> tuple[int, ...] | None:
        return (total,) if self.free[total] else None

    def pair(self, total: int, most: int, kept: int = 0) -> tuple[int, ...] | None:
        """Two free lengths with this sum, the first as long as can be, beside one kept piece of a length.
        `most` may not rise from call to call unless a piece is kept."""
        free = self.free
        passed = not kept
        for place in range(self.head[total], self.end[total]):
            a = self.high[place]
            b = total - a
            if free[a] > (a == b) and free[b] and a <= most:
                if free[a] - (a == kept) > (a == b) and free[b] > (b == kept):
                    return a, b
                passed = False
            elif passed:
                self.head[total] = place + 1
        return None

    def triple(self, total: int, most: int) -> tuple[int, ...] | None:
        for first in self.lengths:
            if 3 * first < total:
                return None
            if first <= min(most, total - 2) and self.free[first]:
                rest = self.pair(total - first, first, kept=first)
                if rest:
                    return (first, *rest)
        return None

    def take(self, lengths: tuple[int, ...]) -> int:
        """Take as many of this combination as there are."""
        each = defaultdict(int)
        for x in lengths:
            each[x] += 1
        n = int(min(self.free[x] // k for x, k in each.items()))
        for x, k in each.items():
            self.free[x] -= n * k
        return n


def exact_plan(counts: dict[int, int], capacity: int, parts: int) -> list[tuple[tuple[int, ...], int]]:
    """Exact complements of up to `parts` lengths, longest pieces first, then best fit for what remains."""
    left = SumIndex(counts, capacity)
    patterns: list[tuple[tuple[int, ...], int]] = []
    if left.free[capacity]:
        patterns.append(((capacity,), left.take((capacity,))))
    for longest in left.lengths:
        gap = capacity - longest
        while left.free[longest] and gap:
            left.free[longest] -= 1  # the one whose gap is filled
            rest = left.single(gap)
            if rest is None and parts > 1:
                rest = left.pair(gap, longest)
            if rest is None and parts > 2:
                rest = left.triple(gap, longest)
            left.free[longest] += 1
            if rest is None:
                break
            patterns.append(((longest, *rest), left.take((longest, *rest))))
    return patterns + _best_fit({int(x): int(left.free[x]) for x in np.flatnonzero(left.free)}, capacity)


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[int, list[tuple[tuple[int, ...], int]]]:
    """(parts, plan): the plan of fewest sequences, and of how many lengths its complements are at most.

    Filling gaps with three pieces can use up short ones that other gaps need, so plans with combinations
    of up to three, two and one lengths are made; of equally good ones that with the most parts is taken.
    """
    tried = [(parts, exact_plan(counts, capacity, parts)) for parts in (3, 2, 1)]
    return min(tried, key=lambda x: sum(n for _, n in x[1]))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, number of sequences): patterns that use every counted piece."""
    return best_plan(counts, capacity)[1]


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the fullest sequence that still takes it; equal cases move together."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by gap
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            gap = min((g for g, held in open_.items() if g >= length and held), default=None)
            if gap is None:
                each = capacity // length
                whole, rest = divmod(n, each)
                if whole:
                    open_[capacity - each * length].append(((length,) * each, whole))
                if rest:
                    open_[capacity - rest * length].append(((length,) * rest, 1))
                break
            pattern, many = open_[gap].pop()
            used = min(n, many)
            if many > used:
                open_[gap].append((pattern, many - used))
            open_[gap - length].append(((*pattern, length), used))
            n -= used
    return [x for held in open_.values() for x in held]


def _places(patterns) -> list[tuple[int, int, int, int, int]]:
    """(length, from, to, sequence, offset): the pieces numbered from..to of a length lie at this offset,
    in sequences that count up from `sequence`."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, n in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], used[length] + n, sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset, so that every sequence is filled from 0 without a gap.

    pieces: doc_id, piece, length (1 to capacity) and any other columns. Null lengths, lengths out of
    range raise. Equal rows are pieces of their own; an empty table gives no rows. The driver sees one
    number per length. Columns sequence_id and offset of pieces are replaced.
    """
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    checked = F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(
        F.raise_error(F.lit(f"piece length out of 1 to {capacity}")).cast("long")
    )
    rows = stored(pieces.select(*own).withColumn("length", checked), "pieces")
    counts = {int(r["length"]): int(r["count"]) for r in rows.groupBy("length").count().collect()}
    places = _places(plan(counts, capacity))
    table = rows.sparkSession.createDataFrame(places, "length long, __from long, __to long, __sequence long, offset long")
    if len(places) <= MOST_BROADCAST_ROWS:  # of 40 bytes
        table = F.broadcast(table)

    cells = max(1, min(MOST_CELLS, sum(counts.values()) // CELL_ROWS))
    dealt = rows.withColumn("__cell", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(cells)))
    each = dealt.groupBy("length", "__cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select("length", "__cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__cell").orderBy("doc_id", "piece")
    numbered = dealt.withColumn("__row", F.row_number().over(within) - 1).join(offsets, ["length", "__cell"])
    numbered = numbered.withColumn("__n", F.col("__before") + F.col("__row"))
    return (
        numbered.join(table, "length")
        .where((F.col("__n") >= F.col("__from")) & (F.col("__n") < F.col("__to")))
        .select(*own, (F.col("__sequence") + F.col("__n") - F.col("__from")).alias("sequence_id"), "offset")
    )
