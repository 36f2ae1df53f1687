"""Packing token sequences by the length histogram, shortest pack first.

A document's ids are cut where a sequence is full; what remains, shorter than a sequence, is planned from
the histogram of lengths alone. Longest lengths first, each goes into the shortest pack that has room, and
a new pack is begun only if none has; equal packs are one pattern with a count, so a step moves a whole
pattern. Documents may be cut, so no gap has to stay: as many of the shortest packs as the gaps are worth
are taken apart and their pieces, cut to measure, fill the gaps of the others. What is left over of the
last pack is dealt to sequences whose lengths are powers of two, which are not padded either.

Every piece is ranked within its length; the plan says for each length which ranks lie in which sequences.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.llm.scratch import stored
from tillroll.llm.token_ids import default_tokenizer, encoder

CAPACITY = 1024
END_ID = 0
_RANKS = 1 << 40  # more pieces of one length than any corpus has
_TASKS = 1 << 40

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, how many in a pack), ...), number of packs


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Packs for so many pieces of each length: longest first, each into the shortest pack with room.

    A length splits one pattern at most and begins two, so there are at most 3 * capacity of them, each of
    at most sqrt(2 * capacity) different lengths.
    """
    by_fill: dict[int, list[Pattern]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            fill = next((f for f in range(1, capacity - length + 1) if by_fill.get(f)), None)
            if fill is None:  # no pack has room
                each = capacity // length
                whole, rest = divmod(n, each)
                if whole:
                    by_fill[each * length].append((((length, each),), whole))
                if rest:
                    by_fill[rest * length].append((((length, rest),), 1))
                break
            held, many = by_fill[fill].pop()
            used = min(n, many)
            if many > used:
                by_fill[fill].append((held, many - used))
            last, times = held[-1]
            more = (*held[:-1], (length, times + 1)) if last == length else (*held, (length, 1))
            by_fill[fill + length].append((more, used))
            n -= used
    return [p for fill in sorted(by_fill) for p in by_fill[fill]]


class Layout(NamedTuple):
    """Where the pieces of each length are, by their rank. The tables grow with the capacity only.

    pieces: length, from, per, sequence, offset, ascending; the pieces ranked `from` on (up to the next
    row) are `per` to a sequence, side by side from `offset` on. Those with per 0 are cut: they lie end to
    end on a line, from place `sequence` on.
    gaps: line, size, sequence, offset, ascending; gaps of this size lie on the same line from place
    `line` on, one in each sequence from `sequence` on. A piece is in the gaps that it lies over.
    """

    pieces: np.ndarray
    gaps: np.ndarray


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Layout:
    """The layout of so many pieces of each length, without a padded sequence."""
    used: dict[int, int] = defaultdict(int)
    open_, sequence = [], 0  # packs: fill, how many, first sequence, [(length, from, per, offset)]
    for held, packs in patterns(counts, capacity):
        fill, inside = 0, []
        for length, per in held:
            inside.append((length, used[length], per, fill))
            used[length] += packs * per
            fill += length * per
        open_.append((fill, packs, sequence, inside))
        sequence += packs
    open_.sort(key=lambda x: -x[0])

    pieces, gaps, on_line, line = [], [], 0, 0
    missing = sum((capacity - fill) * packs for fill, packs, _, _ in open_)
    while missing > 0:
        fill, packs, at, inside = open_.pop()  # the shortest
        apart = min(packs, -(-missing // capacity))
        missing -= capacity * apart
        if packs > apart:
            open_.append((fill, packs - apart, at + apart, [(n, first + apart * per, per, o) for n, first, per, o in inside]))
        for length, first, per, _ in inside:
            pieces.append((length, first, 0, on_line, 0))
            on_line += apart * per * length
    for fill, packs, at, inside in open_:
        pieces += [(length, first, per, at, offset) for length, first, per, offset in inside]
        if fill < capacity:
            gaps.append((line, capacity - fill, at, fill))
            line += (capacity - fill) * packs
    over = on_line - line
    for size in (1 << k for k in reversed(range(over.bit_length()))):
        if over & size:
            gaps.append((line, size, sequence, 0))
            line += size
            sequence += 1
    return Layout(np.array(sorted(pieces), np.int64).reshape(-1, 5), np.array(gaps, np.int64).reshape(-1, 4))


def places(layout: Layout, length: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(piece, from, size, sequence, offset) of the slices of pieces with these lengths and ranks."""
    spots = layout.pieces[:, 0] * _RANKS + layout.pieces[:, 1]
    here = layout.pieces[np.searchsorted(spots, length * _RANKS + rank, "right") - 1]
    place, per = rank - here[:, 1], here[:, 2]
    whole = np.flatnonzero(per)
    each, size = per[whole], length[whole]
    yield whole, np.zeros_like(size), size, here[whole, 3] + place[whole] // each, here[whole, 4] + place[whole] % each * size
    at = np.flatnonzero(per == 0)
    start = here[at, 3] + place[at] * length[at]
    cut = np.zeros_like(at)
    while len(at):
        gap = layout.gaps[np.searchsorted(layout.gaps[:, 0], start + cut, "right") - 1]
        behind = start + cut - gap[:, 0]
        size = np.minimum(gap[:, 1] - behind % gap[:, 1], length[at] - cut)
        yield at, cut, size, gap[:, 2] + behind // gap[:, 1], gap[:, 3] + behind % gap[:, 1]
        on = cut + size < length[at]
        at, start, cut = at[on], start[on], (cut + size)[on]


def _cut_pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        width = 2 if encode.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        end, task, nr = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        seen = [0] * (capacity + 1)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                row, start, length, crc, total, rank, ids = [], [], [], [], [], [], []
                for i, found in enumerate(encode.encode_all(item.as_py() or "" for item in part.column(1))):
                    found += end
                    whole = len(found) // 4
                    for at in range(0, whole, capacity):
                        raw = found[4 * at : 4 * (at + capacity)]
                        n = len(raw) // 4
                        row.append(i)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(raw))
                        total.append(whole)
                        rank.append(seen[n])
                        seen[n] += 1
                        ids.append(None if n == capacity else np.frombuffer(raw, "<u4").astype(f"<u{width}").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(row), task, np.int32)),
                        pa.array(np.arange(nr, nr + len(row))),
                        part.column(0).take(pa.array(row, pa.int64())),
                        *[pa.array(x, pa.int64()) for x in (start, length, crc, total, rank)],
                        pa.array(ids, pa.binary()),
                    ],
                    ["task", "nr", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "ids"],
                )
                nr += len(row)

    return run


def _place(layout):
    """Slices of the pieces task, nr, doc_id, start, length, ids_crc32, doc_tokens, rank (within the length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(4).to_numpy(), batch.column(7).to_numpy()
            for at, first, size, sequence, offset in places(layout.value, length, rank):
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[own.column(k) for k in range(3)],
                        pa.array(own.column(3).to_numpy() + first),
                        pa.array(size),
                        *[own.column(k) for k in (5, 6)],
                        *[pa.array(x) for x in (sequence, offset, first, size < length[at])],
                    ],
                    _SLICES,
                )

    return run


_SLICES = ["task", "nr", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "from", "cut"]


def _slice_crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, start, length, doc_tokens, sequence_id, offset, from, whole, ids with the slices' own ids_crc32."""
    for batch in batches:
        crc = []
        for first, n, whole, ids in zip(*[batch.column(k).to_pylist() for k in (6, 2, 7, 8)]):
            width = len(ids) // whole
            own = np.frombuffer(ids, f"<u{width}", n, first * width)
            crc.append(zlib.crc32(own.astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(k) for k in range(3)], pa.array(crc, pa.int64()), *[batch.column(k) for k in (3, 4, 5)]],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Pieces of all documents, dealt to sequences of at most `capacity` ids.

    Returns doc_id, start (ids of the document before the piece), length, ids_crc32 (of little-endian
    unsigned 32-bit ids), doc_tokens (ids of the document with its end id), sequence_id, offset (place in
    the sequence, gapless from 0). Each id of the whole text and the end id is in one piece. All sequences
    hold `capacity` ids or a power of two (at most one of each), so nothing is padded. A negative
    sequence_id is a sequence of one whole piece.

    Nulls: a null text counts as empty and is the end id alone; rows without doc_id are packed like others,
    repeated rows are documents of their own. An empty table gives no rows. Columns other than doc_id and
    text are not read. capacity must be a power of two of at most 4,096 (ValueError).

    The driver sees one number per length. The layout that goes to the tasks grows with the capacity
    only: at most 3 patterns a length and 45 rows of 40 bytes a pattern, 6 MB for 1,024. Pieces of a length are ranked by the task that cut them
    and the place there, so no task sorts them.
    """
    if capacity & (capacity - 1) or not 0 < capacity <= 4096:
        raise ValueError("capacity must be a power of two of at most 4096")
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").mapInArrow(
        _cut_pieces(tokenizer or default_tokenizer(), capacity, end_id),
        f"task int, nr long, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, rank long, ids binary",
    )
    rows = stored(made, "cut-pieces")
    shorter = rows.where(F.col("length") < capacity)
    each = stored(shorter.groupBy("length", "task").agg(F.count("*").alias("n")), "length-counts")
    counts = {int(r["length"]): int(r["n"]) for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = shorter.join(offsets, ["length", "task"]).select(
        "task", "nr", "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).alias("rank")
    )
    layout = spark.sparkContext.broadcast(plan(counts, capacity))
    slices = stored(
        ranked.mapInArrow(
            _place(layout),
            f"task int, nr long, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
            "sequence_id long, offset long, from long, cut boolean",
        ),
        "slices",
    )
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ids = shorter.select("task", "nr", F.col("length").alias("whole"), "ids")
    cut = (
        slices.where("cut")
        .join(ids, ["task", "nr"])
        .select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "from", "whole", "ids")
        .mapInArrow(
            _slice_crc,
            f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
        )
    )
    alone = (-1 - F.col("task") * F.lit(_TASKS) - F.col("nr")).alias("sequence_id")
    full = rows.where(F.col("length") == capacity).withColumn("offset", F.lit(0).cast("long")).withColumn("sequence_id", alone)
    return slices.where("not cut").select(*out).unionByName(full.select(*out)).unionByName(cut.select(*out))
