"""Similarity join of documents on sets of word n-grams, by prefix trees.

1. Every text becomes its set of n-grams (63-bit hashes); equal sets are one class from here on.
2. n-grams have one global order, rarest first. Two sets that are similar enough share one of each
   other's first n-grams, so only those ("the prefix") are posted. Counts are found in shards of the
   hash space: blocks of sets send their n-grams there in packed arrays, get back the orders of those
   that recur, and post.
3. Sets posted under one n-gram meet in the group of the least set there; groups of the same least set
   are one group. Large groups are dealt in blocks, and each pair of blocks is a task of its own.
4. A task stores one block's ordered sets in a trie and walks it once with all sets of the other block
   side by side: a node's overlap counts are its parent's plus one row of the incidence matrix, so
   common beginnings are counted once, and a subtree is left as soon as the lengths that remain cannot
   reach the overlap that any probe needs.
5. Links join classes to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.graph import components
from tillroll.llm.key_bits import by_keys
from tillroll.llm.scratch import stored

WORDS = 5
THRESHOLD = 80  # per cent of the union
LOW = 0.3  # share of the hash space whose n-grams come first in the order, by their counts
BLOCK_SETS = 512
BLOCK_NGRAMS = 200_000
COUNT_SETS = 1 << 16  # at most so many sets are counted together, numbered by 16 bits
COUNT_NGRAMS = 2_000_000  # and about so many n-grams
SHARD_NGRAMS = 4_000_000  # counted by one task at a time
FEW = 16  # n-grams of more sets of a block go to their shard without their sets
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_CUT = 15  # bits of an n-gram's hash that are left out for order and postings
_WIDTH = 6  # bytes of the rest
_LOW_END = int(LOW * 2 ** (63 - _CUT))
_MASK = np.uint64(2 ** (63 - _CUT) - 1)
_HIGH = 62  # order of an n-gram beyond LOW that is in one set; one more: in several


def ngrams(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct n-grams of a text as ascending 63-bit hashes.

    A-Z are lower-cased and words are what stands between ASCII white space. A text of fewer words is one
    n-gram of all its words; one without words has none.
    """
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    size = min(words, len(found))
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    count = len(one) - size + 1
    mixed = np.full(count, size, np.uint64)
    for k in range(size):
        mixed ^= one[k : k + count]
        mixed *= _PRIME
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed >> np.uint64(1))


def needed(a, b, threshold: int = THRESHOLD):
    """The least overlap of sets of these sizes with 100 * overlap >= threshold * union."""
    return -(-threshold * (a + b) // (100 + threshold))


def prefix_length(size, threshold: int = THRESHOLD):
    """So many n-grams of a set, first in any common order, hold one of every similar set's first."""
    return size - -(-threshold * size // 100) + 1


def _packed(values: np.ndarray, width: int = _WIDTH) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(raw: bytes, width: int = _WIDTH) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).reshape(-1, width)
    whole = np.zeros((len(part), 8), np.uint8)
    whole[:, :width] = part
    return whole.view("<u8").ravel()


def _chained(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _sets(words: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # within this task; equal sets of other tasks meet later
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                sizes, ids, lows = [], [], []
                for text in part.column(1).to_pylist():
                    grams = ngrams(text or b"", words)
                    size = len(grams)
                    key = xxhash.xxh3_128_digest(grams.tobytes()) if size else None
                    sizes.append(size)
                    ids.append(key)
                    if key is None or key in seen:
                        lows.append(None)
                        continue
                    seen.add(key)
                    keep = max(np.searchsorted(grams, np.uint64(_LOW_END << _CUT)), prefix_length(size, threshold))
                    lows.append(_packed(grams[:keep] >> np.uint64(_CUT)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(lows, pa.binary())],
                    ["doc_id", "text_key", "n_shingles", "set_id", "first"],
                )

    return run


def _text_key() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64("text")


def ngram_sets(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, text_key, n_shingles, set_id (digest of the set; null if empty), first (its least n-grams by hash,
    the leading 48 bits of each; null where the task had the set before)."""
    plain = docs.select("doc_id", F.col("text").cast("binary").alias("text"), _text_key().alias("text_key"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(
        _sets(words, threshold), f"doc_id {kind}, text_key long, n_shingles long, set_id binary, first binary"
    )


def _chunks(shards: int, most_sets: int, most_ngrams: int, few_sets: int):
    """Blocks of sets: a row with the n-grams of each shard, and a row for the block itself (shard >= shards).

    A shard gets each distinct n-gram of a block once: the difference from the one before, the number of sets and, if
    these are few, their places in the block. The sets of others stay in the block's own row, so that an n-gram
    of very many sets is no more to its shard than one entry a block.
    """
    names = ["shard", "block", "ids", "sizes", "grams", "counts", "members"]
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 5

    def rows(block: int, ids: list[bytes], sizes: list[int], firsts: list[bytes]) -> pa.RecordBatch:
        lengths = np.array([len(f) // _WIDTH for f in firsts], np.int64)
        grams = _unpacked(b"".join(firsts))
        key = ((grams % np.uint64(shards)) << np.uint64(48)) | (grams // np.uint64(shards))
        order = np.argsort(key, kind="stable")
        key, sets = key[order], np.repeat(np.arange(len(ids)), lengths).astype(np.uint16)[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, count = key[start], np.diff(np.append(start, len(key)))
        few = count <= few_sets
        listed = np.repeat(few, count)
        members, ends = sets[listed], np.concatenate([[0], np.cumsum(np.where(few, count, 0))])
        edges = np.searchsorted(key, np.arange(shards + 1, dtype=np.uint64) << np.uint64(48))
        found = []
        for shard in np.flatnonzero(np.diff(edges)):
            a, b = edges[shard], edges[shard + 1]
            steps = np.diff(key[a:b] & _MASK, prepend=np.uint64(0))
            width = max(1, (int(steps.max()).bit_length() + 7) // 8)
            counts = np.minimum(count[a:b], 255).astype(np.uint8).tobytes()
            found.append((int(shard), block, None, None, _packed(steps, width), counts, members[ends[a] : ends[b]].tobytes()))
        many = (key[~few] & _MASK) * np.uint64(shards) + (key[~few] >> np.uint64(48))
        numbers = np.concatenate([np.array(sizes, np.int64), lengths]).tobytes()
        own = (shards + block % shards, block, b"".join(ids), numbers, _packed(many), count[~few].tobytes(), sets[~listed].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, own), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 24, ([], [], [])
        size = 0
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                for column, value in zip(held, row):
                    column.append(value)
                size += len(row[2]) // _WIDTH
                if size >= most_ngrams or len(held[0]) == most_sets:
                    yield rows(block, *held)
                    block, held, size = block + 1, ([], [], []), 0
        if held[0]:
            yield rows(block, *held)

    return run


def _orders(shards: int, few_sets: int):
    """The rows of a shard with the n-grams that recur and the binary order of their counts; other rows as they are.

    Counts are of sets over all blocks, 255 a block at most. That only moves work between the prefix and the trie: any
    order gives the same links. n-grams beyond LOW stay in the order of their hashes.
    """

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        if shard >= shards:
            return table.drop_columns("shard").append_column("orders", pa.nulls(table.num_rows, pa.binary()))
        counts = [np.frombuffer(c, np.uint8) for c in table.column("counts").to_pylist()]
        ends = np.cumsum([len(c) for c in counts])
        rest = np.concatenate(
            [np.cumsum(_unpacked(g, len(g) // len(c)), dtype=np.uint64) for g, c in zip(table.column("grams").to_pylist(), counts)]
        )
        distinct, back = np.unique(rest, return_inverse=True)
        total = np.bincount(back, weights=np.concatenate(counts))
        grams = distinct * np.uint64(shards) + np.uint64(shard)
        order = np.where(grams < np.uint64(_LOW_END), np.floor(np.log2(total)), np.where(total > 1, _HIGH + 1, _HIGH)).astype(np.uint8)
        columns = [], [], [], []
        members = (np.frombuffer(m, np.uint16) for m in table.column("members").to_pylist())
        for end, count, sets in zip(ends, counts, members):
            own = back[end - len(count) : end]
            kept = order[own] > 0  # others are in no other set
            listed = np.repeat(kept, np.where(count <= few_sets, count, 0))
            values = _packed(grams[own[kept]]), order[own[kept]].tobytes(), count[kept].tobytes(), sets[listed].tobytes()
            for column, value in zip(columns, values):
                column.append(value)
        grams_, orders, counts_, members_ = (pa.array(c, pa.binary()) for c in columns)
        none = pa.nulls(table.num_rows, pa.binary())
        return pa.table(
            [table.column("block"), none, none, grams_, counts_, members_, orders],
            ["block", "ids", "sizes", "grams", "counts", "members", "orders"],
        )

    return run


def _post(threshold: int, few_sets: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["ids"] is not None)
        sizes, lengths = np.split(np.frombuffer(own["sizes"], np.int64), 2)
        found = [r for r in rows if r["ids"] is None]
        grams = _chained([_unpacked(r["grams"]) for r in found], np.uint64)
        orders = _chained([np.frombuffer(r["orders"], np.uint8) for r in found], np.uint8)
        counts = _chained([np.frombuffer(r["counts"], np.uint8) for r in found], np.uint8)
        few = counts <= few_sets
        many, many_sets = _unpacked(own["grams"]), np.frombuffer(own["counts"], np.int64)
        place = np.argsort(grams[~few])
        place = place[np.searchsorted(grams[~few], many, sorter=place)]
        gram = np.concatenate([np.repeat(grams[few], counts[few]), np.repeat(many, many_sets)])
        order = np.concatenate([np.repeat(orders[few], counts[few]), np.repeat(orders[~few][place], many_sets)])
        sets = np.concatenate([np.frombuffer(r["members"], np.uint16) for r in [*found, own]]).astype(np.int64)

        recurring = np.bincount(sets, minlength=len(sizes))
        room = prefix_length(sizes, threshold) - (lengths - recurring)  # those of no other set come first
        at = np.lexsort((gram, np.minimum(order, _HIGH), sets))
        before = np.arange(len(at)) - (np.cumsum(recurring) - recurring)[sets[at]]
        at = at[(before < room[sets[at]]) & (order[at] != _HIGH)]
        ids = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(sizes), [None, pa.py_buffer(own["ids"])]).cast(pa.binary())
        return pa.table(
            [pa.array(gram[at].astype(np.int64)), ids.take(pa.array(sets[at])), pa.array(sizes[sets[at]])],
            ["gram", "set_id", "size"],
        )

    return run


def postings(sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """gram, set_id, size: each set under the n-grams of its prefix in the global order that are in other sets too.

    n-grams are cut to 48 bits here; two of one value meet and are told apart by the trie. Equal sets of several tasks
    are posted as often.
    """
    first = sets.where(F.col("first").isNotNull()).select("set_id", "n_shingles", "first")
    total = first.agg(F.sum(F.octet_length("first"))).first()[0] or 0
    partitions = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = min(32767, max(partitions, -(-total // (_WIDTH * SHARD_NGRAMS))))
    packed = "ids binary, sizes binary, grams binary, counts binary, members binary"
    return (
        first.mapInArrow(_chunks(shards, COUNT_SETS, COUNT_NGRAMS, FEW), f"shard int, block long, {packed}")
        .groupBy("shard")
        .applyInArrow(_orders(shards, FEW), f"block long, {packed}, orders binary")
        .groupBy("block")
        .applyInArrow(_post(threshold, FEW), "gram long, set_id binary, size long")
    )


class _Trie:
    """Sets of one block as paths of ranks in lexicographic order: equal beginnings stand side by side."""

    def __init__(self, paths: list[np.ndarray]):
        self.order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes())
        self.paths = [paths[i] for i in self.order]

    def walk(self, probes: np.ndarray, left: np.ndarray, step: int, need) -> Iterator[tuple[int, np.ndarray]]:
        """Yield (set, overlap with every probe); sets of a subtree that no probe can reach are left out.

        probes: incidence of ranks by probes. left[k]: how many ranks >= k * step each probe has.
        need(i): the overlap that each probe needs with set i.
        """
        counts = [np.zeros(probes.shape[1], np.int32)]  # by depth: what is shared so far, along one path
        closed, before = None, np.empty(0, np.int64)
        for place, path in enumerate(self.paths):
            n = min(len(path), len(before))
            differ = np.flatnonzero(path[:n] != before[:n])
            depth = int(differ[0]) if len(differ) else n
            before = path
            least = need(self.order[place])
            if closed is not None and depth >= closed[0]:  # below a node that was left
                if (counts[closed[0]] + np.minimum(len(path) - closed[0], closed[1]) < least).all():
                    continue
            closed = None
            depth = min(depth, len(counts) - 1)
            del counts[depth + 1 :]
            while depth < len(path):
                part = path[depth : depth + step]
                counts.extend(np.cumsum(probes[part], axis=0, dtype=np.int32) + counts[-1])
                depth += len(part)
                rest = left[int(part[-1]) // step]
                if depth < len(path) and (counts[-1] + np.minimum(len(path) - depth, rest) < least).all():
                    closed = (depth, rest)
                    break
            else:
                yield self.order[place], counts[-1]


def linked(sets: list[np.ndarray], side: np.ndarray, threshold: int = THRESHOLD) -> Iterator[tuple[int, np.ndarray]]:
    """(a, the sets similar to a) for pairs across sides 0 and 1, or for all pairs if there is one side."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    grams, back, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.full(len(grams), -1, np.int64)  # an n-gram of one set adds to no overlap
    shared = np.flatnonzero(count > 1)
    rank[shared[np.argsort(-count[shared], kind="stable")]] = np.arange(len(shared))
    paths = [np.sort(r[r >= 0]) for r in np.split(rank[back], np.cumsum(sizes)[:-1])]
    two = len(np.unique(side)) > 1
    stored_sets = np.flatnonzero(side == 0) if two else np.arange(len(sets))
    probe_sets = np.flatnonzero(side == 1) if two else np.arange(len(sets))
    step = 32
    incidence = np.zeros((len(shared), len(probe_sets)), np.uint8)
    for column, i in enumerate(probe_sets):
        incidence[paths[i], column] = 1
    blocks = -(-max(1, len(shared)) // step)
    left = np.zeros((blocks + 1, len(probe_sets)), np.int32)
    for k in range(blocks - 1, -1, -1):
        left[k] = left[k + 1] + incidence[k * step : (k + 1) * step].sum(axis=0, dtype=np.int32)
    probe_sizes = sizes[probe_sets]
    trie = _Trie([paths[i] for i in stored_sets])
    for place, overlap in trie.walk(incidence, left, step, lambda i: needed(sizes[stored_sets[i]], probe_sizes, threshold)):
        a = int(stored_sets[place])
        hits = probe_sets[overlap >= needed(sizes[a], probe_sizes, threshold)]
        hits = hits if two else hits[hits > a]
        if len(hits):
            yield a, hits


def _join_block(threshold: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("set_id", ignore_index=True)
        ids = list(pdf["set_id"])
        root, links = list(range(len(ids))), np.zeros(len(ids), np.int64)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        across = pdf["i"].iloc[0] != pdf["j"].iloc[0]  # pairs within a block are the task (i, i)'s
        if len(ids) > 1 and not (across and pdf["side"].nunique() == 1):
            sets = [np.frombuffer(x, np.uint64) for x in pdf["grams"]]
            here, copies = pdf["group_key"].iloc[0], pdf["copies"].to_numpy()
            groups = [set(x) for x in pdf["groups"]]
            one = np.array([len(g) == 1 for g in groups])
            for a, hits in linked(sets, pdf["side"].to_numpy(), threshold):
                # a pair that meets in several groups counts in the least of them
                mine = hits if one[a] else np.array([b for b in hits if one[b] or min(groups[a] & groups[b]) == here], np.int64)
                links[a] += copies[mine].sum()
                np.add.at(links, mine, copies[a])
                for b in hits:
                    x, y = find(a), find(int(b))
                    if x != y:
                        root[max(x, y, key=lambda i: ids[i])] = min(x, y, key=lambda i: ids[i])
        tied = [i for i in range(len(ids)) if find(i) != i or links[i]]
        return pd.DataFrame(
            {"set_id": [ids[i] for i in tied], "to_id": [ids[find(i)] for i in tied], "links": links[tied]}
        )

    return run


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # rows that are equal in doc_id and text
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                rows, grams = [], []
                for i, (text, wanted) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    if wanted in seen:
                        continue
                    own = ngrams(text or b"", words).tobytes()
                    if xxhash.xxh3_128_digest(own) == wanted:
                        seen.add(wanted)
                        rows.append(i)
                        grams.append(own)
                kept = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [kept.column(1), pa.array(grams, pa.binary()), *kept.columns[2:]], ["set_id", "grams", "copies", "places"]
                )

    return run


def _classes(docs: DataFrame, words: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """The rows (see ngram_sets) and the classes of equal sets: set_id, component_id, n_links, stays (the least
    doc_id of the class if it is the class of its component that stays, else null)."""
    docs = docs.select("doc_id", "text")
    sets = stored(ngram_sets(docs, words, threshold), "ngram-sets")
    nameless = F.col("doc_id").isNull()
    classes = (
        sets.where(F.col("set_id").isNotNull())
        .groupBy("set_id")
        .agg(
            F.min("doc_id").alias("least_id"),
            F.min(F.struct(nameless, "doc_id", "text_key"))["text_key"].alias("least_key"),
            F.count("*").alias("copies"),
        )
    )
    posted = stored(postings(sets, threshold), "postings")
    least = posted.groupBy("gram").agg(F.min("set_id").alias("leader"), F.max("set_id").alias("last")).where("leader < last")
    members = stored(
        posted.join(least, "gram").select("leader", "set_id", "size").distinct(), "groups"
    )

    blocks = members.groupBy("leader").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_NGRAMS)).cast("int").alias("n")
    )
    large = stored(blocks.where("n > 1"), "large-groups")  # few and known by size, so members need not be shuffled
    place = F.struct("leader", F.coalesce("n", F.lit(1)).alias("n"))
    places = members.join(large, "leader", "left").groupBy("set_id").agg(F.collect_list(place).alias("places"))
    wanted = stored(places.join(classes, "set_id").select("set_id", "copies", "places", "least_id", "least_key"), "wanted-sets")
    keyed = docs.withColumn("text_key", _text_key())
    keys = wanted.select(F.xxhash64("least_id", "least_key").alias("key")).distinct()
    texts = by_keys(keyed, F.xxhash64("doc_id", "text_key"), keys)[0].join(
        wanted, keyed["doc_id"].eqNullSafe(F.col("least_id")) & (F.col("text_key") == F.col("least_key"))
    )
    full = texts.select(F.col("text").cast("binary").alias("text"), "set_id", "copies", "places").mapInArrow(
        _full_sets(words), "set_id binary, grams binary, copies long, places array<struct<leader: binary, n: int>>"
    )
    dealt = (
        full.withColumn("groups", F.transform("places", lambda p: F.xxhash64(p["leader"])))
        .withColumn("place", F.explode("places"))
        .select("set_id", "grams", "copies", "groups", "place.leader", "place.n")
        .withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("n")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select(
            "set_id",
            "grams",
            "copies",
            "groups",
            "leader",
            F.xxhash64("leader").alias("group_key"),
            F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"),
            (F.col("block") > F.col("other")).cast("int").alias("side"),
        )
    )
    ties = stored(
        dealt.groupBy("leader", "i", "j").applyInPandas(_join_block(threshold), "set_id binary, to_id binary, links long"),
        "links",
    )

    roots = components(ties, "set_id", "to_id").withColumnRenamed("node", "set_id")
    held = roots.join(classes, "set_id").select("set_id", "root", "least_id")
    first = F.min(F.when(F.col("least_id").isNotNull(), F.struct("least_id", "set_id"))).alias("first")
    joined = held.join(held.groupBy("root").agg(first), "root").select("set_id", "first")
    others = ties.groupBy("set_id").agg(F.sum("links").alias("links"))
    alone = F.struct("least_id", "set_id")
    per_class = (
        classes.join(joined, "set_id", "left")
        .join(others, "set_id", "left")
        .withColumn("first", F.coalesce("first", alone))
        .select(
            "set_id",
            F.col("first.least_id").alias("component_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.when(F.col("first.set_id") == F.col("set_id"), F.col("least_id")).alias("stays"),
        )
    )
    return sets, stored(per_class, "classes")  # a plain table, so that a class with very many copies can be split


def ngram_jaccard_join(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """Components of documents whose n-gram sets overlap in `threshold` per cent of their union.

    Returns doc_id, n_shingles, component_id (least doc_id reachable by links, its own included),
    n_links (other documents it is linked with; copies count). Every link is found: hashes decide, of 63
    bits an n-gram and 128 a set.

    Nulls: a null text counts as empty, an empty set is linked with nothing; a row without doc_id is
    linked like others but lends no id to its component, so component_id is null if no row has one.
    Repeated rows each come back. An empty table gives no rows. Columns other than doc_id and text are
    not read.
    """
    sets, classes = _classes(docs, words, threshold)
    return sets.select("doc_id", "n_shingles", "set_id").join(classes, "set_id", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The documents without all but the least doc_id of each component; columns and rows as given.

    A row goes by its own text: where a doc_id has several texts, those that are linked with nothing stay, and
    of linked texts with the least doc_id one set stays. Documents without words are in no group and stay.
    Rows without doc_id stay. Equal rows, and rows of equal sets with the least doc_id, stay or go together.
    """
    sets, classes = _classes(docs, words, threshold)
    dropped = stored(
        sets.join(classes, "set_id")
        .where(F.col("doc_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("stays")))
        .select(F.col("doc_id").alias("__dropped"), F.col("text_key").alias("__key"))
        .distinct(),
        "dropped",
    )
    may, stay = by_keys(docs, F.xxhash64("doc_id", _text_key()), dropped.select(F.xxhash64("__dropped", "__key").alias("key")))
    kept = may.join(dropped, (may["doc_id"] == F.col("__dropped")) & (_text_key() == F.col("__key")), "left_anti")
    return stay.union(kept)
