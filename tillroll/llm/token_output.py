"""Token ids in binary shards with a minimal perfect hash index.

Shard files hold raw ids, one fixed width for all, in ascending doc_id order. The index maps document
keys to places: keys are dealt into parts of bounded size, each with its own minimal perfect hash (bit
levels: a key stands where it meets no other, the rest go on to the next level, the rank of the bit is
the slot). A slot keeps the fingerprint of its key, the shard, the offset and the number of ids, so a key
is found in constant time and one that was never written is turned away.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.llm.scratch import shared_folder, stored
from tillroll.llm.token_ids import END_ID, default_tokenizer, encoder

BLOCK_BYTES = 1 << 20
PART_KEYS = 1024
LEVELS = 40


def _shards(path: str, width: int):
    """The blocks of one shard from its texts in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        vocabulary = max(own.tokenizer.get_vocab_size(), END_ID + 1)
        if vocabulary > 1 << 8 * width:
            raise ValueError(f"a vocabulary of {vocabulary} ids does not fit into {width} bytes an id")
        end = np.array([END_ID], "<u4").tobytes()
        shard, block, at = TaskContext.get().partitionId(), 0, 0
        payload, ids, places, lengths, repeats, size = [], [], [], [], [], 0
        before, repeat = object(), 0

        def written() -> pa.RecordBatch:
            raw = np.frombuffer(b"".join(payload), "<u4").astype(f"<u{width}").tobytes()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([places[0]], pa.int64()),
                    pa.array([raw], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, id_type)),
                    pa.array([repeats], pa.list_(pa.int32())),
                    pa.array([places], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int64())),
                ],
                ["shard", "block", "first", "payload", "doc_ids", "repeats", "places", "lengths"],
            )

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, found in zip(batch.column(0), own.encode_all(text.as_py() for text in batch.column(1))):
                key = doc_id.as_py()
                repeat = repeat + 1 if key == before else 0
                before = key
                raw = found + end
                payload.append(raw)
                size += len(raw)
                ids.append(key)
                repeats.append(repeat)
                places.append(at)
                lengths.append(len(raw) // 4)
                at += len(raw) // 4
                if size >= BLOCK_BYTES * 4 // width:
                    yield written()
                    block += 1
                    payload, ids, places, lengths, repeats, size = [], [], [], [], [], 0
        if ids:
            yield written()

    return run


def _mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a ^ (b * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level + 1) * np.uint64(0xC2B2AE3D27D4EB4F))
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def perfect_hash(a: np.ndarray, b: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """(bits per level, bits, slot of each key): a minimal perfect hash of distinct keys (a, b)."""
    sizes, bits, slots = [], [], np.full(len(a), -1, np.int64)
    left, taken = np.arange(len(a)), 0
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError("document keys are not distinct")
        size = 2 * len(left) + 8
        at = (_mix(a[left], b[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        level = np.bincount(at, minlength=size) == 1
        alone = level[at]
        slots[left[alone]] = taken + (np.cumsum(level) - 1)[at[alone]]
        taken += int(level.sum())
        sizes.append(size)
        bits.append(level)
        left = left[~alone]
    return sizes, np.packbits(np.concatenate(bits)).tobytes() if bits else b"", slots


def find_slots(a: np.ndarray, b: np.ndarray, sizes: list[int], bits: bytes) -> np.ndarray:
    """The slot of each key; -1 or any slot for a key that the hash was not made for."""
    flags = np.unpackbits(np.frombuffer(bits, np.uint8))[: sum(sizes)].astype(bool)
    ranks = np.cumsum(flags) - 1
    slots, left, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
    for level, size in enumerate(sizes):
        at = base + (_mix(a[left], b[left], level) % np.uint64(size)).astype(np.int64)
        here = flags[at]
        slots[left[here]] = ranks[at[here]]
        left, base = left[~here], base + size
    return slots


def _fingerprint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (_mix(b, a, 99) >> np.uint64(32)).astype(np.uint32)


def _keys(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return pdf["key_a"].to_numpy(np.int64).view(np.uint64), pdf["key_b"].to_numpy(np.int64).view(np.uint64)


def _build_part(pdf: pd.DataFrame) -> pd.DataFrame:
    a, b = _keys(pdf)
    sizes, bits, slots = perfect_hash(a, b)
    order = np.argsort(slots)
    return pd.DataFrame(
        {
            "part": [pdf["part"].iloc[0]],
            "levels": [sizes],
            "bits": [bits],
            "fingerprints": [_fingerprint(a, b)[order].astype("<u4").tobytes()],
            "shards": [pdf["shard"].to_numpy()[order].astype("<u4").tobytes()],
            "blocks": [pdf["block"].to_numpy()[order].astype("<u4").tobytes()],
            "places": [pdf["place"].to_numpy()[order].astype("<u8").tobytes()],
            "lengths": [pdf["n_tokens"].to_numpy()[order].astype("<u8").tobytes()],
        }
    )


_INDEX = "part long, levels array<int>, bits binary, fingerprints binary, shards binary, blocks binary, places binary, lengths binary"


def _with_keys(df: DataFrame, parts: int) -> DataFrame:
    """Two 64-bit keys of a document and how often its id came before, and the part they are in."""
    def key(seed: int) -> Column:
        return F.xxhash64(F.lit(seed), "doc_id", "repeat")

    return df.select("*", key(1).alias("key_a"), key(2).alias("key_b")).withColumn("part", F.pmod("key_a", F.lit(parts)))


class TokenFiles:
    """Shard files, their index, and keyed access to both."""

    def __init__(self, payload: DataFrame, index: DataFrame, starts: DataFrame, parts: int, width: int, name: str):
        self.payload, self.index, self.starts, self.parts, self.width, self.name = payload, index, starts, parts, width, name

    def find(self, keys: DataFrame) -> DataFrame:
        """doc_id, repeat, shard, block, place, n_tokens of the keys (doc_id, repeat) that were written.

        repeat numbers the documents of one doc_id from 0.
        """
        kind = keys.schema["doc_id"].dataType.simpleString()
        asked = _with_keys(keys.select("doc_id", F.col("repeat").cast("int").alias("repeat")), self.parts)

        def look_up(pdf: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
            if not len(pdf) or not len(part):
                return pd.DataFrame({c: [] for c in ("doc_id", "repeat", "shard", "block", "place", "n_tokens")})
            row = part.iloc[0]
            a, b = _keys(pdf)
            slots = find_slots(a, b, list(row["levels"]), row["bits"])
            known = np.frombuffer(row["fingerprints"], "<u4")
            hit = (slots >= 0) & (known[slots] == _fingerprint(a, b))
            at = slots[hit]
            out = pdf.loc[hit, ["doc_id", "repeat"]].reset_index(drop=True)
            for name, column, width in (("shard", "shards", "<u4"), ("block", "blocks", "<u4"), ("place", "places", "<u8"), ("n_tokens", "lengths", "<u8")):
                out[name] = np.frombuffer(row[column], width)[at].astype(np.int64)
            return out

        return (
            asked.groupBy("part")
            .cogroup(self.index.groupBy("part"))
            .applyInPandas(look_up, f"doc_id {kind}, repeat int, shard int, block int, place long, n_tokens long")
        )

    def read(self, keys: DataFrame) -> DataFrame:
        """doc_id, repeat, start, n_tokens, ids (little-endian unsigned 32-bit) of the keys, from the files.

        start counts the ids of all documents before. The shard files are bucketed by block, so the places
        come to the payload, which is not shuffled, and a task holds one block at a time.
        """
        kind, width = keys.schema["doc_id"].dataType.simpleString(), self.width
        names = ["doc_id", "repeat", "shard", "place", "n_tokens"]

        def slice_out(places: pa.Table, blocks: pa.Table) -> pa.Table:
            ids = []
            if len(places):
                first = blocks.column("first")[0].as_py()
                raw = np.frombuffer(blocks.column("payload")[0].as_py(), f"<u{width}").astype("<u4").tobytes()
                start = (places.column("place").to_numpy() - first) * 4
                end = start + places.column("n_tokens").to_numpy() * 4
                ids = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
            return places.select(names).append_column("ids", pa.array(ids, pa.binary()))

        blocks = self.payload.select("shard", "block", "first", "payload")
        sliced = (
            self.find(keys)
            .groupBy("shard", "block")
            .cogroup(blocks.groupBy("shard", "block"))
            .applyInArrow(slice_out, f"doc_id {kind}, repeat int, shard int, place long, n_tokens long, ids binary")
        )
        return sliced.join(self.starts, "shard").select(
            "doc_id", "repeat", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids"
        )


def write_tokens(docs: DataFrame, tokenizer: str | None = None, width: int = 2) -> TokenFiles:
    """Write the ids of every whole text and the end id in ascending doc_id order, and index them.

    Texts are ranged over the shards by doc_id and encoded there. Blocks hold BLOCK_BYTES, or one longer
    document. width: bytes per id, 2 for vocabularies of up to 65,536 ids and 4 for others; a vocabulary that
    does not fit raises. Rows of equal doc_id are ordered by their text and numbered. The blocks are a table
    of the session's catalog, named by `TokenFiles.name`.

    Nulls: a null text counts as empty (the end id alone); rows without doc_id come first and are found
    under a null key. An empty table gives files without documents. Other columns are not read.
    """
    spark = docs.sparkSession
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = (
        plain.repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(
            _shards(tokenizer or default_tokenizer(), width),
            f"shard int, block int, first long, payload binary, doc_ids array<{kind}>, repeats array<int>, places array<long>, lengths array<long>",
        )
    )
    name = f"token_shards_{uuid.uuid4().hex}"
    (
        made.write.bucketBy(buckets, "shard", "block")
        .sortBy("shard", "block")
        .option("compression", "snappy")
        .option("path", f"{shared_folder(spark)}/{name}")
        .saveAsTable(name)
    )
    payload = spark.table(name)
    zipped = F.explode(F.arrays_zip("doc_ids", "repeats", "places", "lengths")).alias("e")
    entries = payload.select("shard", "block", zipped).select(
        "shard",
        "block",
        F.col("e.doc_ids").alias("doc_id"),
        F.col("e.repeats").alias("repeat"),
        F.col("e.places").alias("place"),
        F.col("e.lengths").alias("n_tokens"),
    )
    held = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    per_shard = stored(
        payload.groupBy("shard").agg(F.sum(held).alias("ids"), F.sum(F.size("lengths")).cast("long").alias("docs")), "shard-sizes"
    )
    total = per_shard.agg(F.sum("docs")).first()[0] or 0
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    starts = per_shard.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    parts = max(1, -(-total // PART_KEYS))
    index = stored(_with_keys(entries, parts).groupBy("part").applyInPandas(_build_part, _INDEX), "token-index")
    return TokenFiles(payload, index, starts, parts, width, name)


def document_keys(docs: DataFrame) -> DataFrame:
    """doc_id and repeat for every row of docs."""
    same = Window.partitionBy("doc_id").orderBy(F.lit(0))
    return docs.select("doc_id").withColumn("repeat", F.row_number().over(same) - 1)
