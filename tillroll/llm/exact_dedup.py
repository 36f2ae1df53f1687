"""Exact duplicates through an extendible-hash index on shared files.

1. Keys are 64-bit hashes of whole texts. The directory is addressed by the first bits of a key and doubles
   until no bucket holds more keys than a page may; buckets that need fewer bits share their entries, so
   each has a depth of its own.
2. Copies within a task's part of the documents are combined there, so a text with very many copies goes
   on once per task and not once per row.
3. Each bucket, a range of keys, has one owner task. It takes the texts of a key in turn and compares their
   bytes along the key's chain: an equal text joins the group of its link, another one becomes a new link.
   The index files hold the chains, texts and groups.
4. Documents look their key up in the index. A chain of one link is the answer; along longer ones the texts
   are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.scratch import stored

BUCKET_KEYS = 4_000
DEEPEST = 40
_HELD_BYTES = 32 << 20  # of texts, in a task that combines copies
_ROWS_BYTES = 4 << 20


def _cell(key: Column, depth: int) -> Column:
    """The first `depth` bits of a key as a number."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """(cell, bucket, depth) for every cell in use, and the directory's depth.

    keys: one row per key. The driver sees one number per doubling. A bucket is named by its depth
    and first bits. More than `bucket_keys` equal keys cannot be split, but keys are distinct here.
    """
    depth = 0
    while depth < DEEPEST:
        fullest = keys.groupBy(_cell(F.col("key"), depth).alias("cell")).count().agg(F.max("count")).first()[0] or 0
        if fullest <= bucket_keys:
            break
        depth += max(1, (int(fullest) // bucket_keys).bit_length() - 1)
    cells = keys.groupBy(_cell(F.col("key"), depth).alias("cell")).agg(F.count("*").alias("n"))
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn(
        "page", F.expr(f"shiftright(cell, {depth} - depth)")
    )
    pages = levels.groupBy("depth", "page").agg(F.sum("n").alias("n")).where((F.col("n") <= bucket_keys) | (F.col("depth") == depth))
    leaves = levels.drop("n").join(pages, ["depth", "page"]).groupBy("cell").agg(F.min(F.struct("depth", "page")).alias("leaf"))
    return leaves.select("cell", F.concat_ws(":", "leaf.depth", "leaf.page").alias("bucket"), F.col("leaf.depth").alias("depth")), depth


def _larger(a, b):
    return b if a is None else a if b is None else max(a, b)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, key, text to key, text, keep_id, group_size, with equal texts of a stretch of rows as one."""
    groups: dict[tuple, list] = {}
    held, kind = 0, None

    def taken() -> Iterator[pa.RecordBatch]:
        rows = list(groups.items())
        for part in (rows[i : i + 500] for i in range(0, len(rows), 500)):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key for (key, _), _ in part], pa.int64()),
                    pa.array([text for (_, text), _ in part], pa.binary()),
                    pa.array([keep for _, (keep, _) in part], kind),
                    pa.array([n for _, (_, n) in part], pa.int64()),
                ],
                ["key", "text", "keep_id", "group_size"],
            )

    for batch in batches:
        kind = batch.schema.field(0).type
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            for doc_id, key, text in zip(*[part.column(k).to_pylist() for k in range(3)]):
                group = groups.get((key, text))
                if group is None:
                    groups[key, text] = [doc_id, 1]
                    held += len(text)
                else:
                    group[:] = _larger(group[0], doc_id), group[1] + 1
            if held > _HELD_BYTES:
                yield from taken()
                groups.clear()
                held = 0
    if groups:
        yield from taken()


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, key, text, keep_id, group_size in the order of keys to the links of every key's chain."""
    names = ["bucket", "key", "chain", "links", "text", "text_sha256", "keep_id", "group_size"]
    rows: list[tuple] = []
    size, key, bucket, kind = 0, None, None, None
    links: dict[bytes, list] = {}

    def close() -> None:
        nonlocal size
        for place, (text, (keep, n)) in enumerate(links.items(), 1):
            rows.append((bucket, key, place, len(links), text, hashlib.sha256(text).hexdigest(), keep, n))
            size += len(text)
        links.clear()

    def taken() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string(), kind, pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        kind = batch.schema.field(3).type
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            for own_bucket, own, text, keep, n in zip(*[part.column(k).to_pylist() for k in range(5)]):
                if own != key:
                    close()
                    if size > _ROWS_BYTES:
                        yield taken()
                        rows.clear()
                        size = 0
                    key, bucket = own, own_bucket
                link = links.get(text)  # equal by bytes
                if link is None:
                    links[text] = [keep, n]
                else:
                    link[:] = _larger(link[0], keep), link[1] + n
    close()
    if rows:
        yield taken()


def build_index(docs: DataFrame, key: Column, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The index files: bucket, key, chain (place in the key's chain), links (the chain's length), text (its
    bytes), text_sha256, keep_id, group_size."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    keys = stored(texts.select(key.alias("key")).distinct(), "dedup-keys")
    cells, depth = directory(keys, bucket_keys)
    cells = stored(cells.select("cell", "bucket"), "dedup-directory")
    combined = texts.select("doc_id", key.alias("key"), F.col("text").cast("binary").alias("text")).mapInArrow(
        _combined, f"key long, text binary, keep_id {kind}, group_size long"
    )
    owned = (
        combined.withColumn("cell", _cell(F.col("key"), depth))
        .join(cells, "cell")
        .select("bucket", "key", "text", "keep_id", "group_size")
        .repartition("bucket")
        .sortWithinPartitions("key")
    )
    index = owned.mapInArrow(
        _chained,
        f"bucket string, key long, chain int, links int, text binary, text_sha256 string, keep_id {kind}, group_size long",
    )
    return stored(index, "dedup-index")


def exact_duplicates(docs: DataFrame, bucket_keys: int = BUCKET_KEYS, key_bits: int = 64) -> DataFrame:
    """Every document with the row of its text that stays: the one with the largest doc_id.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row per row of docs. Texts are equal when
    their bytes are. `key_bits` shortens the hash keys, which makes chains longer and changes no result; a
    chain must fit a task, as it does with 64 bits.

    Nulls: a null text counts as empty. A row without doc_id counts in its group and is kept only if no
    row of the group has an id (keep_id is null then). Equal rows with the largest id are all kept: they
    cannot be told apart. An empty table gives no rows; columns other than doc_id and text are not read.
    """
    key = F.shiftleft(F.shiftright(F.xxhash64("text"), 64 - key_bits), 64 - key_bits)
    index = build_index(docs, key, bucket_keys)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = ["text_sha256", "keep_id", "group_size"]
    plain = texts.select("doc_id", key.alias("key")).join(index.where("links = 1").select("key", *found), "key")
    chains = stored(index.where("links > 1").select("key", F.col("text").alias("link"), *found), "dedup-chains")
    compared = texts.select("doc_id", key.alias("key"), F.col("text").cast("binary").alias("text")).join(chains, "key")
    rows = plain.select("doc_id", *found).unionByName(compared.where(F.col("text") == F.col("link")).select("doc_id", *found))
    return rows.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """docs without the rows that exact_duplicates drops; columns as given."""
    dropped = (
        exact_duplicates(docs, bucket_keys)
        .where(~F.col("kept"))
        .select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
        .distinct()
    )
    sha = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    return docs.join(dropped, docs["doc_id"].eqNullSafe(F.col("__id")) & (sha == F.col("__sha")), "left_anti")
