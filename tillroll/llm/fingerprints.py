"""Document fingerprints by consistent weighted sampling.

A text is its words with their counts as weights. For each of D samples and each word there is one fixed
draw of r, c ~ Gamma(2, 1) and b ~ U(0, 1); a word of weight w gets t = floor(ln w / r + b) and the value
ln c - r * (t - b + 1). The word of the least value, with its t, is the sample. Two texts agree in a sample
with the probability of their generalised Jaccard similarity, sum of least over sum of largest weights.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.llm.scratch import stored

SAMPLES = 64
KEPT = 2**16  # words whose draws are kept, 12 bytes a sample and word; others are drawn again
SEED = 7  # of the word hashes
STEP = 2**13  # words of a text that are looked at together
_SCHEMA = (
    "shard int, place string, text string, n_chars long, edited_sha256 string, "
    "fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers, each changed to another that looks random."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(hashes: np.ndarray, stream: int, samples: int) -> np.ndarray:
    """Fixed numbers in (0, 1), a row per hash, by a counter that starts at the hash."""
    count = np.arange(1 + stream * samples, 1 + (stream + 1) * samples, dtype=np.uint64)
    x = _mixed(hashes[:, None] + count[None, :] * np.uint64(0x9E3779B97F4A7C15))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


def _draws(hashes: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, b and the value at t = 0 of words by their 64-bit hashes."""
    u = [_uniform(hashes, k, samples) for k in range(5)]
    r = -np.log(u[0] * u[1])
    base = np.log(-np.log(u[2] * u[3])) - r * (1 - u[4])
    return r.astype(np.float32), u[4].astype(np.float32), base.astype(np.float32)


class Sampler:
    """The fingerprint of a text. A word's draws follow from its whole 64-bit hash; those of the last
    words seen are kept, which saves work and changes no result."""

    def __init__(self, samples: int = SAMPLES, kept: int = KEPT):
        self.samples, self.kept = samples, kept
        self.step = min(STEP, kept)
        self.hashes = np.empty(kept, np.uint64)
        self.r, self.b, self.base = (np.empty((kept, samples), np.float32) for _ in range(3))
        self.rows: dict[bytes, int] = {}

    def _places(self, words: list[bytes]) -> np.ndarray:
        """Where the draws of at most `step` different words are kept."""
        rows = self.rows
        new = [w for w in words if w not in rows]
        if len(rows) + len(new) > self.kept:
            rows.clear()
            new = words
        if new:
            first, end = len(rows), len(rows) + len(new)
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, SEED) for w in new), np.uint64, len(new))
            self.hashes[first:end] = hashes
            self.r[first:end], self.b[first:end], self.base[first:end] = _draws(hashes, self.samples)
            rows.update(zip(new, range(first, end)))
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))

    def _least(self, words: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each sample the least value, and the hash and t of its word; of equal values the least hash's."""
        at = self._places(words)
        order = np.argsort(self.hashes[at])
        at, weights = at[order], weights[order]
        value = self.base[at]
        t = np.zeros(value.shape, np.float32)
        more = np.flatnonzero(weights > 1)  # at weight 1, t = floor(b) = 0
        if len(more):
            r = self.r[at[more]]
            t[more] = np.floor(np.log(weights[more])[:, None].astype(np.float32) / r + self.b[at[more]])
            value[more] -= r * t[more]
        best, sample = value.argmin(axis=0), np.arange(self.samples)
        return value[best, sample], self.hashes[at[best]], t[best, sample]

    def fingerprint(self, text: str) -> bytes:
        """Two bytes a sample; none for a text without words."""
        counts = Counter(text.encode("utf-8", "surrogatepass").lower().split())
        if not counts:
            return b""
        words, weights = list(counts), np.fromiter(counts.values(), np.float64, len(counts))
        value, chosen, t = self._least(words[: self.step], weights[: self.step])
        for k in range(self.step, len(words), self.step):
            part = self._least(words[k : k + self.step], weights[k : k + self.step])
            less = (part[0] < value) | ((part[0] == value) & (part[1] < chosen))
            value, chosen, t = (np.where(less, new, old) for new, old in zip(part, (value, chosen, t)))
        numbered = chosen + np.arange(self.samples, dtype=np.uint64) * np.uint64(0xABC98388FB8FAC03)
        mixed = _mixed(numbered + t.astype(np.int64).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        return (mixed >> np.uint64(48)).astype("<u2").tobytes()


@functools.cache
def sampler(samples: int) -> Sampler:
    """One per worker process."""
    return Sampler(samples)


def likeness(a: bytes, b: bytes) -> float:
    """The share of equal samples; 1 for two texts without words, 0 for one."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    return float((np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")).mean())


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) characters replaced by the first as many of the text that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(work: Sampler, text: str, mark: bytes, following: str, next_mark: bytes) -> dict:
    changed = edited(text, following)
    own = work.fingerprint(changed)
    return {
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": mark,
        "edited_fingerprint": own,
        "near_edited": likeness(mark, own),
        "near_next": likeness(mark, next_mark),
    }


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _arrow(id_type: pa.DataType) -> pa.Schema:
    return pa.schema(
        [("doc_id", id_type), ("shard", pa.int32()), ("place", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
         ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )


def _ranges(samples: int):
    """Rows of one ascending range. The last row's successor is elsewhere: it is passed on with its text,
    and so is the first row, which another range may wait for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, shard = sampler(samples), TaskContext.get().partitionId()
        before, out = None, []
        schema = None
        for batch in batches:
            schema = _arrow(batch.schema.field(0).type)
            for doc_id, item in zip(batch.column(0), batch.column(1)):
                text = item.as_py()
                now = (doc_id.as_py(), text, work.fingerprint(text))
                if before is None:
                    out.append({"doc_id": now[0], "shard": shard, "place": "first", "text": text, "fingerprint": now[2]})
                else:
                    out.append({"doc_id": before[0], "shard": shard, "place": "done", **_row(work, before[1], before[2], text, now[2])})
                before = now
                if len(out) >= 1000:
                    yield _table(out, schema)
                    out = []
        if before is not None:
            out.append({"doc_id": before[0], "shard": shard, "place": "last", "text": before[1], "fingerprint": before[2]})
            yield _table(out, schema)

    return run


def _ends(samples: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = sampler(samples)
        for batch in batches:
            schema = _arrow(batch.schema.field(0).type)
            yield _table(
                [
                    {"doc_id": r["doc_id"], "shard": r["shard"], "place": "done", **_row(work, r["text"], r["fingerprint"], r["next_text"], r["next_fingerprint"])}
                    for r in batch.to_pylist()
                ],
                schema,
            )

    return run


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text of a document ends with the beginning of the next document by doc_id (after the last:
    the first). Fingerprints are binary, two bytes a sample, and empty for a text without words; equal
    texts have equal ones. near_* are likenesses from 0 to 1.

    Nulls: a null text counts as empty; rows without doc_id come first. Rows of equal doc_id are ordered
    by text. A single row follows itself. An empty table gives no rows; other columns are not read.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}"
    ordered = plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = stored(ordered.mapInArrow(_ranges(samples), schema), "fingerprints")
    done = rows.where("place = 'done'")
    first = rows.where("place = 'first'").select(F.col("shard").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    last = rows.where("place = 'last'").select("doc_id", "shard", "text", "fingerprint")
    all_ranges = Window.orderBy("shard")  # a row per range
    follows = last.select("shard").withColumn("next", F.lead("shard").over(all_ranges))
    follows = follows.withColumn("next", F.coalesce("next", F.min("shard").over(Window.partitionBy())))
    ends = last.join(follows, "shard").join(first, "next").select("doc_id", "shard", "text", "fingerprint", "next_text", "next_fingerprint")
    return done.union(ends.mapInArrow(_ends(samples), schema)).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )
