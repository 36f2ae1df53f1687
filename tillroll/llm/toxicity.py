"""Toxicity by classifier chains of sparse linear models.

The categories are predicted one after another. The model of each category sees the features of the text
and the probabilities of the categories before it. It is trained with probabilities that models of the
other folds gave (out of fold), so that it learns to trust them as far as they hold on unseen texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = 2**20
STEMS = (4, 5, 6)  # beginnings of words: insults come with many endings
_WORD = re.compile(r"\w+|[^\w\s]+")  # words and runs of punctuation
_CACHED = 400_000


@dataclass(frozen=True)
class ToxicitySettings:
    """rows bounds the labelled documents that reach the driver for fitting."""

    rows: int = 12_000
    folds: int = 3
    passes: int = 3
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 12.0  # a word of a few documents weighs nothing
    l2: float = 0.1
    threshold: float = 0.5


@dataclass(frozen=True)
class Linear:
    weights: dict[int, float]  # by feature; only those that are not 0
    chain: np.ndarray  # for the logits of the earlier categories
    bias: float

    def score(self, features, earlier) -> float:
        z = self.bias + sum(self.weights[f] for f in features if f in self.weights)
        return float(1 / (1 + np.exp(-np.clip(z + self.chain @ _logits(earlier), -30, 30))))


def _logits(p) -> np.ndarray:
    p = np.clip(np.asarray(p, float), 0.001, 0.999)
    return np.log(p / (1 - p))


def _of_word(word: str) -> tuple[int, ...]:
    parts = {word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)}
    return tuple(map(_number, sorted(parts)))


def _number(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) & (FEATURES - 1)


def _features(texts: Iterator[str | None], cache: dict[str, tuple[int, ...]], wanted: set[int] | None = None):
    """The distinct features of each text: its words, their beginnings, and how many tenths of the words
    differ. `wanted` leaves out features that no model uses."""
    for text in texts:
        words = _WORD.findall((text or "").lower())
        distinct = set(words)
        found = {_number(f"# {10 * len(distinct) // max(1, len(words))}")}
        if wanted is not None:
            found &= wanted
        for word in distinct:
            own = cache.get(word)
            if own is None:
                own = _of_word(word)
                if wanted is not None:
                    own = tuple(f for f in own if f in wanted)
                if len(cache) >= _CACHED:
                    cache.clear()
                cache[word] = own
            if own:
                found.update(own)
        yield found


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[str, tuple[int, ...]] = {}
    for batch in batches:
        texts = (x.as_py() for x in batch.column(0))
        found = [np.array(sorted(f), np.uint32).tobytes() for f in _features(texts, cache)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *batch.columns[1:]], ["features", *batch.schema.names[1:]])


def _fit(rows: list[np.ndarray], earlier: np.ndarray, labels: np.ndarray, settings: ToxicitySettings) -> Linear:
    """Logistic regression by FTRL-proximal over features and the logits of earlier categories.

    L1 leaves out features seen a few times, so what is kept is what recurs in one class. Both classes
    weigh the same.
    """
    known, back = np.unique(np.concatenate(rows) if rows else np.empty(0, np.uint32), return_inverse=True)
    ends = np.cumsum([len(r) for r in rows])
    extra = earlier.shape[1] + 1
    z, n = np.zeros(len(known) + extra), np.zeros(len(known) + extra)
    tail = np.arange(len(known), len(known) + extra)
    limit = np.append(np.full(len(known), settings.l1), np.zeros(extra))

    def weights(at):
        rate = (settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2
        return np.where(np.abs(z[at]) <= limit[at], 0, -(z[at] - np.sign(z[at]) * limit[at]) / rate)

    positive = max(1, int(labels.sum()))
    balance = np.array([len(labels) / (2 * max(1, len(labels) - positive)), len(labels) / (2 * positive)])
    rng = np.random.default_rng(5)
    side = np.hstack([_logits(earlier), np.ones((len(rows), 1))])
    for _ in range(settings.passes):
        for i in rng.permutation(len(rows)):
            at = np.append(back[ends[i] - len(rows[i]) : ends[i]], tail)
            x = np.append(np.ones(len(rows[i])), side[i])
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - labels[i]) * balance[labels[i]] * x
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / settings.alpha * w
            n[at] = grown
    w = weights(np.arange(len(z)))
    kept = np.flatnonzero(w[: len(known)])
    return Linear({int(known[i]): float(w[i]) for i in kept}, w[len(known) : -1], float(w[-1]))


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], settings: ToxicitySettings = ToxicitySettings()) -> list[Linear]:
    """One linear model per category, in the order of `categories` (0/1 columns of labels).

    Labelled documents are drawn by a hash of doc_id, about settings.rows of them; rows without text or
    with a null label teach nothing, a doc_id that is labelled or present twice teaches twice. Without any
    labelled row every probability is 0.5.
    """
    marked = labels.select("doc_id", *categories).dropna()
    total = marked.count()
    share = min(1_000_000, -(-1_000_000 * settings.rows // max(1, total)))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share
    texts = docs.select("doc_id", "text").where(drawn & F.col("text").isNotNull()).join(marked.where(drawn), "doc_id")
    names = ", ".join(f"`{c}` int" for c in categories)
    table = (
        texts.select("text", *[F.col(c).cast("int").alias(c) for c in categories], "doc_id")
        .mapInArrow(_featurised, f"features binary, {names}, doc_id {texts.schema['doc_id'].dataType.simpleString()}")
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("features", "ascending")])
    )
    rows = [np.frombuffer(x, np.uint32) for x in table.column("features").to_pylist()]
    fold = np.arange(len(rows)) % settings.folds
    earlier = np.empty((len(rows), 0))
    chain = []
    for category in categories:
        wanted = table.column(category).to_numpy()
        chain.append(_fit(rows, earlier, wanted, settings))
        outside = np.full(len(rows), 0.5)
        if category != categories[-1]:
            for k in range(settings.folds):
                own = np.flatnonzero(fold != k)
                model = _fit([rows[i] for i in own], earlier[own], wanted[own], settings)
                for i in np.flatnonzero(fold == k):
                    outside[i] = model.score(rows[i].tolist(), earlier[i])
        earlier = np.hstack([earlier, outside[:, None]])
    return chain


def _scored(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = broadcast.value
        used = set().union(*(m.weights for m in chain))
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            found = []
            for features in _features((x.as_py() for x in batch.column(batch.num_columns - 1)), cache, used):
                p: list[float] = []
                for model in chain:
                    p.append(model.score(features, p))
                found.append(p)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))],
                [*batch.schema.names[:-1], "__p"],
            )

    return run


def predict_toxicity(docs: DataFrame, chain: list[Linear], categories: list[str], keep: list[str], threshold: float = 0.5) -> DataFrame:
    """The columns `keep` with p_<category> and <category> (probability of threshold or more) each.

    Whole texts are read. A null or empty text has no feature; its probability is that of the intercepts.
    Equal rows get equal results; an empty table gives no rows.
    """
    rows = docs.select(*keep, F.col("text").alias("__text"))
    schema = T.StructType(docs.select(*keep).schema.fields).add("__p", T.ArrayType(T.DoubleType()))
    broadcast = docs.sparkSession.sparkContext.broadcast(chain)
    scored = rows.mapInArrow(_scored(broadcast), schema)
    found = [x for i, c in enumerate(categories) for x in (F.col("__p")[i].alias(f"p_{c}"), (F.col("__p")[i] >= threshold).alias(c))]
    return scored.select(*keep, *found)
