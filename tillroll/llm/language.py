"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The weights are learned by follow-the-regularised-leader (per-coordinate step sizes, L1 and L2), the
probabilities are calibrated with one temperature on rows that the weights have not seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = 2**15
LARGEST = 3  # n-grams of one to three characters
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@dataclass(frozen=True)
class LanguageSettings:
    """rows_per_language bounds the rows that weights are fitted on; document frequencies cover all."""

    rows_per_language: int = 1000
    calibration_share: float = 0.2
    passes: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.002
    min_score: float = 0.3


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # features by languages; most are 0
    bias: np.ndarray
    temperature: float


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of the lower-cased whole text: feature numbers and log(1 + count)."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    for size in range(1, LARGEST + 1):
        count = len(codes) - size + 1
        if count < 1:
            break
        mixed = np.full(count, size, np.uint32)
        for k in range(size):
            mixed ^= codes[k : k + count]
            mixed *= _MIX[k]
            mixed ^= mixed >> np.uint32(15)
        found.append(mixed & np.uint32(FEATURES - 1))
    if not found:
        return np.empty(0, np.int64), np.empty(0)
    counts = np.bincount(np.concatenate(found), minlength=FEATURES)
    at = np.flatnonzero(counts)
    return at, np.log1p(counts[at])


def _weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, tf = features(text)
    value = tf * idf[at]
    norm = np.sqrt(value @ value)
    return at, value / norm if norm else value


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, rows = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            seen[features(text.as_py())[0]] += 1
            rows += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1)), pa.array(np.append(seen[at], rows))], ["feature", "n"]
    )


def _follow_the_leader(rows, languages: int, settings: LanguageSettings) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal: z and n are kept for each weight, the weight follows from them when it is needed."""
    z, n = np.zeros((FEATURES + 1, languages)), np.zeros((FEATURES + 1, languages))

    def weights(at):
        rate = (settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2
        return np.where(np.abs(z[at]) <= settings.l1, 0, -(z[at] - np.sign(z[at]) * settings.l1) / rate)

    order = np.random.default_rng(7)
    for _ in range(settings.passes):
        for i in order.permutation(len(rows)):
            at, value, label = rows[i]
            at, value = np.append(at, FEATURES), np.append(value, 1.0)
            w = weights(at)
            error = _softmax(value @ w)
            error[label] -= 1
            gradient = value[:, None] * error[None, :]
            grown = n[at] + gradient**2
            z[at] += gradient - (np.sqrt(grown) - np.sqrt(n[at])) / settings.alpha * w
            n[at] = grown
    w = weights(np.arange(FEATURES + 1))
    return w[:-1], w[-1]


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss on held-back rows."""
    if not len(labels):
        return 1.0
    tried = np.geomspace(0.05, 5, 60)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in tried]
    return float(tried[int(np.argmin(loss))])


def fit_language_model(docs: DataFrame, settings: LanguageSettings = LanguageSettings(), seed: int = 11) -> LanguageModel:
    """Learn from the columns text and lang of docs; every other column is only used to draw rows.

    Document frequencies are counted over all rows that have a text and a lang. The weights are fitted on
    about `rows_per_language` different texts of each language, drawn by a hash of the text, and a text is
    drawn once however many copies it has; so at most that many times the number of languages (and a few)
    reach the driver. Rows without text or lang teach nothing; without any row the model knows no language
    and predicts `und`.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    counted = known.select("text").mapInArrow(_document_counts, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    totals = dict(zip(counted.column("feature").to_pylist(), counted.column("n").to_pylist()))
    documents = totals.pop(-1, 0)
    df = np.zeros(FEATURES)
    for at, n in totals.items():
        df[at] = n
    idf = np.log((1 + documents) / (1 + df)) + 1

    marked = known.withColumn("hash", F.xxhash64("text", F.lit(seed)))
    different = marked.select("lang", "hash").distinct().groupBy("lang").count()
    per_language = {r["lang"]: r["count"] for r in different.collect()}
    languages = tuple(sorted(per_language))
    if not languages:
        return LanguageModel((), idf, np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    draw = F.pmod(F.col("hash"), F.lit(1_000_000))
    share = F.lit(0)
    for lang in languages:
        cut = min(1_000_000, -(-1_000_000 * settings.rows_per_language // per_language[lang]))
        share = F.when(F.col("lang") == lang, F.lit(cut)).otherwise(share)
    drawn = marked.where(draw < share).dropDuplicates(["lang", "hash"]).toArrow().to_pylist()
    drawn.sort(key=lambda r: (r["lang"], r["text"]))
    rng = np.random.default_rng(seed)
    rng.shuffle(drawn)
    number = {lang: i for i, lang in enumerate(languages)}
    rows = [(*_weighted(r["text"], idf), number[r["lang"]]) for r in drawn]
    keep = {label: int(n * settings.calibration_share) for label, n in Counter(r[2] for r in rows).items()}
    held, fitted = [], []  # of each language the same share, and none of a language with few texts
    for row in rows:
        (held if keep[row[2]] > 0 else fitted).append(row)
        keep[row[2]] -= 1
    weights, bias = _follow_the_leader(fitted, len(languages), settings)
    logits = np.array([value @ weights[at] + bias for at, value, _ in held])
    return LanguageModel(languages, idf, weights, bias, _temperature(logits, np.array([r[2] for r in held])))


def _predictions(broadcast, kept: int, place: int, field: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                langs, scores = [], []
                column = part.column(place)
                for item in column.field(field) if field else column:
                    text = item.as_py()
                    if not model.languages or not has_letter(text):
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    at, value = _weighted(text, model.idf)
                    p = _softmax((value @ model.weights[at] + model.bias) / model.temperature)
                    best = int(p.argmax())
                    langs.append(model.languages[best])
                    scores.append(float(min(1.0, p[best])))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:kept], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    [*part.schema.names[:kept], "lang_pred", "score"],
                )

    return run


def predict_language(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` with lang_pred and score (0 to 1), from the whole text alone.

    text: the column of the text; `column.field` where it is in a kept struct that is never null, so that it goes to
    Python once. A null text or one without a letter is `und` with score 0. Equal rows get equal predictions; an empty
    table gives no rows.
    """
    holder, _, field = text.partition(".")
    rows = docs.select(*keep) if field else docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType(docs.select(*keep).schema.fields)
    schema = schema.add("lang_pred", T.StringType()).add("score", T.DoubleType())
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predictions(broadcast, len(keep), keep.index(holder) if field else len(keep), field), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id's text leaves 2 when divided by 4; a row without id is not held out."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(crc % 4 == 2, F.lit(False))


def identified(docs: DataFrame, settings: LanguageSettings = LanguageSettings()) -> DataFrame:
    """The documents whose language is known with at least `min_score`; rows and columns as given.

    The model is fitted on the documents that are not held out. Rows without a letter, without text, or
    in no language that the model is sure of go.
    """
    model = fit_language_model(docs.where(~held_out()), settings)
    rows = docs.select(F.struct(*docs.columns).alias("__row"))  # whole, as names may clash
    found = predict_language(rows, model, ["__row"], "__row.text")
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= settings.min_score)).select("__row.*")
