"""Spelling variants of the words of a corpus, by asymmetric q-chunks.

1. Words are counted where they stand: one count per word and task leaves the tasks that read the texts.
2. Two words are near if one edit turns one into the other. The shorter (of equal length: the lesser) gives
   two disjoint chunks, its halves; the other gives its positional grams. One edit leaves a chunk whole,
   and moves it by one place at most: only the grams within that shift of a chunk's place are posted.
   Short chunks are common, so a chunk goes with what else one edit leaves: of the other half's two
   halves, one is whole too. Words meet under a chunk and that quarter, three quarters of a word, and are
   compared there; a pair that meets more than once counts at the first place.
3. A word's form is its most frequent near word if that is frequent enough; forms are followed to their end
   by doubling the steps, and every step multiplies the frequency, so few rounds do.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.scratch import stored

LEAST_LENGTH = 7
LEAST_COUNT = 2
TIMES = 10  # as frequent as this many times the word is its form
NOISE = 31  # one run in so many loses a code point
_MOST_WORDS = 200_000  # counted in a task before they go on


def _runs(doc_id: object, text: str, pattern: re.Pattern, least: int, noise: int) -> Iterator[tuple[str, int]]:
    """The words of a text that have `least` code points at least after the deletion, with their counts.

    A shorter run cannot give one, so only runs of that length are looked at.
    """
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in Counter(pattern.findall(text.encode().lower().decode())).items():
        h = zlib.crc32(word.encode(), seed)
        if h % noise == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < least:
                continue
        yield word, n


def _counted(least: int, noise: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(f"[a-zÀ-ÿ]{{{least},}}")  # bytes.lower() has lower-cased A-Z only
        counts: Counter[str] = Counter()

        def taken() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                for word, n in _runs(doc_id.as_py(), text.as_py() or "", pattern, least, noise):
                    counts[word] += n
                if len(counts) > _MOST_WORDS:
                    yield taken()
                    counts.clear()
        yield taken()

    return run


def word_counts(docs: DataFrame, least: int = LEAST_LENGTH, noise: int = NOISE) -> DataFrame:
    """word, n: how often each word of `least` code points or more occurs in all whole texts.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. Where `noise` divides the
    unsigned crc32 h of "doc_id:run", the code point h mod length of the run is deleted.
    """
    parts = docs.select("doc_id", "text").mapInArrow(_counted(least, noise), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _quarters(word: Column, size: Column, shift: Column) -> list[Column]:
    """What the four kinds of one edit leave of a word of `size` code points, in a word that is `shift` longer.

    An edit is in a quarter: in the fourth, the first half and the third are left, in the third the first
    half and the fourth, then the second half and either the first or the second. What stands behind the edit is moved by shift.
    """
    half = F.floor(size / 2).cast("int")
    third = half + F.floor((size - half) / 2).cast("int")
    first = F.floor(half / 2).cast("int")

    def part(start: Column, end: Column) -> Column:
        return F.substring(word, start + 1, end - start)

    return [
        F.concat(part(F.lit(0), half), part(half, third)),
        F.concat(part(F.lit(0), half), part(third + shift, size + shift)),
        F.concat(part(half + shift, size + shift), part(F.lit(0), first)),
        F.concat(part(half + shift, size + shift), part(first + shift, half + shift)),
    ]


def _posted(words: DataFrame, shift: int) -> DataFrame:
    """key, word, n, size: each word under what one edit leaves of it, as a word of `shift` code points less."""
    size = F.length("word") - shift
    keys = [F.xxhash64(size, F.lit(k), x) for k, x in enumerate(_quarters(F.col("word"), size, F.lit(shift)))]
    return words.select("word", "n", size.alias("size"), F.posexplode(F.array(*keys)).alias("kind", "key"))


def near_words(words: DataFrame) -> DataFrame:
    """a, b, a_n, b_n: every pair of words that one inserted, deleted or replaced code point turns into each
    other, once, with a the shorter or lesser. words: word (distinct, not null), n."""
    a = _posted(words, 0).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), "size", "kind")
    b = _posted(words, 0).unionByName(_posted(words, 1)).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    longer = F.length("b") - F.length("a")
    met = a.join(b, "key").where(((longer == 1) | ((longer == 0) & (F.col("a") < F.col("b")))) & (F.levenshtein("a", "b", 1) == 1))
    left, right = _quarters(F.col("a"), F.col("size"), F.lit(0)), _quarters(F.col("b"), F.col("size"), longer)
    first = F.lit(3)
    for k in (2, 1, 0):
        first = F.when(left[k] == right[k], k).otherwise(first)
    return met.where(F.col("kind") == first).select("a", "b", "a_n", "b_n")


def _ends(forms: DataFrame) -> DataFrame:
    """word, root: the last form that is reached from each word. forms: word, form (not null, no circles)."""
    current = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stored(current.join(onward, "root", "left").select("word", "root", "next"), "roots")
        current = joined.select("word", F.coalesce("next", "root").alias("root"))
        if joined.where(F.col("next").isNotNull()).limit(1).count() == 0:
            return current


def spelling_variants(
    docs: DataFrame, least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, noise: int = NOISE
) -> DataFrame:
    """Every word with the frequent word that it is a variant of.

    Returns word, form, root, n, n_near, form_n: form is the near word of largest n (ties: the first in
    code-point order) if its n is at least `times` the word's, else null; root follows forms to the last
    and is the word itself without any; n counts occurrences, n_near the near words, form_n is the form's n.

    Nulls: a null text has no words; a null doc_id counts as empty text before the colon. Repeated rows
    count each. An empty table gives no rows. Columns other than doc_id and text are not read. `times`
    must be above 1, so that forms cannot go in circles, and `least` 4 at least (ValueError).
    """
    if times <= 1 or least < 4:
        raise ValueError("times must be above 1 and least 4 at least")
    words = stored(word_counts(docs, least, noise).where(F.col("n") >= least_count), "words")
    pairs = near_words(words)
    ways = F.array(
        F.struct(F.col("a").alias("word"), F.col("b_n").alias("n"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("word"), F.col("a_n").alias("n"), F.col("a").alias("other")),
    )
    near = (
        pairs.select(F.explode(ways).alias("x"))
        .groupBy(F.col("x.word").alias("word"))
        .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("x.n")).alias("less"), F.col("x.other").alias("other"))).alias("best"))
    )
    enough = -F.col("best.less") >= F.col("n") * times
    with_form = stored(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best.other")).alias("form"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    roots = _ends(with_form.where(F.col("form").isNotNull()))
    return with_form.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
