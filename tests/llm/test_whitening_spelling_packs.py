"""Whitening, spelling variants and shortest-pack-first packing against plain computations."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.plain import ROWS
from tokenizers import Tokenizer

from tillroll.llm.shortest_pack import pack_documents, patterns, places, plan
from tillroll.llm.spelling import near_words, spelling_variants, word_counts
from tillroll.llm.token_ids import default_tokenizer
from tillroll.llm.whitening import one_sided_jacobi, pivoted_cholesky, whiten

VECTORS = "vec_id long, embedding array<float>, label int, x binary, size int, n long"


def whitened_by_hand(vectors):
    """(n, components as columns, eigenvalues, deviation and whitened per vector) with plain numpy."""
    whole = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors]
    fit = np.array(sorted(set(whole)), float)
    n, sums = len(fit), [sum(x[k] for x in set(whole)) for k in range(len(whole[0]))]
    values, turned = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, turned = values[::-1], turned[:, ::-1]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in whole]
    white = (np.array(whole, float) - np.array(sums) / n) @ turned / np.sqrt(values)
    return n, values, deviation, white


def test_whitening(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 7)) * np.array([5, 3, 2, 1, 1, 0.5, 0.2])
    vectors = [list(map(float, v)) for v in [*base, *base[:20]]]
    odd = [None, [1.0, None, *[0.0] * 5], [float("nan"), *[0.0] * 6], [float("inf"), *[0.0] * 6], [1e30, *[0.0] * 6], [1.0, 2.0], []]
    rows = [(i, v, 0, None, 1, 2) for i, v in enumerate(vectors + odd)] + [(None, vectors[0], 0, None, 1, 2)]
    found = whiten(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    n, values, deviation, white = whitened_by_hand(vectors)
    assert n == 60 and len(found) == (len(vectors) + 1) * 4
    sign = {}
    for r in found:
        i, k = r["vec_id"] or 0, r["component"] - 1
        assert (r["n"], r["deviation"]) == (60, deviation[i])
        assert abs(r["explained"] - values[k] / values.sum()) < 1e-12 and r["identity_error"] < 1e-10
        sign.setdefault(k, 1 if r["whitened"] * white[i, k] > 0 else -1)
        assert abs(r["whitened"] - sign[k] * white[i, k]) < 1e-9


def test_whitening_of_little(spark):
    def found(vectors):
        return whiten(spark.createDataFrame([(i, v, 0, None, 1, 2) for i, v in enumerate(vectors)], VECTORS)).collect()

    assert found([]) == [] and found([None]) == [] and found([[], []]) == [] and found([[1.0, 2.0]] * 3) == []
    line = found([[0.0, 0.0], [1.0, 1.0], [1.0, 1.0]])  # rank one
    assert {(r["component"], r["n"], abs(round(r["whitened"], 9)), r["explained"]) for r in line} == {(1, 2, 1.0, 1.0)}
    far = found([[1e7, 0.0], [0.0, 1.0]])  # 64-bit entries
    assert {r["deviation"] for r in far} == {2_560_000_000**2 + 256**2}


def test_deviation_beyond_64_bits_raises(spark):
    rows = [(i, [1e9 * i, 0.0], 0, None, 1, 2) for i in range(3)]
    with pytest.raises(Exception, match="int"):
        whiten(spark.createDataFrame(rows, VECTORS)).collect()


@pytest.mark.parametrize("size", [1, 2, 5, 8, 33])
def test_cholesky_and_jacobi_give_the_eigenvectors(size):
    rng = np.random.default_rng(size)
    for rank in {1, max(1, size // 2), size}:
        half = rng.normal(size=(size, rank)) * np.logspace(0, -3, rank)
        matrix = half @ half.T
        factor = pivoted_cholesky(matrix)
        assert factor.shape == (size, rank) and np.allclose(factor @ factor.T, matrix, atol=1e-12)
        values, turned = one_sided_jacobi(factor)
        assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:rank], rtol=1e-9)
        assert np.allclose(turned.T @ turned, np.eye(rank), atol=1e-10)
        assert np.allclose(matrix @ turned, turned * values, atol=1e-12)
    assert pivoted_cholesky(np.zeros((size, size))).shape == (size, 0)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def variants_by_hand(rows, times=10, noise=31):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % noise == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    form, out = {}, {}
    for w, n in counts.items():
        others = sorted((-counts[o], o) for o in counts if near(w, o))
        if others and -others[0][0] >= times * n:
            form[w] = others[0][1]
        out[w] = [n, len(others)]
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (w, form.get(w), root, *out[w], counts.get(form.get(w)))
    return sorted(out.values(), key=str)


def test_spelling_variants(spark):
    rng, rows = random.Random(5), []
    base = ["Straßenbahn", "conversation", "naïveté×", "aaaaaaaa", "abababab", "ÀÉÎÕÜàéîõü", "rareword"]
    for i in range(900):
        words = []
        for w in rng.choices(base, [40, 30, 20, 10, 10, 10, 1], k=8):
            if rng.random() < 0.2:
                k, c = rng.randrange(len(w)), rng.choice("abéÿ")
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w.upper()])
            words.append(w)
        rows.append((i, " ".join(words) + " short " + "long" * (5000 if i == 7 else 2) + "1.b"))
    rows += [(3, None), (4, ""), (None, "conversation " * 3), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, word string, n long, key string").repartition(3)
    for times, noise in ((10, 31), (2, 3)):
        found = sorted(map(tuple, spelling_variants(docs, times=times, noise=noise).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)
        assert found == variants_by_hand(rows, times, noise) and any(r[1] for r in found)
    assert any(r[2] != r[1] and r[1] for r in found)  # a form that has a form
    assert spelling_variants(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        spelling_variants(docs, times=1)


def test_near_words_misses_no_edit(spark):
    rng = random.Random(9)
    words = set()
    while len(words) < 500:
        w = "".join(rng.choices("abé", k=rng.randint(4, 9)))
        k = rng.randrange(len(w))
        words |= {w, w[:k] + w[k + 1 :], w[:k] + "a" + w[k:], w[:k] + "b" + w[k + 1 :]}
    words = sorted(w for w in words if len(w) >= 4)
    found = near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()
    pairs = Counter(tuple(sorted((r["a"], r["b"]))) for r in found)
    assert set(pairs.values()) == {1}
    assert set(pairs) == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_word_counts_come_from_whole_texts(spark):
    docs = spark.createDataFrame([(1, "é" * 9 + " " + "filler " * 30_000 + "z" * 8)], "doc_id long, text string")
    assert {r["word"] for r in word_counts(docs, noise=10**9).collect()} == {"é" * 9, "z" * 8}


@pytest.mark.parametrize("seed", range(40))
def test_plan_uses_every_piece_and_pads_nothing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 4, 8, 16, 64])
    lengths = rng.sample(range(1, capacity), rng.randint(0, capacity - 1))
    counts = {n: rng.randint(1, rng.choice([2, 9, 80])) for n in lengths}
    pieces = [(n, r) for n, many in counts.items() for r in range(many)]
    held, used = defaultdict(list), defaultdict(list)
    length, rank = (np.array([p[k] for p in pieces], np.int64) for k in (0, 1))
    for columns in places(plan(counts, capacity), length, rank):
        for i, first, size, sequence, offset in zip(*[c.tolist() for c in columns]):
            held[sequence].append((offset, size))
            used[i].append((first, size))
    for place, n in enumerate(length):
        ends = [0] + [a + b for a, b in sorted(used[place])]
        assert [a for a, _ in sorted(used[place])] == ends[:-1] and ends[-1] == n
    sizes = Counter()
    for parts in held.values():
        ends = [0] + [a + b for a, b in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == ends[:-1]
        sizes[ends[-1]] += 1
    assert all(s == capacity or (s & (s - 1) == 0 and n == 1) for s, n in sizes.items())


def test_patterns_go_to_the_shortest_pack():
    assert sorted(patterns({5: 2, 3: 1, 2: 1}, 8)) == [(((5, 1), (2, 1)), 1), (((5, 1), (3, 1)), 1)]
    assert patterns({3: 5}, 8) == [(((3, 1),), 1), (((3, 2),), 2)]


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing_by_documents(docs, nothing, capacity):
    plain = Tokenizer.from_file(default_tokenizer())
    found = pack_documents(docs, capacity=capacity).collect()
    wanted = Counter()
    ids_of = {}
    for doc_id, text, *_ in ROWS:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        ids_of[(doc_id, len(ids))] = ids
        wanted.update((doc_id, len(ids), at) for at in range(len(ids)))
    got, sequences = Counter(), defaultdict(list)
    for r in found:
        ids = ids_of[(r["doc_id"], r["doc_tokens"])]
        own = ids[r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
        got.update((r["doc_id"], r["doc_tokens"], r["start"] + k) for k in range(r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == wanted
    for parts in sequences.values():
        ends = [0] + [a + b for a, b in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == ends[:-1]
        assert ends[-1] <= capacity and ends[-1] & (ends[-1] - 1) == 0
    assert pack_documents(nothing).count() == 0
    with pytest.raises(ValueError):
        pack_documents(docs, capacity=1000)
