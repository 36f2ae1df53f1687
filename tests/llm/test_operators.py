"""Small fixtures with odd rows, each against a plain computation."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.plain import ROWS, groups_of, shingles
from pyspark.sql import functions as F

import corpus_pipeline
from tillroll.llm import chat_format, packing, secret_scan, source_mix
from tillroll.llm.exact_dedup import build_index, exact_duplicates, without_copies
from tillroll.llm.fingerprints import Sampler, edited, fingerprint_documents, likeness
from tillroll.llm.graph import components
from tillroll.llm.language import LanguageSettings, fit_language_model, held_out, identified, predict_language
from tillroll.llm.key_bits import by_keys
from tillroll.llm.ngram_join import linked, needed, ngram_jaccard_join, ngram_sets, one_of_each, postings
from tillroll.llm.token_ids import default_tokenizer, encoder
from tillroll.llm.token_output import document_keys, find_slots, perfect_hash, write_tokens
from tillroll.llm.toxicity import ToxicitySettings, fit_chain, predict_toxicity


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (None, 1), (3, 10), (20, 10)]
    found = dict(rows_of(components(spark.createDataFrame(edges, "a long, b long"), "a", "b")))
    assert found == {1: 1, 2: 1, 3: 1, 10: 1, 20: 1, 7: 7, 8: 7, 9: 7}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_ngram_join(docs):
    found = sorted(rows_of(ngram_jaccard_join(docs)), key=str)
    sets = [(r[0], shingles(r[1])) for r in ROWS]
    want = []
    for place, (i, s) in enumerate(sets):
        ids = [sets[k][0] for k in groups_of([x for _, x in sets])[place] if sets[k][0] is not None]
        links = sum(1 for k, (_, o) in enumerate(sets) if k != place and s and 100 * len(s & o) >= 80 * len(s | o))
        want.append((i, len(s), (min(ids) if ids else None) if s else i, links))
    assert found == sorted(want, key=str)


def test_ngram_join_keeps_one(docs, nothing):
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == {0: 1, 3: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 2, 11: 1, None: 1}
    assert ngram_jaccard_join(nothing).count() == 0 and one_of_each(nothing).count() == 0


def test_near_dedup_tells_texts_of_one_id_apart(spark):
    base = " ".join(f"w{i}" for i in range(60))
    other, third = " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60))
    rows = [(1, base), (5, base + " more"), (5, other), (7, third), (7, third + " more"), (8, third + " less"), (None, base), (9, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, set_id int, text_key string").repartition(3)
    kept = Counter((r["doc_id"], r["text"]) for r in one_of_each(docs).collect())
    assert kept.pop((7, third), 0) + kept.pop((7, third + " more"), 0) == 1
    assert kept == Counter([(1, base), (5, other), (None, base), (9, None)])


def test_the_chains_decide_the_groups(spark, docs):
    """With one key for all texts, only the comparison along its chain tells them apart."""
    index = build_index(docs, F.lit(7).cast("long")).collect()
    texts = {(t or "").encode() for _, t, *_ in ROWS}
    assert {bytes(r["text"]) for r in index} == texts and {r["key"] for r in index} == {7}
    assert sorted(r["chain"] for r in index) == list(range(1, len(texts) + 1)) and {r["links"] for r in index} == {len(texts)}
    many = spark.range(3000).selectExpr("id AS doc_id", "concat('t', id % 1000) AS text")
    key = F.xxhash64("text")
    buckets = Counter(r["bucket"] for r in build_index(many, key, 62).collect())
    assert sum(buckets.values()) == 1000 and max(buckets.values()) <= 62
    assert len({b.split(":")[0] for b in buckets}) > 1  # depths of their own
    assert {r["group_size"] for r in exact_duplicates(many, 50).collect()} == {3}


def test_exact_dedup_keeps_clashing_columns(docs):
    kept = without_copies(docs.withColumn("text_sha256", F.lit("own")).withColumn("keep_id", F.lit(1)))
    assert kept.columns[-2:] == ["text_sha256", "keep_id"] and {r["text_sha256"] for r in kept.collect()} == {"own"}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in without_copies(docs).collect())


def test_trie_finds_what_all_pairs_find():
    rng = random.Random(4)
    base = [rng.sample(range(400), 60) for _ in range(5)]
    sets = []
    for _ in range(80):
        s = set(rng.choice(base))
        for _ in range(rng.randint(0, 14)):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randint(0, 2000))
        sets.append(np.array(sorted(s), np.uint64))
    sets = [np.array(x, np.uint64) for x in {tuple(s) for s in sets}]
    for side in (np.zeros(len(sets), int), np.arange(len(sets)) % 2):
        got = {tuple(sorted((a, int(b)))) for a, hits in linked(sets, side) for b in hits}
        want = set()
        for a in range(len(sets)):
            for b in range(a):
                i = len(np.intersect1d(sets[a], sets[b]))
                if i >= needed(len(sets[a]), len(sets[b])) and (side.max() == 0 or side[a] != side[b]):
                    want.add((b, a))
        assert got == want and want


def test_join_counts_a_link_once_where_blocks_are_empty(spark, monkeypatch):
    rng, rows = random.Random(8), []
    for group in range(12):
        words = [f"g{group}w{i}" for i in range(60)]
        for _ in range(3):
            rows.append((len(rows), " ".join(words + [f"n{rng.random()}"])))
    monkeypatch.setattr("tillroll.llm.ngram_join.BLOCK_NGRAMS", 50)  # four blocks for three sets
    found = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["n_links"] for r in found} == {2}
    assert all(r["component_id"] == r["doc_id"] // 3 * 3 for r in found)


def test_only_ngrams_of_several_sets_are_posted_however_many(spark, monkeypatch):
    monkeypatch.setattr("tillroll.llm.ngram_join.MOST_COUNTED", 2, raising=False)  # a limit of old, as reached by 0.7 GB
    texts = [" ".join(f"d{d}w{i}" for i in range(80)) for d in range(30)]
    texts += [" ".join(f"c{i}" for i in range(80)), " ".join(f"c{i}" for i in range(81))]
    sets = ngram_sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    near = {bytes(r["set_id"]) for r in sets.where("doc_id >= 30").collect()}
    assert {bytes(r["set_id"]) for r in postings(sets).collect()} == near


def test_join_finds_all_links_in_small_blocks_with_a_common_line(spark, monkeypatch):
    for name, value in (("COUNT_SETS", 7), ("COUNT_NGRAMS", 300), ("FEW", 2), ("BLOCK_SETS", 9)):
        monkeypatch.setattr(f"tillroll.llm.ngram_join.{name}", value)
    rng, rows = random.Random(11), []
    line = [f"line{i}" for i in range(12)]
    for group in range(20):
        words = [f"g{group}w{i}" for i in range(rng.choice([3, 8, 20, 60]))]
        for _ in range(rng.randint(1, 7)):
            own = list(words)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = f"n{rng.randint(0, 5)}"
            rows.append((len(rows), " ".join(own + (line if rng.random() < 0.7 else []))))
    rows += [(None, rows[3][1]), (rows[4][0], rows[5][1]), rows[6]]
    sets = [shingles(t) for _, t in rows]
    want = []
    for place, (i, _) in enumerate(rows):
        ids = [rows[k][0] for k in groups_of(sets)[place] if rows[k][0] is not None]
        links = sum(1 for k, o in enumerate(sets) if k != place and 100 * len(sets[place] & o) >= 80 * len(sets[place] | o))
        want.append((i, len(sets[place]), min(ids), links))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(rows_of(ngram_jaccard_join(docs)), key=str) == sorted(want, key=str)
    assert sum(w[3] for w in want) > 60


def test_rows_of_other_keys_are_told_apart_without_a_join(spark):
    rows = spark.range(20_000).selectExpr("id", "id % 3 AS `a.b`")
    keys = rows.where("id % 40 = 7").select(F.xxhash64("id").alias("k"))
    may, none = by_keys(rows, F.xxhash64("id"), keys)
    assert may.columns == none.columns == rows.columns
    found, others = [r["id"] for r in may.collect()], [r["id"] for r in none.collect()]
    assert sorted(found + others) == list(range(20_000))
    assert {i for i in range(20_000) if i % 40 == 7} <= set(found) and len(found) < 1_200
    may, none = by_keys(rows, F.xxhash64("id"), keys.where("false"))
    assert may.count() == 0 and none.count() == 20_000


def test_near_dedup_shuffles_only_rows_that_may_go(spark):
    texts = [" ".join(f"d{d}w{i}" for i in range(40)) for d in range(200)]
    texts += [texts[3] + " more", texts[150] + " more"]
    docs = spark.createDataFrame(list(enumerate(texts))[::-1], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = [r["doc_id"] for r in one_of_each(docs).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(kept) == list(range(200))
    assert sum(a - 1 == b for a, b in zip(kept, kept[1:])) > 180  # the others stand as they stood


def test_language(spark, docs, nothing):
    rng = random.Random(1)
    words = {"en": ["the", "and", "thing", "when"], "de": ["der", "und", "nicht", "über"], "fr": ["les", "été", "où", "dans"]}
    rows = [(i, " ".join(rng.choices(words[k], k=30)), k) for i, k in enumerate(sorted(words) * 60)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_language_model(known.where(~held_out()), LanguageSettings(rows_per_language=60))
    held = predict_language(known.where(held_out()), model, ["doc_id", "lang"]).collect()
    assert held and all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in held)
    odd = predict_language(docs, model, ["doc_id", "size"]).collect()
    assert len(odd) == len(ROWS)
    assert {r["doc_id"] for r in odd if r["lang_pred"] == "und"} == {5, 6, 7, 11}
    empty = fit_language_model(nothing)
    assert {(r["lang_pred"], r["score"]) for r in predict_language(docs, empty, ["doc_id"]).collect()} == {("und", 0.0)}
    assert predict_language(nothing, model, ["doc_id"]).count() == 0
    kept = identified(known.withColumn("score", F.lit(1)), LanguageSettings(rows_per_language=60))
    assert kept.columns == ["doc_id", "text", "lang", "score"] and kept.count() == len(rows)


@pytest.mark.parametrize("bits,bucket", [(64, 20_000), (2, 1), (64, 1)])
def test_exact_dedup(docs, bits, bucket):
    found = sorted(rows_of(exact_duplicates(docs, bucket, bits)), key=str)
    ids = defaultdict(list)
    for i, t, *_ in ROWS:
        ids[t or ""].append(i)
    want = []
    for i, t, *_ in ROWS:
        own = ids[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert found == sorted(want, key=str)


def test_without_copies(docs, nothing):
    kept = without_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == {1: 1, 2: 1, 4: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 2, 11: 1}
    assert exact_duplicates(nothing).count() == 0 and without_copies(nothing).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(2)
    parts = ["<|im_start|>", "<|im_end|>", "<\\|im_end|>", "\\", "\n", "a", "<", "|im_", "é😀", "assistant", "\\n"]
    text = lambda: "".join(rng.choices(parts, k=rng.randint(0, 7)))
    rows = [(c, t, rng.choice(["user", "assistant", text()]), text()) for c in range(60) for t in range(rng.randint(1, 4))]
    rows += [(None, None, None, None), (0, 0, "user", None), (0, 0, "user", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, turns long")
    formatted = chat_format.format_conversations(df.unionByName(chat_format.conflicting(spark).withColumn("turns", F.lit(1).cast("long"))))
    got = {
        r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], r["loss"], r["formatted"])
        for r in formatted.withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    }
    want = defaultdict(list)
    for c, t, role, said in rows:
        want[c].append((-1 if t is None else t, role or "", said or ""))
    want[-1] = [(0, "user", "<|im_end|><|im_start|>assistant ok"), (1, "assistant", "<|im_end|><|im_start|>assistant ok")]
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert got[c][0] == [x[1:] for x in turns]
        assert got[c][1] == "".join(x[2] for x in turns if x[1] == "assistant")
        assert got[c][2].count("<|im_end|>") == got[c][2].count("<|im_start|>") == len(turns)
    assert chat_format.format_conversations(df.where("false")).count() == 0


def test_toxicity(spark, docs, nothing):
    rng = random.Random(3)
    plain = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(600):
        toxic, low = int(i % 4 == 0), int(i % 5 == 0)
        words = rng.choices(plain, k=25) + ["awfulish"] * toxic + ["!!!"] * low
        rng.shuffle(words)
        rows.append((i, " ".join(words), toxic, low))
    marked = spark.createDataFrame(rows, "doc_id long, text string, toxic int, low int")
    chain = fit_chain(marked.where("doc_id < 400"), marked, ["low", "toxic"], ToxicitySettings(l1=4.0))
    assert len(chain[1].chain) == 1
    found = predict_toxicity(marked.where("doc_id >= 400"), chain, ["low", "toxic"], ["doc_id"]).collect()
    assert all(r["toxic"] == (r["doc_id"] % 4 == 0) and r["low"] == (r["doc_id"] % 5 == 0) for r in found)
    assert predict_toxicity(docs, chain, ["low", "toxic"], ["doc_id"]).count() == len(ROWS)
    untaught = fit_chain(nothing, marked, ["low", "toxic"])
    assert {r["p_toxic"] for r in predict_toxicity(docs, untaught, ["low", "toxic"], ["doc_id"]).collect()} == {0.5}
    assert predict_toxicity(nothing, chain, ["low", "toxic"], ["doc_id"]).count() == 0


def test_trigram_queries():
    query = secret_scan.trigram_query
    assert query("AKIA[A-Z]+") == {frozenset({"aki", "kia"})}
    assert query("(secret|x[0-9]+token)") == {frozenset({"sec", "ecr", "cre", "ret"}), frozenset({"tok", "oke", "ken"})}
    assert query("[0-9a-f]+") is None and query("ab") is None and query("(abc)?") is None
    assert query("a_?bc") == {frozenset({"abc"}), frozenset({"a_b", "_bc"})}
    assert query("(abc)+x") == {frozenset({"abc"})}


def test_secret_scan(docs, nothing):
    found = sorted((r["doc_id"], r["s"]) for r in secret_scan.scan_secrets(docs.where("doc_id is not null")).select("doc_id", secret_scan.spans_text(F.col("spans")).alias("s")).collect())
    want = []
    for i, text, *_ in ROWS:
        if i is None:
            continue
        spans = []
        for order, rule in enumerate(secret_scan.RULES):
            for m in re.finditer(rule.pattern, text or ""):
                if len(m[rule.group]) >= rule.least:
                    spans.append((m.start(), order, rule.kind, m.end()))
        want.append((i, ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))))
    assert found == sorted(want)
    assert dict(want)[9] == "" and dict(want)[8].count("assign") == 2
    assert secret_scan.scan_secrets(docs).count() == len(ROWS) and secret_scan.scan_secrets(nothing).count() == 0


def test_source_mix(spark, docs, nothing):
    rows = [(i, "big" if i % 2 else f"s{i % 5}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    found = source_mix.mix_sources(df, {"big": 5, "s0": 2, "s2": 1, "s4": 0}, block_rows=2, cycle=64).collect()
    assert len(found) == 600
    taken = sorted((r["mix_position"], r["source"]) for r in found if r["in_mix"])
    assert [p for p, _ in taken] == list(range(len(taken))) and len(taken) > 200
    slots = {r["name"]: r["p"] for r in source_mix.source_slots(spark.createDataFrame([("big", 9), ("s0", 9), ("s2", 9)], "name string, n long"), {"big": 5, "s0": 2, "s2": 1}, 64).collect()}
    assert sum(slots.values()) == 64
    seen = Counter()
    for k, (_, name) in enumerate(taken[::2], 1):
        seen[name] += 1
        assert all(abs(seen[s] - k * p / 64) < 1 for s, p in slots.items())
    assert all(r["mix_released"] <= r["mix_slot"] < r["mix_due"] for r in found if r["mix_slot"] is not None)
    assert {r["source"] for r in found if r["mix_slot"] is None} == {"s1", "s3", "s4"} & {r["source"] for r in found}
    odd = source_mix.mix_sources(docs)
    assert odd.count() == len(ROWS) and set(docs.columns) < set(odd.columns)
    assert source_mix.mix_sources(nothing).count() == 0 and source_mix.mixed(docs).columns == docs.columns


def test_small_source_cuts_no_other(spark):
    """Sources of 1, 3 and 30 rows beside large ones: only what is beyond a quarter of all rows goes."""
    sizes = {"hot": 6001, "a": 2203, "b": 1998, "c": 1600, "few": 30, "": 3, "one": 1}
    rows = [(i, name or None) for i, name in enumerate(n for n, size in sizes.items() for _ in range(size))]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(3)
    targets = {name: min(size, len(rows) // 4) for name, size in sizes.items()}
    assert Counter(r["source"] or "" for r in source_mix.mixed(df).collect()) == targets
    found = sorted(source_mix.mix_sources(df, cycle=256).collect(), key=lambda r: r["mix_position"])
    assert [r["mix_position"] for r in found] == list(range(len(rows)))
    assert [r["in_mix"] for r in found] == [True] * sum(targets.values()) + [False] * (len(rows) - sum(targets.values()))
    assert all(r["mix_released"] <= r["mix_slot"] < r["mix_due"] for r in found)
    blocks = {(r["source"] or "", r["mix_block"]): r["mix_slot"] for r in found if r["in_mix"]}
    by_slot = {slot: name for (name, _), slot in blocks.items()}
    own = {name: -(-size // 4) for name, size in targets.items()}
    assert sorted(by_slot) == list(range(sum(own.values())))
    seen = Counter()
    for k in range(len(by_slot)):
        seen[by_slot[k]] += 1
        assert all(abs(seen[s] * len(by_slot) - (k + 1) * b) < len(by_slot) for s, b in own.items())


def test_pipeline_sends_texts_once_and_in_small_batches(spark):
    """The language stage hands a text to Python once, a few MB at a time, and returns every whole row."""
    words = F.when(F.col("id") % 2 == 0, F.lit("und der ")).otherwise(F.lit("the and "))
    text = F.concat(F.col("id").cast("string"), F.lit(" "), F.repeat(words, 12_000))
    df = spark.range(90).select(F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 2 == 0, "de").otherwise("en").alias("lang"))
    stage = dict(corpus_pipeline.STAGES)["language_id"]

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["held"])

    try:
        found = stage(spark, df, "")
        assert "__text" not in found._jdf.queryExecution().analyzed().toString()
        assert sorted(rows_of(found)) == sorted(rows_of(df))
        sizes = [r["held"] for r in df.coalesce(1).mapInArrow(held, "held long").collect()]
        assert sum(sizes) > 8e6 and max(sizes) < corpus_pipeline.BATCH_BYTES + 2e5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_pipeline_mixes_by_the_schedule(spark, docs, nothing):
    """The stage hands on each kept row's place in the schedule, and packing keeps it beside every piece."""
    sizes = {"hot": 61, "a": 22, "": 9, "one": 1}
    rows = [(i, f"text {i} " * (1 + i * 9), name or None) for i, name in enumerate(n for n, size in sizes.items() for _ in range(size))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    mixed = corpus_pipeline.source_mix(spark, df, "")
    want = {r["doc_id"]: (r["mix_slot"], r["mix_position"]) for r in source_mix.mix_sources(df.drop("text")).collect() if r["in_mix"]}
    found = mixed.collect()
    assert {r["doc_id"]: (r["mix_slot"], r["mix_position"]) for r in found} == want and len(found) == len(want) < len(rows)
    assert all(r["text"] == rows[r["doc_id"]][1] for r in found)
    pieces = corpus_pipeline.packing(spark, mixed, "").collect()
    assert {r["doc_id"]: (r["mix_slot"], r["mix_position"]) for r in pieces} == want and len(pieces) > len(want)
    odd = source_mix.in_schedule(docs).collect()
    kept = source_mix.mixed(docs)
    assert sorted(r["mix_position"] for r in odd) == list(range(kept.count()))
    assert Counter((r["doc_id"], r["source"]) for r in odd) == Counter((r["doc_id"], r["source"]) for r in kept.collect())
    assert source_mix.in_schedule(nothing).count() == 0


def earliest_due_first(sizes):
    """One slot after the other, with a heap of the released blocks."""
    total = sum(sizes.values())
    blocks = sorted((j * total // b, -(-(j + 1) * total // b), name, j) for name, b in sizes.items() for j in range(b))
    heap, found = [], []
    for slot in range(total):
        while blocks and blocks[0][0] <= slot:
            released, due, name, j = blocks.pop(0)
            heapq.heappush(heap, (due, name, j, released))
        due, name, j, released = heapq.heappop(heap)
        found.append((slot, name, j, released, due))
    return found


@pytest.mark.parametrize("seed, cycle", [(1, 8), (2, 64), (3, 1), (4, 2048)])
def test_cycles_make_up_one_schedule(spark, seed, cycle):
    rng = random.Random(seed)
    sizes = {f"s{i:02d}": rng.choice([1, 2, 3, rng.randint(1, 40), rng.randint(1, 300)]) for i in range(seed * 7)}
    blocks = spark.createDataFrame([*sizes.items(), ("none", 0)], "name string, b long")
    states = source_mix.cycle_states(blocks, cycle)
    found = sorted((r["slot"], r["name"], r["block"], r["released"], r["due"]) for r in source_mix.cycle_schedule(states).collect())
    assert found == earliest_due_first(sizes)
    seen, total = Counter(), len(found)
    for slot, name, _, released, due in found:
        seen[name] += 1
        assert released <= slot < due
        assert all(abs(seen[s] * total - (slot + 1) * b) < total for s, b in sizes.items())
    assert source_mix.cycle_states(blocks.where("b = 0"), cycle).count() == 0


def test_encoder_is_exact():
    own = encoder(default_tokenizer())
    rng = random.Random(5)
    parts = ["a", "B", " ", "  ", "\n", ",", ".", "'s", "'", "é", "1", "%%%", "\t", " ", "　", "日", "<|endoftext|>", "-", "\x1c", "½"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    assert [own.encode(t) for t in texts] == [own._whole([t])[0] for t in texts]


def ids_of(text):
    own = encoder(default_tokenizer())
    return own._whole([text or ""])[0] + (2).to_bytes(4, "little")


def test_token_output(docs, nothing):
    files = write_tokens(docs)
    found = sorted(((r["doc_id"], r["repeat"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in files.read(document_keys(docs)).collect()), key=lambda r: (r[2]))
    at, want = 0, []
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    for r in order:
        raw = ids_of(r[1])
        want.append((r[0], at, len(raw) // 4, raw))
        at += len(raw) // 4
    assert [(i, s, n, raw) for i, _, s, n, raw in found] == want
    strange = docs.limit(1).select(F.lit(999).cast("long").alias("doc_id"), F.lit(0).alias("repeat"))
    assert files.find(strange).count() == 0
    assert write_tokens(nothing).read(document_keys(nothing)).count() == 0


def test_token_output_of_many_blocks_and_wide_vocabularies(docs, monkeypatch):
    monkeypatch.setattr("tillroll.llm.token_output.BLOCK_BYTES", 64)
    wide = write_tokens(docs, width=4)
    assert wide.payload.count() > 4
    found = sorted(((r["start"], r["n_tokens"], bytes(r["ids"])) for r in wide.read(document_keys(docs)).collect()))
    at = 0
    for (start, n, raw), (_, text, *_) in zip(found, sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))):
        assert (start, n, raw) == (at, len(raw) // 4, ids_of(text))
        at += n
    with pytest.raises(Exception, match="does not fit"):
        write_tokens(docs, width=1)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, (2, 5000), dtype=np.uint64)
    sizes, bits, slots = perfect_hash(a, b)
    assert sorted(slots) == list(range(5000)) and (find_slots(a, b, sizes, bits) == slots).all()


def test_packing(spark, docs, nothing):
    pieces = packing.token_pieces(docs).withColumn("offset", F.lit("taken"))
    found = packing.pack(pieces).collect()
    per, filled = defaultdict(list), defaultdict(list)
    for r in found:
        per[r["doc_id"]].append((r["piece"], r["start"], r["length"], bytes(r["ids"])))
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text, *_ in ROWS:
        n = sum(1 for x in ROWS if x[0] == i)
        got = sorted(per[i])[::n]
        assert b"".join(x[3] for x in got) == ids_of(text) and all(x[2] == 1024 for x in got[1:])
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(packing.token_pieces(nothing)).count() == 0


def test_plan_uses_every_piece_once():
    rng = random.Random(6)
    for high in (5, 60, 64):
        counts = Counter(rng.randint(1, high) for _ in range(3000))
        patterns = packing.plan(dict(counts), 64)
        used = Counter()
        for lengths, n in patterns:
            assert sum(lengths) <= 64 and n > 0
            for x in lengths:
                used[x] += n
        assert used == counts
        assert sum(n for _, n in patterns) <= 1.02 * -(-sum(x * n for x, n in counts.items()) // 64) + 1
    assert packing.plan({}) == []


@pytest.mark.parametrize("seed", range(6))
def test_the_sum_index_finds_every_combination(seed):
    """While pieces are taken and `most` falls, against all combinations of the free lengths."""
    rng, high = random.Random(seed), 24
    index = packing.SumIndex(dict(Counter(rng.randint(1, high - 1) for _ in range(40))), high)
    for most in range(high - 1, 0, -1):
        for total in rng.sample(range(1, high), 8):
            pieces = [n for n in range(1, high) for _ in range(int(index.free[n]))]
            sums = {2: set(), 3: set()}
            for size in sums:
                for c in itertools.combinations(pieces, size):
                    if max(c) <= most and sum(c) == total:
                        sums[size].add(tuple(sorted(c, reverse=True)))
            assert index.single(total) == ((total,) if total in pieces else None)
            pair, triple = index.pair(total, most), index.triple(total, most)
            assert pair == max(sums[2], default=None) and triple == max(sums[3], default=None)
            for found in (pair, triple):
                if found and rng.random() < 0.2 and all(index.free[x] >= found.count(x) for x in found):
                    assert index.take(found) > 0


def test_the_plan_says_how_many_parts_it_uses():
    parts, plan = packing.best_plan({600: 2, 424: 2, 300: 1, 62: 2}, 1024)
    assert parts in (1, 2, 3) and sum(n for _, n in plan) == 3
    assert packing.best_plan({1000: 1, 8: 3}, 1024) == (3, [((1000, 8, 8, 8), 1)])


def test_fitting_draws_a_text_once(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["der", "und", "nicht"], k=9)) + str(i) for i in range(50)]
    rows = [(i, "the and thing " * 5, "en") for i in range(3000)] + [(i, t, "de") for i, t in enumerate(texts)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_language_model(known, LanguageSettings(rows_per_language=20))
    found = predict_language(known, model, ["lang"])
    assert found.where("lang != lang_pred").count() == 0


def test_fingerprints(docs, nothing):
    found = fingerprint_documents(docs.where("doc_id is not null and doc_id != 10")).collect()
    rows = sorted((r[0], r[1] or "") for r in ROWS if r[0] not in (None, 10))
    by_id = {r["doc_id"]: r for r in found}
    work = Sampler()
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        changed = edited(text, following)
        assert by_id[i]["n_chars"] == len(text)
        assert by_id[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert bytes(by_id[i]["edited_fingerprint"]) == work.fingerprint(changed)
        assert by_id[i]["near_next"] == likeness(work.fingerprint(text), work.fingerprint(following))
    assert fingerprint_documents(docs).count() == len(ROWS) and fingerprint_documents(nothing).count() == 0
    assert fingerprint_documents(docs.where("doc_id = 3")).first()["near_next"] == 1.0


def test_collisions_follow_the_weighted_jaccard():
    rng, work, off = random.Random(7), Sampler(), []
    for _ in range(150):
        a = Counter(rng.choices(range(60), k=120))
        b = a + Counter(rng.choices(range(60, 120), k=rng.randint(0, 200)))
        x, y = (" ".join(f"w{k}" for k in c.elements()) for c in (a, b))
        off.append(likeness(work.fingerprint(x), work.fingerprint(y)) - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.09


def test_fingerprints_tell_all_words_apart():
    work = Sampler()
    a, b = (" ".join(f"{k}{i}" for i in range(20_000)) for k in "xy")
    assert likeness(work.fingerprint(a), work.fingerprint(b)) <= 2 / 64
    words = [f"w{i}" for i in range(1500)]
    assert len({work.fingerprint(w) for w in words}) == len(words)
    small = Sampler(kept=256)  # what is kept, and the order of words, change nothing
    text = " ".join(words + words[:700])
    assert small.fingerprint(text) == work.fingerprint(text) == work.fingerprint(" ".join(reversed(text.split())))


def test_collisions_over_many_vocabularies():
    """One vocabulary of 120 words has 64 fixed samples, so its own mean is off by some 0.035; theirs together is not."""
    work, off = Sampler(), []
    for letter in "abcdefghijklmnopqrstuvwxyz!#$%&*+-/:;=?@":
        rng = random.Random(7)
        for _ in range(20):
            a = Counter(rng.choices(range(60), k=120))
            b = a + Counter(rng.choices(range(60, 120), k=rng.randint(0, 200)))
            x, y = (" ".join(f"{letter}{k}" for k in c.elements()) for c in (a, b))
            off.append(likeness(work.fingerprint(x), work.fingerprint(y)) - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.09


def test_crc_matches(spark):
    raw = ids_of("x y z")
    assert spark.createDataFrame([(raw,)], "ids binary").select(F.crc32("ids")).first()[0] == zlib.crc32(raw)


def test_encoder_cuts_only_where_the_tokenizer_does():
    """Random mixtures of spaces, line ends, letters and punctuation, against the tokenizer itself."""
    own = encoder(default_tokenizer())
    draw = random.Random(5)
    texts = ["", "\n", "a\n", "\na", " \n a", "a\n\nb", "a\n\n\nb", "a\n\tb\n 'sx", "x.\nY!! z\r\nq", "a\n\x1cb"]
    texts += ["".join(draw.choices("ab'sZé .,\n\t\r\x1c  1", k=draw.randint(0, 14))) for _ in range(5000)]
    assert [own.encode(x) for x in texts] == own._whole(texts)


def test_encoder_passes_once_over_the_words(monkeypatch):
    """Words are learned where they are looked up, each once; of three stores two are left, with the same ids."""
    from tillroll.llm import token_ids

    monkeypatch.setattr(token_ids, "_CACHED", 20)
    own = token_ids.Encoder(default_tokenizer())
    text = " ".join(["x", *["ab", "ab,", "é.", "1-2", "ab\nab"] * 3])
    assert own.encode(text) == own._whole([text])[0]
    learned = []
    learn, own.words.learn = own.words.learn, lambda word: learned.append(word) or learn(word)
    assert own.encode(text + " new new") == own._whole([text + " new new"])[0]
    assert learned == ["new"]  # the pass over known words calls nothing
    draw = random.Random(3)
    for _ in range(300):
        text = " ".join("".join(draw.choices("abcdé", k=draw.randint(1, 3))) + draw.choice(["", ",", "\n"]) for _ in range(6))
        assert own.encode(text) == own._whole([text])[0]
        assert len(own.words) <= 40 and not getattr(own.words.older, "older", None)


def test_encoder_learns_the_words_of_a_block_together(monkeypatch):
    """Letters once, with or without punctuation behind them, and in one string; blocks and merges across words change no id."""
    from tillroll.llm import token_ids

    own = token_ids.Encoder(default_tokenizer())
    asked, stems = [], own._stems
    own._stems = lambda words: asked.append(words) or stems(words)
    texts = ["A cat, a cat. the\ncat; né", "", "The cat: né! the cat's? a fjord\"", " a"]
    assert list(own.encode_all(texts)) == own._whole(texts)
    assert asked == [["cat", "a", "the", "né", "fjord"]]
    texts = ["漢" * 300, "x " + "y" * 300 + " z", ("ab" * 300 + " ") * 3]
    assert list(own.encode_all(texts)) == own._whole(texts) and max(map(len, own.words)) < 100  # long ones are not kept
    draw = random.Random(4)
    texts = ["".join(draw.choices("abé'Z.,;\"\n\t  1", k=draw.randint(0, 30))) for _ in range(2000)]
    monkeypatch.setattr(token_ids, "_BLOCK_CHARS", 40)
    monkeypatch.setattr(token_ids, "_STRING_WORDS", 3)
    monkeypatch.setattr(token_ids, "_CACHED", 100)
    assert list(own.encode_all(iter(texts))) == own._whole(texts)
    plain = token_ids.Encoder(default_tokenizer())
    plain.spaced[:] = False  # as if merges had crossed: the model takes them one by one
    assert list(plain.encode_all(texts)) == own._whole(texts)


def test_special_tokens_are_one_id():
    """Against a tokenizer as the file loads it."""
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(default_tokenizer()), encoder(default_tokenizer())
    assert np.frombuffer(own.encode("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]
    draw = random.Random(9)
    parts = ["<|endoftext|>", "<|endoftext", "a", "B.", " ", "  ", "\n", "\t", "é", "|>"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 9))) for _ in range(3000)]
    assert [np.frombuffer(own.encode(x), "<u4").tolist() for x in texts] == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
