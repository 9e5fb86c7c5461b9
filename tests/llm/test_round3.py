"""Tests for the findings of round 3."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veriloom.llm import importance, lm, toxicity
from veriloom.llm.common import connected_components, remainder


def _neighbourhoods(texts):
    seen = set()
    for text in texts:
        words = [b"", *(w.strip(b".,!?;:") for w in text.lower().encode().split()), b""]
        seen.update(zip(words, words[1:], words[2:], strict=False))
    return Counter(word for _, word, _ in seen), len(seen)


def test_contexts_match_sets_of_words():
    draw = random.Random(3)
    texts = ["", "  ", "?", "one", "One one. one", *[" ".join(draw.choices(["a", "b!", "C", "é", "..", "dd"], k=draw.randrange(60))) for _ in range(40)]]
    assert toxicity._contexts(texts) == _neighbourhoods(texts)
    assert toxicity._contexts([]) == (Counter(), 0)


def test_contexts_take_little_memory_a_word():
    draw = random.Random(4)
    texts = [" ".join(f"w{draw.randrange(3000)}" for _ in range(1000)) for _ in range(200)]
    tracemalloc.start()
    toxicity._contexts(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 * 200_000


@pytest.mark.parametrize("numbers", [[], [5], [0, 1, 1, 7], [9, 3, 1 << 40, -4], [(1 << 63) - 1, -(1 << 63)]])
def test_rising_numbers_come_back(numbers):
    assert lm._from_rising(lm._rising(np.array(numbers, np.int64))).tolist() == numbers


@pytest.mark.parametrize("shuffled", [False, True])
def test_language_model_probes_travel_small(shuffled):
    draw = np.random.default_rng(5)
    n, shards = 200_000, 62
    rows = np.sort(draw.integers(0, 2000, n)) + (3 << 33)
    if shuffled:
        draw.shuffle(rows)
    keys = draw.integers(0, shards, n).astype(np.uint64) << np.uint64(32) | draw.integers(0, 1 << 32, n).astype(np.uint64)
    after = np.minimum(draw.geometric(0.05, n), 130)
    lookup = lm._Lookup(lm.LogBloom(bytes(128)), 2, 1.0)
    lookup.add(rows, keys, after)
    batch = lookup.packed()
    sent = sum(len(pa.compress(batch.column(c)[i].as_py(), "lz4_raw", asbytes=True)) for c in (2, 3, 4) for i in range(batch.num_rows))
    assert sent < 6 * n
    found = []
    for i in range(batch.num_rows):
        shard, a, b, c = (batch.column(k)[i].as_py() for k in (0, 2, 3, 4))
        low = np.frombuffer(b, "<u4").astype(np.uint64)
        found += zip(lm._from_rising(a).tolist(), (np.uint64(shard) << np.uint64(32) | low).tolist(), lm._unpacked(c), strict=True)
    assert sorted(found) == sorted(zip(rows.tolist(), keys.tolist(), after.tolist(), strict=True))


def test_slices_of_a_shard_are_looked_up_together():
    draw = np.random.default_rng(6)
    keys = draw.integers(0, 1 << 32, 3000).astype(np.uint64)
    levels = draw.integers(1, 6, 2000)
    bloom = lm.LogBloom.of(keys[:2000], levels)
    gains = lm._Lookup(lm.LogBloom(bytes(128)), 2, 1.0)
    slices = []
    for part in np.array_split(np.arange(3000), 40):
        after = (part % 100 + 1).astype(np.uint8)
        slices.append((lm._rising(part), keys[part].astype("<u4").tobytes(), lm._packed(after.tobytes())))
    together = lm._met(bloom, gains, slices)
    alone = [np.concatenate(x) for x in zip(*[lm._met(bloom, gains, [s]) for s in slices], strict=True)]
    for one, other in zip(together, alone, strict=True):
        assert one.tolist() == other.tolist()
    assert set(range(2000)) <= set(together[0].tolist())


def test_a_filter_on_weights_does_not_weigh_texts_twice(spark):
    texts = spark.createDataFrame([(1, "a b c"), (2, None), (3, "d")], "doc_id long, text string")
    marked = importance.weighted(texts, np.arange(importance.BUCKETS) / 1e4)
    found = marked.filter("n_grams > 0").select("doc_id", "log_weight", "n_grams")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r["doc_id"], r["n_grams"]) for r in found.collect()) == [(1, 9), (3, 3)]


def test_dictionaries_are_trained_in_a_task_and_as_on_the_driver(spark, monkeypatch):
    rows = [(i, f"plain words of text {i % 9} and {i} more " * 12 + (f"blarg{i % 5} gronk {i}" * 6 if i % 3 == 0 else "")) for i in range(120)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    kept = [r.text for r in docs.join(marks, "doc_id").filter((remainder("doc_id", 4) != 2) & (F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5)) < 3))
            .orderBy("toxic", F.xxhash64("doc_id", F.lit(1))).collect()]
    toxic = [t for t in kept if "blarg" in t]
    want = toxicity.train_dictionaries(toxic, [t for t in kept if "blarg" not in t])

    def here(*_):
        raise AssertionError("trained on the driver")

    monkeypatch.setattr(toxicity, "train_dictionaries", here)
    got = toxicity.fit(docs.repartition(7), marks)
    assert toxic and (got.toxic, got.ordinary) == (want.toxic, want.ordinary)
    assert toxicity.fit(docs.repartition(7), marks, toxic_sample=3).toxic != want.toxic


def test_components_of_few_edges_take_few_tasks(spark):
    draw = random.Random(7)
    pairs = [(i, i + 1) for i in range(300) if i % 20] + [(1000, n) for n in range(1001, 1400)] + [(draw.randrange(2000, 2300), draw.randrange(2000, 2300)) for _ in range(140)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in pairs:
        if u != v:
            parent[max(root(u), root(v))] = min(root(u), root(v))
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        found = connected_components(spark.createDataFrame(pairs, "u long, v long"))
        assert {r.id: r.component for r in found.collect()} == {x: root(x) for x in list(parent)}
        assert found.limit(0).count() == 0 and connected_components(found.limit(0).toDF("u", "v")).count() == 0
        kept = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(found._jdf.queryExecution().optimizedPlan().collectLeaves())
        assert max(leaf.rdd().getNumPartitions() for leaf in kept) <= 2
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
