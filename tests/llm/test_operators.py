"""The ten operators against brute force, literal cases and empty, null, repeated and clashing input."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veriloom.llm import common, decontam, html, importance, lm, packing, quoting, simhash, toxicity, urls, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
NASTY = "zorblat grumfed skrenz".split()


def text_of(rng, n, extra=()):
    parts = ["ba", "lo", "mi", "ter", "un", "sa", "ko", "re"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)]
    for word in extra:
        words.insert(rng.randrange(len(words) + 1), word)
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        text = text_of(rng, rng.randint(30, 120), [rng.choice(NASTY) for _ in range(5)] if toxic else ())
        good = i % 7 != 3
        docs.append((i, text if good else text.upper().replace(" ", "!! "), "en", "a", len(text)))
        labels.append((i, int(good), int(toxic)))
    docs += [(400, None, None, None, None), (401, "", "en", "a", 0), (None, "some words without id", "en", "a", 3), docs[1], (402, docs[2][1], "en", "b", 1)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)


def test_toxicity_finds_marked_words_and_takes_any_row(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels)
    assert any(w.encode() in model.toxic for w in NASTY)
    rows = toxicity.scored(docs.withColumn("score", F.lit("clash")), model).select("doc_id", "toxicity", "toxic_predicted").collect()
    assert len(rows) == docs.count() and all(0 <= r.toxicity <= 1 for r in rows)
    right = [(r.doc_id % 8 == 0) == (r.toxic_predicted == 1) for r in rows if r.doc_id is not None and r.doc_id < 400]
    assert sum(right) / len(right) > 0.9


def test_toxicity_without_labels(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels.limit(0))
    assert {r.toxic_predicted for r in toxicity.scored(docs, model).select("toxic_predicted").collect()} == {0}
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_importance_keeps_good_and_drops_junk(corpus):
    docs, labels = corpus
    rows = importance.resampled(docs, labels).collect()
    assert len(rows) == docs.count()
    known = [r for r in rows if r.doc_id is not None and r.doc_id < 400]
    assert sum(r.selected for r in known if r.doc_id % 7 != 3) / sum(r.doc_id % 7 != 3 for r in known) > 0.95
    assert sum(r.selected for r in known if r.doc_id % 7 == 3) / sum(r.doc_id % 7 == 3 for r in known) < 0.1
    assert importance.resampled(docs, labels.limit(0)).filter("not selected").count() == 0
    assert importance.resampled(docs.limit(0), labels).count() == 0


def test_kth_largest_is_exact(spark):
    values = [random.Random(1).gauss(0, 1) for _ in range(500)] + [0.25] * 40
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 200, 540, 600):
        assert common.kth_largest(df, "v", k, bins=16) == sorted(values, reverse=True)[min(k, len(values)) - 1]
    assert common.kth_largest(df.limit(0), "v", 3) is None and common.kth_largest(df, "v", 0) is None


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7)]
    found = dict(common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {found[i] for i in range(61)} == {0} and {found[i] for i in (100, 150, 200)} == {100}
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_every_close_pair_meets_under_some_mask():
    masks = simhash.masks(2)
    for i in range(64):
        for j in range(i, 64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_simhash_components_match_brute_force(spark):
    rng = random.Random(3)
    base = text_of(rng, 400).split()
    texts = [" ".join(base[:k] + ["x"] + base[k:]) for k in range(0, 400, 8)] + [text_of(rng, n) for n in (1, 2, 3, 50, 50, 200)] + [None, "", " \n"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")

    def slow(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))

    prints = [slow(t) for t in texts]
    parent = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if bin(a ^ b).count("1") <= 2:
                    parent[i] = min(parent[i], parent[j])
    for row in simhash.near_duplicates(docs).collect():
        assert row.fp & (2**64 - 1) == prints[row.doc_id] and row.component_id == parent[row.doc_id]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_stage_keeps_one_of_each_group(spark):
    rng = random.Random(9)
    one, two, three, four = (text_of(rng, 60) for _ in range(4))
    rows = [(7, one), (3, one), (3, one), (None, one), (None, two), (None, two), (5, three), (5, four), (9, None), (8, ""), (6, four)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0, "h") for i, t in rows], DOCS + ", hash string")
    got = simhash.stage(spark, docs, "").collect()
    assert sorted(((r.doc_id is None, r.doc_id, r.text) for r in got), key=str) == sorted(
        [(False, 3, one), (True, None, two), (False, 5, three), (False, 5, four), (False, 8, "")], key=str
    )
    assert got[0].asDict().keys() == set(docs.columns) and {r.hash for r in got} == {"h"}
    assert simhash.stage(spark, docs.limit(0), "").count() == 0


def test_simhash_stage_groups_edited_copies(spark):
    rng = random.Random(17)
    texts = []
    for n in (20, 60, 100, 200, 400, 1000):
        base = text_of(rng, n).split()
        for edits in (0, 1, 1, 2, 3, 5, 8, 12, 20):
            copy = list(base)
            for at in rng.sample(range(n), edits):
                copy[at] = f"edit{rng.randrange(10**9)}"
            texts.append(" ".join(copy))
    common = text_of(rng, 30)
    texts += [f"{text_of(rng, 30)} {common}" for _ in range(40)] + [text_of(rng, k) for k in (1, 4, 5, 6)] + ["", None]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS)

    def bag(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    bags, parent, near = [bag(t) for t in texts], list(range(len(texts))), 0
    for _ in range(4):
        for i, a in enumerate(bags):
            for j, b in enumerate(bags):
                if a == b or 5 * len(a & b) >= 4 * len(a | b):
                    near += 0.8 <= len(a & b) / max(1, len(a | b)) < 0.95
                    parent[i] = parent[j] = min(parent[i], parent[j])
    assert near > 40
    assert sorted(r.doc_id for r in simhash.stage(spark, docs, "").collect()) == [i for i, p in enumerate(parent) if i == p]


def test_simhash_stage_finds_candidates_by_fingerprint(spark, monkeypatch):
    rng = random.Random(23)
    base = text_of(rng, 900).split()
    texts = [" ".join(base[:at] + ["other"] + base[at + 1 :]) for at in range(0, 900, 150)] + [text_of(rng, 80) for _ in range(12)]
    prints = [simhash._signed(simhash._majority([simhash.shingle_set(t)])) for t in texts]
    near = {(i, j) for i in range(len(texts)) for j in range(i) if bin((prints[i] ^ prints[j]) & (2**64 - 1)).count("1") <= 2}
    assert near and all(i < 6 for i, _ in near)
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS)
    seen, own = [], simhash.printed_pairs
    monkeypatch.setattr(simhash, "printed_pairs", lambda found: seen.append(own(found)) or seen[0])
    assert sorted(r.doc_id for r in simhash.stage(spark, docs, "").collect()) == [0, *range(6, 18)]
    at = {simhash._signed(xxhash.xxh64_intdigest(simhash.shingle_set(t).tobytes(), 42)): i for i, t in enumerate(texts)}
    pairs = {tuple(sorted((at[r.a_set_id], at[r.b_set_id]), reverse=True)) for r in seen[0].collect()}

    def reached(links):
        least = list(range(len(texts)))
        for _ in texts:
            for i, j in links:
                least[i] = least[j] = min(least[i], least[j])
        return least

    assert pairs <= near and reached(pairs) == reached(near)


def test_packing_is_a_round_trip(corpus):
    docs, _ = corpus
    from public_tokenizers import path
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path(packing.TOKENIZER))
    odd = ["don't STOP 12,5 ééÉ ÇA va ΑΣ İx ﬁ <|endoftext|> 東京 áb", "x" * 5000, "   ", "\n\n", "a.b,c;d?! ...", "word " * 9000]
    encode = packing.WordEncoder(path(packing.TOKENIZER))
    for text in odd * 2:
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    rows = packing.pack(docs.select("doc_id", "text").filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, found in pieces.items():
        ids = np.array(whole.encode(texts[doc] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0


def test_vector_limits_hold_without_cutting():
    rng = random.Random(2)
    placed = []
    packer = packing.Packer((100, 4, 30), 300, lambda *p: placed.append(p), cut=False)
    items = [(i, rng.randint(1, 60)) for i in range(200)]
    loss = {i: min(n, 30) // 3 for i, n in items}
    for i, n in items:
        packer.add(i, n, loss[i])
    packer.close()
    assert sorted((p[0], p[2]) for p in placed) == items
    bins = collections.defaultdict(list)
    for p in placed:
        bins[p[3]].append(p)
    assert all(sum(p[2] for p in b) <= 100 and len(b) <= 4 and sum(loss[p[0]] for p in b) <= 30 for b in bins.values())


def test_long_documents_are_cut_into_full_sequences():
    for tokens in (5000, 40_000, 1_000_000):
        placed = []
        packer = packing.Packer((2048, 256, 2048), 1 << 19, lambda *p: placed.append(p))
        packer.add("long", tokens, tokens - 1)
        assert [p[1:3] for p in placed] == [(at, 2048) for at in range(0, tokens - 2048, 2048)] and packer.waiting <= 2048
        packer.close()
        assert sum(p[2] for p in placed) == tokens and len({p[3] for p in placed[: tokens // 2048]}) == tokens // 2048


def test_a_loss_limit_binds_on_cut_documents():
    rng, placed = random.Random(4), []
    packer = packing.Packer((100, 50, 30), 2000, lambda *p: placed.append(p))
    items = {i: (n := rng.choice((5, 40, 90, 700)), rng.choice((n // 5, n - 1))) for i in range(120)}
    for i, (n, loss) in items.items():
        packer.add(i, n, loss)
    packer.close()
    sums, seen = collections.defaultdict(lambda: [0, 0, 0]), collections.Counter()
    for key, start, size, sequence, offset in placed:
        n, loss = items[key]
        assert offset == sums[sequence][0]
        for k, used in enumerate((size, 1, max(0, start + size - max(start, n - loss)))):
            sums[sequence][k] += used
        seen[key] += size
    assert seen == {i: n for i, (n, _) in items.items()}
    assert all(used <= limit for s in sums.values() for used, limit in zip(s, (100, 50, 30), strict=True))


def test_language_model_base_is_exact(corpus):
    docs, _ = corpus
    docs = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    trained = common.remainder("doc_id", 10) != 0
    for frequent in (1 << 17, 10):
        rows = lm.scored(docs.select("doc_id", "text", trained.alias("trained"), (~trained).alias("held_out")), frequent=frequent).collect()
        texts = {r.doc_id: r.text for r in docs.collect()}
        c = collections.Counter(t for d, x in texts.items() if zlib.crc32(str(d).encode()) % 10 for t in lm.tokens(x))
        n, v = sum(c.values()), len(c)
        assert len(rows) == len(texts)
        for r in rows:
            found = lm.tokens(texts[r.doc_id])
            want = sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in found)
            assert math.isclose(r.base_score, want, rel_tol=1e-9) and r.n_known == sum(c[t] > 0 for t in found) and r.train_tokens == n
            assert r.score <= 0 and math.isfinite(r.score)


def test_bloom_never_reads_less_than_was_entered():
    rng = np.random.default_rng(1)
    keys, counts = np.arange(2000, dtype=np.uint64), rng.integers(1, 10**6, 2000)
    bloom = lm.LogBloom.of(keys, lm.level(counts))
    read = bloom.levels(keys)
    assert (read >= lm.level(counts)).all() and (read == lm.level(counts)).mean() > 0.99
    assert (lm.value(lm.level(counts)) <= counts).all() and (lm.value(lm.level(counts)) * lm.BASE >= counts).all()
    assert (bloom.levels(np.arange(10**6, 10**6 + 20_000, dtype=np.uint64)) > 0).mean() < 0.001


def model_by_hand(texts, trained):
    """Score of each text from counts of tokens and pairs in dictionaries, with exact counts and with quantised ones."""
    single, pair = collections.Counter(), collections.Counter()
    for text in trained:
        found = lm.tokens(text)
        single.update(found)
        pair.update(zip(found, found[1:]))
    n = sum(single.values())
    new = min(0.5, max(sum(c == 1 for c in single.values()), 1) / (n + 1)) if n else 1.0

    def quantised(count):
        q = math.floor(math.log(count) / math.log(1.5) + 1e-9)
        return math.ceil(1.5**q - 1e-9)

    def rounded_up(count):
        return 1.15 ** math.ceil(math.log(count) / math.log(1.15) - 1e-9)

    out = []
    for text in texts:
        found, exact, coarse = lm.tokens(text), 0.0, 0.0
        for before, token in zip([None, *found], found):
            p = (1 - new) * single[token] / n if single[token] else new
            both, context = pair[before, token], single[before] if before is not None else None
            exact += math.log10(p if context is None else (both + lm.PRIOR * p) / (context + lm.PRIOR))
            gain = 1 + quantised(both) / (lm.PRIOR * (1 - new) * rounded_up(single[token]) / n) if both else 1
            coarse += math.log10(p if context is None else p * lm.PRIOR * gain / (context + lm.PRIOR))
        out.append((exact, coarse))
    return out


def test_language_model_sums_travel_packed(corpus):
    """What many shards find for a text goes back to it packed, not as rows that are then grouped by text."""
    docs, _ = corpus
    given = common.stored(docs.select("doc_id", "text", F.lit(True).alias("trained"), F.lit(False).alias("held_out")))
    plan = lm.scored(given, frequent=64, shard_tokens=2000)._jdf.queryExecution().optimizedPlan().toString()
    assert "probe(" in plan and "Aggregate [row#" not in plan


@pytest.mark.parametrize("sizes", [{}, {"frequent": 10}, {"frequent": 10, "shard_tokens": 500, "head_pairs": 64}, {"shard_tokens": 3000, "head_pairs": 8}])
def test_language_model_matches_counts_of_all_pairs(corpus, sizes):
    docs, _ = corpus
    texts = {r.doc_id: r.text for r in docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()}
    rows = [(i, t, bool(zlib.crc32(str(i).encode()) % 10)) for i, t in texts.items()]
    given = common.stored(docs.sparkSession.createDataFrame(rows, "doc_id long, text string, trained boolean").withColumn("held_out", ~F.col("trained")))
    got = {r.doc_id: r for r in lm.scored(given, **sizes).collect()}
    want = model_by_hand([t for _, t, _ in rows], [t for _, t, trained in rows if trained])
    off = 0
    for (i, text, _), (exact, coarse) in zip(rows, want, strict=True):
        off += not math.isclose(got[i].score, coarse, rel_tol=1e-9, abs_tol=1e-9)  # a false positive raises a score
        assert got[i].score > coarse - 1e-6 and coarse <= exact + 1e-9
        assert exact - coarse <= len(lm.tokens(text)) * math.log10(1.5 * 1.15) + 1e-9
    assert off <= 0.05 * len(rows)


def test_a_pair_of_rare_tokens_counts_at_every_size(spark):
    filler = [(i, text_of(random.Random(i), 40), True, False) for i in range(60)]
    seen = "qarvex mondulip fetchwick"
    rows = [*filler, (100, seen, True, False), (101, seen, False, True), (102, "mondulip qarvex fetchwick", False, True), (None, None, False, True), (100, seen, True, False)]
    docs = common.stored(spark.createDataFrame(rows, "doc_id long, text string, trained boolean, held_out boolean").withColumn("row", F.lit("clash")))
    got = {r.doc_id: r for r in lm.scored(docs).collect()}
    assert got[101].base_score == pytest.approx(got[102].base_score) and got[101].score > got[102].score + 2  # only the order differs
    assert got[None].n_tokens == 1 and len(lm.scored(docs).collect()) == len(rows)
    assert lm.scored(common.stored(docs.limit(0))).count() == 0
    unmet = lm.scored(common.stored(docs.withColumn("trained", F.lit(False)))).collect()
    assert len(unmet) == len(rows) and all(r.n_known == 0 and r.train_tokens == 0 and r.score == 0 for r in unmet)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(9)
    items = [(i, text_of(rng, rng.randint(12, 45))) for i in range(30)] + [(90, ""), (91, None), (92, "two words"), (93, "ba ba ba ba ba ba ba ba ba")]
    docs = []
    for i in range(80):
        w = text_of(rng, rng.randint(5, 150)).split()
        if i % 2:
            copy = items[i % 30][1].split()
            if i % 4 == 1:
                copy[len(copy) // 2 if i % 3 else -1] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = copy
        docs.append((i, " ".join(w).capitalize() + "."))
    docs += [(200, None), (201, ""), (202, "Two, WORDS!"), (203, "ba ba ba ba ba ba ba ba ba ba ba"), (1, docs[1][1]), (None, items[3][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contained(d, b).collect()}

    def split(t):
        return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]

    def bag(w):
        return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()

    want = {}
    for doc, text in docs:
        w = split(text)
        for item, other in items:
            o = split(other)
            for s in range(max(1, len(w) - len(o) + 1)) if o and w else ():
                x, y = bag(w[s : s + len(o)]), bag(o)
                value = sum((x & y).values()) / sum((x | y).values())
                if value >= 0.8:
                    want[doc, item] = max(value, want.get((doc, item), 0))
    assert set(got) <= set(want) and all(math.isclose(got[k], want[k]) for k in got)
    assert {k for k, v in want.items() if v > 0.9} <= set(got) and len(got) >= 0.95 * len(want)
    assert decontam.contained(d.limit(0), b).count() == 0 and decontam.contained(d, b.limit(0)).count() == 0


def test_quotes_link_to_what_they_quote(spark):
    rows = [
        (1, 0, "u", "Hello there my friend\nSecond line of text"), (1, 1, "a", "On Monday Bob wrote:\n> Hello there my friend\n\nHi Bob, good to see you"),
        (1, 2, "u", "> > Hello there my friend\n> Hi Bob, good to see you\nThanks a lot to you"), (None, None, None, None), (2, 0, "u", "> Nobody said this line\nbody"),
        (1, 1, "a", "On Monday Bob wrote:\n> Hello there my friend\n\nHi Bob, good to see you"),
    ]
    schema = "conv_id long, turn long, role string, text string"
    found = quoting.linked(spark.createDataFrame(rows, schema)).collect()
    by = {(r.conv_id, r.turn): r for r in found}
    assert len(found) == len(rows)
    assert by[1, 1].body == "Hi Bob, good to see you" and (by[1, 1].parent_turn, by[1, 1].depth) == (0, 1)
    assert (by[1, 2].parent_turn, by[1, 2].depth, by[1, 2].levels_linked, by[1, 2].thread_turn) == (1, 2, 2, 0)
    assert by[2, 0].parent_turn is None and by[2, 0].quoted_lines == 1 and by[None, None].body == ""
    assert quoting.linked(spark.createDataFrame([], schema)).count() == 0


def test_short_quotes_link_and_threads_are_ordered(spark):
    rows = [
        (5, 0, "u", "Is it far?"), (5, 1, "a", "> Is it far?\nYes."), (5, 2, "u", "> Yes.\nThanks"), (5, 3, "a", "> Thanks\n42 km"),
        (5, 4, "u", "> Is it far?\nNo idea, sorry"), (5, 2, "u", "> Yes.\nThanks"), (None, 0, "u", "Yes."), (6, 0, "u", "a new thread"),
    ]
    found = quoting.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(found) == len(rows)
    by = {(r.conv_id, r.turn): (r.parent_turn, r.depth, r.thread_turn, r.levels_linked, r.position) for r in found if r.conv_id}
    assert by == {
        (5, 0): (None, 0, 0, 0, 0), (5, 1): (0, 1, 0, 1, 1), (5, 4): (0, 1, 0, 1, 2), (5, 2): (1, 2, 0, 1, 3), (5, 3): (2, 3, 0, 1, 4),
        (6, 0): (None, 0, 0, 0, 0),
    }
    assert [r.position for r in found if r.conv_id is None] == [None]


LONG_LINE = "the ferry to the northern island leaves at a quarter past nine"


def test_short_lines_link_within_their_conversation_only(spark):
    rows = [
        (1, 0, "u", f"Thanks\n{LONG_LINE}"), (1, 1, "a", "Yes.\n\nSee you at the old harbour\nnear the red lighthouse"),
        (2, 0, "u", "Hello"), (2, 1, "a", "> Thanks\nYou are welcome"), (2, 2, "u", "> Thanks\n> Yes.\nwell"),
        (3, 4, "u", f"> {LONG_LINE.upper()}\nI know"), (4, 0, "a", "> See you at\n> the old harbour near the\n> red lighthouse\nfine"),
        (5, 0, "u", "> > Yes.\n> Thanks\n>\n> Yes.\nno"), (6, 1, "u", f"> {LONG_LINE}\n"), (6, 0, "a", LONG_LINE),
    ]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit("clash")).withColumn("h", F.lit(1))
    got = {(r.conv_id, r.turn): (r.parent_conv, r.parent_turn) for r in quoting.linked(docs).collect()}
    assert {k: v for k, v in got.items() if v[0] is not None} == {(3, 4): (1, 0), (4, 0): (1, 1), (6, 1): (6, 0)}


def test_quote_links_match_brute_force(spark):
    rng = random.Random(3)
    shorts = ["Yes.", "Thanks", "No idea", "42 km"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 6)):
            own = "\n".join(rng.choice(shorts) if rng.random() < 0.4 else text_of(rng, rng.randint(2, 12)) for _ in range(rng.randint(1, 3)))
            if rows and rng.random() < 0.7:
                source = rng.choice([r for r in rows if r[0] == conv] or rows) if rng.random() < 0.7 else rng.choice(rows)
                quote = source[3].splitlines() if rng.random() < 0.5 else " ".join(source[3].splitlines()).split("  ")
                own = "\n".join([*(["On Monday Bob wrote:"] if rng.random() < 0.5 else []), *("> " + line for line in quote), own])
            rows.append((conv, turn, "u", own))
    parsed = {(c, t): quoting.parse(x) for c, t, _, x in rows}
    says = {k: quoting.said(body) for k, (body, _) in parsed.items()}
    want = {}
    for k, (_, quoted) in parsed.items():
        votes = collections.defaultdict(collections.Counter)
        for (level, passage), size in quoting.asked(quoted).items():
            near = [o for o in says if o[0] == k[0] and o[1] < k[1] and passage in says[o]]
            far = [o for o in says if o[0] < k[0] and passage in says[o]] if len(passage) >= 40 else []
            if near or far:
                votes[level][min(near or far)] += size
        if votes:
            first = votes[min(votes)]
            want[k] = min(first, key=lambda o: (-first[o], o))
    found = quoting.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(want) > 30 and {(r.conv_id, r.turn): (r.parent_conv, r.parent_turn) for r in found if r.parent_conv is not None} == want


def test_main_text():
    long = "Many words stand here in a row to make a paragraph that is long enough. " * 3
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href=x>Menu</a></ul></nav>"
        f"<div class='cookie-notice'>We use cookies</div><article><header><h1>Head &amp; tail</h1></header><p><b>{long}<br><p>Short  one.</p>"
        f"<form><label>Name</label><input></form><div id=comments><p>{long}</p></div></article><aside>{long}</aside><footer>&copy; x</footer></body></html>"
    )
    assert html.main_text(page) == f"Head & tail {long.strip()} Short one."
    assert [html.main_text(p) for p in (None, "", "<nav>only</nav>", "<p")] == [""] * 4
    assert html.main_text(f"<div class=menu>a b</div><h2>Title</h2><p>{long}</p><div class=footer>x</div>") == f"Title {long.strip()}"


def test_urls(spark):
    cases = {
        "http://a.example.net/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"), "https://Example.NET/fr?x": ("example.net", "/fr", "net/", "block"),
        "http://x.example.com/de/9#t": ("x.example.com", "/de/9", "example.com/de/", "block"), "http://b.org/fr/": ("b.org", "/fr/", "org/fr/", "allow"),
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "ftp://notexample.com/de/": ("notexample.com", "/de/", None, None), "": ("", "", None, "allow"),
        "http://cheap-pills.example.org/en/1": ("cheap-pills.example.org", "/en/1", None, "block"),
    }
    fill = [f"http://site{i}.example.net/en/page{i}" for i in range(60)] + [f"http://shop{i}.other.net/x{i}" for i in range(60)] + [f"http://town{i}.org/fr/{i}" for i in range(60)]
    df = spark.createDataFrame([(u,) for u in [*cases, *fill]], "url string").withColumn("host", F.lit("clash"))
    rows = {r.url: r._url for r in urls.judged(df).collect()}
    for url, (host, path, rule, verdict) in cases.items():
        assert (rows[url].host, rows[url].path, rows[url].rule) == (host, path, rule) and verdict in (None, rows[url].verdict)
    assert urls.judged(df.limit(0)).count() == 0


def test_url_threshold_is_the_same_rule_at_every_size():
    for n in (10, 1000):
        good, bad = np.linspace(-1, -0.6, n).tolist(), np.linspace(0.4, 1, n).tolist()
        assert urls.best_threshold(good, bad) == 0.0
    rng = random.Random(6)
    for n in (5, 60, 450):
        good, bad = ([round(rng.gauss(m, 1), 2) for _ in range(n + m)] for m in (0, 1))
        want = min(sorted({0.0, *good, *bad}), key=lambda p: (sum(g > p for g in good) * len(bad) + sum(b <= p for b in bad) * len(good), abs(p)))
        assert urls.best_threshold(good, bad) == want


def test_url_models_know_all_texts(spark):
    rng = random.Random(31)
    rows = [(f"{rng.choice(['site', 'town', 'pill'])}{i}.{rng.choice(['net', 'org'])}/{rng.randrange(30)}", rng.choice(["allow", "block", None])) for i in range(150)]
    got = urls.scored(spark.createDataFrame(rows, "text string, verdict string"), seeds=["spam"]).collect()
    half = {r.text: r.half for r in got}

    def model(verdict, halves):
        weights = {t: 1 for t, v in rows if v == verdict and half[t] in halves} | ({"spam.example.com": 20} if verdict == "block" else {})
        counts = {}
        for text, weight in weights.items():
            p = "\n" * 5 + text + "\n"
            for i in range(5, len(p)):
                for k in range(6):
                    following = counts.setdefault(p[i - k : i], {})
                    following[p[i]] = following.get(p[i], 0) + weight
        return counts

    def mean(counts, text):
        p, total = "\n" * 5 + text + "\n", 0.0
        for i in range(5, len(p)):
            q = 1 / 4096
            for k in range(6):
                c = counts.get(p[i - k : i])
                if c:
                    q = (c.get(p[i], 0) + len(c) * q) / (sum(c.values()) + len(c))
            total += np.log(q)
        return total / (len(p) - 5)

    models = {name: (model("allow", halves), model("block", halves)) for name, halves in (("0", {0}), ("1", {1}), ("", {0, 1}))}
    for r in got:
        for name, (accepted, rejected) in models.items():
            assert abs(r[f"difference{name}"] - (mean(rejected, r.text) - mean(accepted, r.text))) < 1e-8
    cross = [(r.verdict, r.difference1 if r.half == 0 else r.difference0) for r in got]
    want = urls.best_threshold(*[[d for v, d in cross if v == verdict] for verdict in ("allow", "block")])
    assert urls.fitted_threshold(spark.createDataFrame(got).repartition(3)) == want


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((6, 32))
    rows = [(i, (centre[i % 6] + 0.08 * rng.standard_normal(32)).astype("float32").tolist(), i % 2) for i in range(240)]
    rows += [(300 + i, rows[0][1], 0) for i in range(30)]
    odd = [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, rows[0][1], None), (904, [None] * 32, 0), (905, [], 0), (906, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    for chunk in (1500, 16):
        got = {r.vec_id: r for r in vectors.near_duplicates(df, chunk=chunk).collect()}
        x = np.array([r[1] for r in rows], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        label = np.array([r[2] for r in rows])
        want = ((x @ x.T >= 0.98) & (label[:, None] == label)).sum(axis=1) - 1
        links = np.array([got[r[0]].n_links for r in rows])
        assert (links <= want).all() and links.sum() >= 0.9 * want.sum()
        assert all(got[o[0]].n_links == 0 and got[o[0]].kept for o in odd)
        assert {got[300 + i].component_id for i in range(30)} == {got[0].component_id}
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_pipeline_keeps_clean_documents_and_drops_what_its_stages_find(spark, tmp_path):
    """Nulls, repeats, extra and clashing columns, a toxic text, near copies and a benchmark passage in one small corpus."""
    import corpus_pipeline

    rng = random.Random(8)
    item = text_of(rng, 40)
    clean = [text_of(rng, rng.randint(40, 90)) for _ in range(240)]
    docs = [(i, t, "en", "a", len(t), "x", 0.5) for i, t in enumerate(clean)]
    docs += [(1000 + i, text_of(rng, 60, [rng.choice(NASTY) for _ in range(9)]), "en", "a", 1, "x", 0.5) for i in range(60)]
    docs += [(2000, f"{clean[0]} {item} {clean[1]}", "en", "b", 1, "x", None)]
    docs += [(2001, clean[5], "en", "b", 1, "x", None), (2002, clean[6] + " more", "en", "b", 1, None, None), docs[7], (2003, None, None, None, None, None, None), (None, "a text without any id", "en", "b", 1, "x", 1.0)]
    labels = [(i, 1, 0) for i in range(240)] + [(1000 + i, 1, 1) for i in range(60)]
    spark.createDataFrame(docs, f"{DOCS}, toxicity string, log_weight double").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in pieces}
    assert not kept & {2000, 2001, 2002} and len(kept & set(range(240))) >= 238
    assert sum(1000 <= d < 1060 for d in kept if d is not None) <= 12
    assert None in kept and 2003 in kept
    whole = collections.Counter()
    for r in pieces:
        whole[r.doc_id] += r.length
    assert all(whole[r.doc_id] == r.doc_tokens for r in pieces)

    empty = tmp_path / "empty"
    for name, kind in (("documents", DOCS), ("labels", LABELS), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).collect() == []
