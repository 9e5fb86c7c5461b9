"""Benchmark decontamination with DataFrame functions only: SimHash windows, Hamming blocks, exact verification.

1. Places: words of a document where a shingle of some benchmark item begins. A window as similar as asked shares most
   of its shingles with the item, and moving its start to the first shared shingle loses none, so windows that begin at
   a place are enough, and only in documents with at least as many places as the similarity asks shared shingles.
2. Windows: from each place, as many words as the items with that shingle have (shifted left at the end of a document).
   A window has a SimHash of its shingles, weighted by how often each occurs.
3. Multi-index Hamming blocks: fingerprints are cut into ``BLOCKS`` blocks of 16 bits. Two fingerprints within
   ``RADIUS`` bits differ by at most ``RADIUS // BLOCKS`` in some block, so items are entered under every number that
   near to each of their blocks and windows ask with their own: all items within the radius are found, with certainty.
4. Verification: the exact weighted similarity of the two bags of shingles, ``sum of least / sum of greatest`` counts.

Words are runs of letters and digits, lower-cased. Items and documents shorter than a shingle are one shingle.

The benchmark's shingles and the ids of documents with places are broadcast only where a count shows that they are few;
beyond that they are joined by a shuffle.

Defined results: null and blank texts contain nothing; blank items are never found; repeated documents are told apart by
id and text and rows of both repeated give one result; ties keep every item; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import small, stored, table

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 19
BLOCKS = 4
BLOCK_BITS = 16


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def shingles(array: str, size: int = SHINGLE_WORDS) -> Column:
    """Hashes of the shingles of an array column of words, in order; shorter arrays are one shingle."""
    parts = ", ".join(f"{array}[i + {k}]" for k in range(size))
    return F.expr(
        f"CASE WHEN size({array}) >= {size} THEN transform(sequence(0, size({array}) - {size}), i -> xxhash64({parts}))"
        f" WHEN size({array}) > 0 THEN array(xxhash64(concat_ws(' ', {array}))) ELSE array() END"
    )


def with_simhash(windows: DataFrame, key: list[str]) -> DataFrame:
    """``key`` and ``fp`` from a row ``(key, h)`` per shingle: bit by bit the sign of its sum, so repeats weigh more.

    Sixty-four plain sums: they are added up before the shuffle, which moves one row per window.
    """
    sums = [F.sum(F.shiftrightunsigned(F.col("h"), i).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"b{i}") for i in range(64)]
    summed = windows.groupBy(*key).agg(*sums)
    bits = None
    for i in range(64):
        bit = F.when(F.col(f"b{i}") > 0, F.lit((1 << i) if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return summed.select(*key, bits.alias("fp"))


def _block(fp: str, i: int) -> Column:
    return F.shiftrightunsigned(F.col(fp), i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def contained(
    documents: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, size: int = SHINGLE_WORDS
) -> DataFrame:
    """``(doc_id, text_hash, item_id, similarity, start, n_words)``: the best window of each document for each item."""
    split_items = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    split_items = stored(split_items.select("item_id", F.size("w").alias("n_words"), shingles("w", size).alias("item_hs")))
    wanted = small(stored(split_items.select(
        "item_id", "n_words", F.ceil(F.size("item_hs") * similarity - 1e-9).alias("need"), F.explode(F.array_distinct("item_hs")).alias("h")
    )))

    keyed = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    seen = keyed.select("doc_id", "text_hash", F.size("w").alias("doc_words"), F.posexplode(shingles("w", size)).alias("at", "h"))
    shared = seen.join(wanted, "h").groupBy("doc_id", "text_hash", "doc_words", "item_id", "n_words", "need").agg(F.collect_set("at").alias("at"))
    places = shared.filter(F.size("at") >= F.col("need")).withColumn("at", F.explode("at")).select(
        "doc_id", "text_hash",
        F.greatest(F.lit(0), F.least(F.col("at"), F.col("doc_words") - F.col("n_words"))).alias("start"),
        F.least(F.col("n_words"), F.col("doc_words")).alias("length"),
    )
    places = stored(places.distinct())

    ids = small(stored(places.select("doc_id", "text_hash").distinct()))
    texts = documents.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    texts = texts.alias("x").join(ids.alias("y"), F.expr("x.doc_id <=> y.doc_id AND x.text_hash = y.text_hash"), "left_semi")
    texts = texts.dropDuplicates(["doc_id", "text_hash"])
    split_texts = texts.select("doc_id", "text_hash", words(F.col("text")).alias("w")).select("doc_id", "text_hash", shingles("w", size).alias("hs"))
    p, t = places.alias("p"), split_texts.alias("t")
    window = ["doc_id", "text_hash", "start", "length"]
    windows = stored(p.join(t, F.expr("p.doc_id <=> t.doc_id AND p.text_hash = t.text_hash")).select(
        *[f"p.{k}" for k in window], F.expr(f"slice(t.hs, p.start + 1, greatest(1, p.length - {size - 1}))").alias("hs")
    ))

    item_prints = with_simhash(split_items.select("item_id", "n_words", F.explode("item_hs").alias("h")), ["item_id", "n_words"])
    window_prints = with_simhash(windows.select(*window, F.explode("hs").alias("h")), window)
    # all differences of a block within its share of the radius; a constant that the optimizer folds
    deltas = F.filter(F.sequence(F.lit(0), F.lit((1 << BLOCK_BITS) - 1)), lambda d: F.bit_count(d) <= radius // BLOCKS)
    index = item_prints.select(
        "item_id", F.col("fp").alias("item_fp"), F.col("n_words").alias("item_words"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _block("fp", i).alias("value")) for i in range(BLOCKS)])).alias("b"),
    ).select("item_id", "item_fp", "item_words", "b.block", F.explode(F.transform(deltas, lambda d: d.bitwiseXOR(F.col("b.value")))).alias("value"))
    asked = window_prints.select(
        *window, "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _block("fp", i).alias("value")) for i in range(BLOCKS)])).alias("b"),
    ).select(*window, "fp", "b.block", "b.value")
    candidates = (
        # thousands of rows an item, which no size estimate foresees: never broadcast
        asked.join(index.hint("merge"), ["block", "value"])
        .filter((F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius) & (F.col("length") <= F.col("item_words")))
        .select(*window, "item_id").distinct()
    )
    on = " AND ".join(["c.doc_id <=> w.doc_id", *(f"c.{k} = w.{k}" for k in window[1:])])
    both = candidates.alias("c").join(windows.alias("w"), F.expr(on)).join(split_items.alias("i"), F.expr("c.item_id = i.item_id"))
    both = both.select(*[f"c.{k}" for k in window], "c.item_id", "w.hs", "i.item_hs")
    # of each shared shingle the lesser of both counts; without repeats that is the size of the intersection
    plain = (F.size(F.array_distinct("hs")) == F.size("hs")) | (F.size(F.array_distinct("item_hs")) == F.size("item_hs"))
    counted = F.expr(
        "aggregate(array_intersect(hs, item_hs), 0, (n, x) -> n + least(size(filter(hs, y -> y = x)), size(filter(item_hs, y -> y = x))))"
    )
    shared = F.when(plain, F.size(F.array_intersect("hs", "item_hs"))).otherwise(counted)
    value = F.col("shared") / (F.size("hs") + F.size("item_hs") - F.col("shared"))
    best = both.withColumn("shared", shared).withColumn("similarity", value).filter(F.col("similarity") >= similarity)
    top = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "length")).alias("top")
    found = best.groupBy("doc_id", "text_hash", "item_id").agg(top)
    return found.select(
        "doc_id", "text_hash", "item_id", F.col("top.similarity").alias("similarity"), (-F.col("top.s")).alias("start"),
        F.col("top.length").alias("n_words"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contained(documents, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "item_id", F.round("similarity", 9).alias("similarity"), F.col("start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    found = stored(contained(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).select("doc_id", "text_hash").distinct())
    left, right = docs.alias("d"), small(found).alias("f")
    same = F.expr("d.doc_id <=> f.doc_id") & (F.xxhash64("d.text") == F.col("f.text_hash"))
    return left.join(right, same, "left_anti").select(*[F.col(f"d.{n}") for n in docs.columns])
