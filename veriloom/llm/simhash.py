"""SimHash near-duplicates found with covering locality-sensitive hashing.

A fingerprint has 64 bits. Each bit position gets a vector of ``radius + 1`` bits, not all zero; each non-zero
vector ``v`` of that length gives a mask of the positions whose vector has an odd product with ``v``. Any set of
``radius`` positions is missed by some mask, because ``radius`` linear equations in ``radius + 1`` unknowns have a
solution other than zero. So two fingerprints that differ in at most ``radius`` bits are equal under some mask:
every pair collides in some table, with certainty.

Defined results: null and blank texts have fingerprint zero and link like any other; texts with fewer words than a
shingle are hashed whole; repeated rows keep one row each and share a component; a null id never becomes a
component's name unless all its members are null; empty tables give empty results.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import connected_components, small, stored, whole_texts

SHINGLE_WORDS = 3
RADIUS = 2
HASH_SEED = 42
CHUNK = 1 << 16
STAGE_WORDS = 5
STAGE_SIMILARITY = 0.8
SAMPLED = 16
CROWDED = 4
MOST_CROWDED = 1 << 17


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Majority bits over the shingle hashes of one text, as an unsigned number."""
    return _majority(_hashes(text, words))


def _majority(parts: Iterable[np.ndarray]) -> int:
    """Bits set in more than half of all hashes, which come a chunk at a time."""
    counts, n = np.zeros(64, np.int64), 0
    for part in parts:
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(sum(1 << int(i) for i in np.flatnonzero(counts * 2 > n)))


def _hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of one text in order, a chunk at a time; none for a blank text."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return
    flat = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        yield np.array([digest(flat[a:b], HASH_SEED) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)], "<u8")


def shingle_set(text: str | None, words: int = STAGE_WORDS) -> np.ndarray:
    """The distinct shingle hashes of one text, sorted, as signed numbers."""
    parts = list(_hashes(text, words))
    return np.unique(np.concatenate(parts).view(np.int64)) if parts else np.zeros(0, np.int64)


def with_fingerprints(documents: DataFrame, text: str = "text", words: int = SHINGLE_WORDS) -> Column:
    """A column of fingerprints as signed 64-bit numbers."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch], np.uint64)
            yield pd.Series(found.view(np.int64))

    return run(documents[text])


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The covering masks: ``2 ** (radius + 1) - 1`` of them, each over about half the positions."""
    size = (1 << (radius + 1)) - 1
    return [
        sum(1 << i for i in range(bits) if bin((i % size + 1) & v).count("1") % 2)
        for v in range(1, size + 1)
    ]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(u, v)`` whose components are those of all pairs within ``radius`` bits, from distinct ``fp``.

    Tables hold one row per fingerprint and mask. A bucket of two gives its pair, which is then compared exactly.
    From a bucket of more, pairs are not listed: its members are joined to every number at most ``radius / 2`` bits
    away, since two fingerprints within an even radius always have such a number in common and no two others do.
    A number has a bounded count of such neighbours, so no group grows with the data.
    """
    if radius % 2:
        raise ValueError("an even radius is asked for")
    tables = prints.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks(radius))])).alias("b"),
    ).select("fp", "b.t", "b.key")
    buckets = stored(
        tables.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).filter("n > 1")
    )
    pairs = buckets.filter("n = 2").select("u", "v").filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    crowded = tables.join(buckets.filter("n > 2").select("t", "key"), ["t", "key"], "left_semi").select("fp").distinct()
    flips = [sum(1 << i for i in c) for k in range(radius // 2 + 1) for c in itertools.combinations(range(64), k)]
    near = crowded.select("fp", F.explode(F.array(*[F.lit(_signed(f)) for f in flips])).alias("flip"))
    near = near.select(F.col("fp").bitwiseXOR(F.col("flip")).alias("near"), "fp")
    shared = near.groupBy("near").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    hub = shared.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).filter("u <> v")
    return pairs.unionByName(hub)


def near_duplicates(
    documents: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = RADIUS, carried: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: its id, ``fp``, ``component_id``, the least id among all it can reach, and ``component``.

    ``component`` is the least fingerprint it can reach and so tells groups apart that have no id to be named by.
    ``carried`` names further columns to keep.
    """
    marked = stored(documents.select(F.col(id_column).alias("doc_id"), with_fingerprints(documents, text).alias("fp"), *carried))
    prints = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    components = connected_components(links(prints.select("fp"), radius))
    named = prints.join(components.withColumnRenamed("id", "fp"), "fp", "left")
    named = named.select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = named.join(smallest, "component").select("fp", "component", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id", "component", *carried)


def query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(documents)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shingle_sets(text: Column) -> Column:
    @F.pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingle_set(t) for t in batch], dtype=object)

    return run(text)


def _crowded(documents: DataFrame) -> np.ndarray:
    """Shingles met often in a sample of the documents. They decide an order only, so a sample loses no pair."""
    sample = documents.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    counts = stored(sample.select(F.explode(_shingle_sets(F.col("text"))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= CROWDED))
    return np.sort(counts.orderBy(F.desc("n"), "h").limit(MOST_CROWDED).select("h").toArrow()["h"].to_numpy())


def parity_bits(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each of 256 bits: two sets differ in at least as many as their bits do."""
    odd = np.bincount((found.astype(np.int64).view(np.uint64) >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixes(text: Column, crowded: np.ndarray, similarity: float) -> Column:
    """A struct of a set's hash, its size, its fingerprint, its prefix: the least shingles, crowded ones last, if it ends
    in one, its parity bits.

    Of two sets at least ``similarity`` alike, both prefixes share a shingle whatever the order is.
    """

    @F.pandas_udf("set_id long, size int, fp long, prefix array<long>, late boolean, bits array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for text in batch:
                found = shingle_set(text)
                n = len(found) - int(np.ceil(similarity * len(found) - 1e-9)) + 1 if len(found) else 0
                last = crowded[np.minimum(np.searchsorted(crowded, found), len(crowded) - 1)] == found if len(crowded) else np.zeros(len(found), bool)
                digest = xxhash.xxh64_intdigest(found.tobytes(), HASH_SEED)
                fp = _signed(_majority(found[at : at + CHUNK] for at in range(0, len(found), CHUNK)))
                out.append((_signed(digest), len(found), fp, np.concatenate([found[~last], found[last]])[:n], n > (~last).sum(), parity_bits(found)))
            yield pd.DataFrame(out, columns=["set_id", "size", "fp", "prefix", "late", "bits"])

    return run(text)


def printed_pairs(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Candidate pairs ``(a_set_id, b_set_id)`` of ``prints(set_id, fp)`` by covering hashes of the fingerprints.

    Fingerprints within the radius are linked by their least sets, and the other sets of a fingerprint to its least.
    """
    least = stored(prints.groupBy("fp").agg(F.min("set_id").alias("least")))
    linked = links(least.select("fp"), radius)
    a, b = (least.select(F.col("fp").alias(k), F.col("least").alias(f"{n}_set_id")) for k, n in (("v", "a"), ("u", "b")))
    across = linked.join(a, "v").join(b, "u").select("a_set_id", "b_set_id")
    within = prints.join(least, "fp").filter("set_id <> least").select(F.col("set_id").alias("a_set_id"), F.col("least").alias("b_set_id"))
    return across.unionByName(within)


def similar_groups(documents: DataFrame, similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """``(doc_id, hash, component)`` per row of ``documents(doc_id, text, hash)``: groups linked by similar pairs.

    Pairs are those whose sets of shingles have a Jaccard similarity of at least ``similarity``, with certainty. Covering
    hashes of the fingerprints find those near each other, which are compared exactly. Similar sets whose fingerprints lie
    further apart are found by prefixes; what is linked already is not compared again there. What two sets share is at most what their prefixes share and what the set whose prefix ends first has after it, so pairs
    whose prefixes share too little are passed over and all others compared exactly. First the members of a bucket are
    held against one of them, that which shares most of its own prefix; pairs are listed only between members that this
    leaves in different groups, so a large group of near copies is not paired.
    """
    crowded = _crowded(documents)
    marked = stored(documents.withColumn("_p", _prefixes(F.col("text"), crowded, similarity)).select("doc_id", "hash", "_p.*"))
    sets = marked.groupBy("set_id").agg(*[F.first(c).alias(c) for c in ("size", "prefix", "late", "bits")])
    end = F.struct("late", F.element_at("prefix", -1).alias("h")).alias("end")
    rows = sets.filter("size > 0").select("set_id", "size", F.size("prefix").alias("own"), end, F.explode("prefix").alias("h"))
    buckets = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    rows = stored(rows.join(buckets, "h", "left_semi"))
    share = rows.groupBy("set_id").agg((F.count(F.lit(1)) / F.first("own")).alias("share"))
    rows = rows.join(share, "set_id").withColumn("s", F.struct("set_id", "size", "own", "end")).select("h", "share", "s")

    def compared(pairs: DataFrame) -> DataFrame:
        """Those of the pairs ``(a_set_id, b_set_id)`` that are similar, as ``(u, v)``, by their whole sets."""
        wanted = pairs.select(F.explode(F.array("a_set_id", "b_set_id")).alias("set_id"))
        wanted = small(stored(wanted.distinct()))
        named = marked.select("set_id", "hash").join(wanted, "set_id").groupBy("set_id").agg(F.min("hash").alias("hash"))
        texts = documents.select("hash", "text").join(small(stored(named)), "hash").dropDuplicates(["set_id"])
        whole = stored(texts.select("set_id", _shingle_sets(F.col("text")).alias("hs")))
        u, v = (whole.select(F.col("set_id").alias(k), F.col("hs").alias(f"{k}_hs")) for k in "uv")
        both = pairs.select(F.col("a_set_id").alias("u"), F.col("b_set_id").alias("v")).join(u, "u").join(v, "v")
        shared = F.size(F.array_intersect("u_hs", "v_hs"))
        return stored(both.filter(shared >= similarity * (F.size("u_hs") + F.size("v_hs") - shared) - 1e-9).select("u", "v"))

    def alike(met: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """Similar pairs ``(u, v)`` from a row with both sets, ``a`` and ``b``, for each shingle their prefixes share.

        Pairs in one component of ``known`` are left out.
        """
        keys = [F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in "ab" for c in ("set_id", "size", "own", "end")]
        counted = met.select(*keys)
        counted = counted.groupBy(*counted.columns).agg(F.count(F.lit(1)).alias("n"))
        after = F.when(F.col("a_end") <= F.col("b_end"), F.col("a_size") - F.col("a_own")).otherwise(F.col("b_size") - F.col("b_own"))
        asked = F.lit(similarity / (1 + similarity)) * (F.col("a_size") + F.col("b_size"))
        pairs = stored(counted.filter(F.col("n") + after >= asked - 1e-6).select("a_set_id", "b_set_id"))
        if known is not None:
            a, b = (known.select(F.col("id").alias(f"{k}_set_id"), F.col("component").alias(f"{k}_known")) for k in "ab")
            pairs = pairs.join(a, "a_set_id", "left").join(b, "b_set_id", "left")
            pairs = stored(pairs.filter(~F.coalesce(F.col("a_known") == F.col("b_known"), F.lit(False))).select("a_set_id", "b_set_id"))
        return compared(pairs)

    printed = compared(stored(printed_pairs(stored(marked.filter("size > 0").select("set_id", "fp").distinct()))))
    begun = small(stored(connected_components(printed)))
    sizes = F.least("a.size", "b.size") >= similarity * F.greatest("a.size", "b.size") - 1e-9
    hubs = rows.groupBy("h").agg(F.max(F.struct("share", "s")).alias("m")).select("h", F.col("m.s").alias("b"))
    edges = alike(rows.select("h", F.col("s").alias("a")).join(hubs, "h").filter((F.col("a.set_id") != F.col("b.set_id")) & sizes), begun)
    edges = edges.unionByName(printed)
    components = stored(connected_components(edges))

    placed = rows.withColumn("id", F.col("s.set_id")).join(components, "id", "left").select("h", "s", F.coalesce("component", "id").alias("component"))
    split = placed.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("h")
    # A shingle in the bits of one set only is one that both do not share, so most pairs end here without being listed.
    bits = sets.select("set_id", *[F.element_at("bits", i + 1).alias(f"bits{i}") for i in range(4)])
    left = placed.join(split, "h", "left_semi").withColumn("set_id", F.col("s.set_id")).join(bits, "set_id")
    left = stored(left.select("h", F.col("s").alias("a"), F.col("component").alias("a_component"), *[F.col(f"bits{i}").alias(f"a_bits{i}") for i in range(4)]))
    right = left.select("h", F.col("a").alias("b"), F.col("a_component").alias("b_component"), *[F.col(f"a_bits{i}").alias(f"b_bits{i}") for i in range(4)])
    apart = (F.col("a.set_id") < F.col("b.set_id")) & (F.col("a_component") != F.col("b_component"))
    differ = sum((F.bit_count(F.col(f"a_bits{i}").bitwiseXOR(F.col(f"b_bits{i}"))) for i in range(4)), F.lit(0))
    apart = apart & (differ <= (F.col("a.size") + F.col("b.size")) * ((1 - similarity) / (1 + similarity)) + 1e-6)
    components = connected_components(edges.unionByName(alike(left.join(right, "h").filter(apart & sizes))))
    named = marked.select("doc_id", "hash", "set_id").join(components.withColumnRenamed("id", "set_id"), "set_id", "left")
    return named.select("doc_id", "hash", F.coalesce("component", "set_id").alias("component"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group, that with the least id; of rows that repeat its id and text, one.

    Null ids come last, so a group without any id keeps a document too; of different texts under the chosen id in one
    group the one with the least hash stays.
    """
    whole_texts(spark)
    found = similar_groups(docs.select("doc_id", "text", F.xxhash64("text").alias("hash")))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash")).alias("k")
    keep = found.groupBy("component").agg(least).select("k.*")

    def name(row_id) -> Column:
        return F.coalesce(F.col(row_id).cast("string"), F.lit(""))

    rows = docs.select(name("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.struct(*docs.columns).alias("row"))
    kept = rows.join(keep.select(name("doc_id").alias("id"), "hash").distinct(), ["id", "hash"], "left_semi")
    return kept.dropDuplicates(["id", "hash"]).select(*[F.col("row").getField(n).alias(n) for n in docs.columns])
