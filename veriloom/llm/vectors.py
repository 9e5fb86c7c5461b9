"""Embedding near-duplicates: balanced binary codes by iterative quantisation, Hamming tables, exact cosine.

Codes: vectors of unit length are centred, turned onto their principal axes and rotated so that the signs lose least
(iterative quantisation), learnt from a bounded sample (``SAMPLE``). Codes are cut into ``TABLES`` blocks; two codes
within ``TABLES - 1`` bits agree in some block, so each table holds every vector under its label and one block's value
and pairs meet in a table. The original vectors are then compared in double precision. A pair is counted in the first
table where it meets.

Equal vectors are one row with a count, so a group of copies costs nothing. Buckets of more than ``CHUNK`` vectors are
cut by a hash of the id and compared chunk by chunk; each task gives, for each vector, how many it links to and the
least vector of its group in this task, never a row per pair.

Defined results: vectors that are null, all zero, or hold null or non-finite components, or whose label is null, link with
nothing; so do vectors of different length; rows that repeat an id and vector count as two vectors of one component; a
null id is never a component's name where another is there; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import connected_components, small, stored, table

COSINE = 0.98
SAMPLE = 20_000
BITS = 64
TABLES = 8
CHUNK = 1500
ROUNDS = 30


def learn_rotation(vectors: np.ndarray, bits: int = BITS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The mean and the projection whose signs are the code."""
    vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    mean = vectors.mean(axis=0)
    centred = vectors - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, : min(bits, vectors.shape[1])]
    reduced = centred @ axes
    rotation, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((axes.shape[1], axes.shape[1])))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(reduced @ rotation >= 0, 1.0, -1.0).T @ reduced)
        rotation = (left @ right).T
    return mean, axes @ rotation


def encode(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    signs = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True) - mean) @ projection >= 0
    padded = np.zeros((len(signs), 64), np.uint8)
    padded[:, : signs.shape[1]] = signs
    return np.packbits(padded, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _blocks(codes: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The value of each block of each code, ``codes x tables``."""
    cuts = [bits * i // tables for i in range(tables + 1)]
    return np.stack(
        [(codes >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False)], axis=1
    ).astype(np.int64)


def compare(frame: pd.DataFrame, table_number: int, first: int, second: int, bits: int, cosine: float = COSINE, tables: int = TABLES) -> pd.DataFrame:
    """Links inside one chunk or between two: per vector the copies linked to and the least vector joined to."""
    frame = frame.sort_values("rep", kind="stable").reset_index(drop=True)
    x = np.array(frame["vector"].tolist(), np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    blocks = _blocks(frame["code"].to_numpy(np.int64).view(np.uint64), bits, tables)
    copies, chunk = frame["copies"].to_numpy(np.int64), frame["chunk"].to_numpy(np.int64)
    n = len(x)
    links = np.zeros(n, np.int64)
    least = np.arange(n)

    for at in range(0, n, 512):
        rows = slice(at, min(n, at + 512))
        linked = x[rows] @ x.T >= cosine - 1e-9
        a, b = np.nonzero(linked)
        a += at
        later = b > a
        a, b = a[later], b[later]
        if first != second:
            across = chunk[a] != chunk[b]
            a, b = a[across], b[across]
        if table_number:
            new = ~(blocks[a, :table_number] == blocks[b, :table_number]).any(axis=1)
            a, b = a[new], b[new]
        exact = np.empty(len(a))
        for part in range(0, len(a), 1 << 16):
            s = slice(part, part + (1 << 16))
            exact[s] = np.einsum("ij,ij->i", x[a[s]], x[b[s]])
        a, b = a[exact >= cosine], b[exact >= cosine]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        while len(a):  # hang the larger root on the smaller, then point every vector at its root
            p, q = least[a], least[b]
            apart = p != q
            if not apart.any():
                break
            np.minimum.at(least, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
            while (least[least] != least).any():
                least = least[least]
    used = np.flatnonzero(links)
    reps = frame["rep"].to_numpy(np.int64)
    return pd.DataFrame({"rep": reps[used], "links": links[used], "joined": reps[least[used]]})


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, tables: int = TABLES, chunk: int = CHUNK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``embeddings(vec_id, embedding, label)``."""
    sound = F.expr(
        "label IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND exists(embedding, x -> x <> 0)"
        " AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    )
    rows = embeddings.select("vec_id", "label", "embedding", F.coalesce(sound, F.lit(False)).alias("sound"))
    reps = stored(
        rows.filter("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    )
    usable = reps.filter("rep is not null")
    drawn = usable.select("embedding").orderBy(F.xxhash64("rep"), "rep").limit(sample).collect()
    by_size: dict[int, list] = {}
    for row in drawn:
        by_size.setdefault(len(row[0]), []).append(row[0])
    learnt = {size: learn_rotation(np.array(group, np.float64)) for size, group in by_size.items() if len(group) > 1}

    def code(batches):
        for batch in batches:
            codes = np.zeros(len(batch), np.uint64)
            sizes = np.array([len(v) for v in batch["embedding"]], np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                if int(size) in learnt:
                    codes[at] = encode(np.array(batch["embedding"].iloc[at].tolist(), np.float64), *learnt[int(size)])
            bits = np.minimum(BITS, sizes)
            blocks = np.zeros((len(batch), tables), np.int64)
            for b in np.unique(bits):
                at = np.flatnonzero(bits == b)
                blocks[at] = _blocks(codes[at], int(b), tables)
            yield pd.DataFrame({
                "label": batch["label"], "rep": batch["rep"], "copies": batch["copies"], "vector": batch["embedding"],
                "code": codes.view(np.int64), "dims": sizes, "blocks": list(blocks),
            })

    kind = dict(usable.dtypes)["label"]
    vector = dict(usable.dtypes)["embedding"]
    coded = stored(usable.mapInPandas(code, f"label {kind}, rep long, copies long, vector {vector}, code long, dims long, blocks array<long>"))
    bucket = ["label", "dims", "t", "value"]
    placed = coded.select("label", "dims", "rep", "copies", "vector", "code", F.posexplode("blocks").alias("t", "value"))
    sizes = placed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = small(stored(sizes.withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))))
    cut = placed.join(sizes, bucket).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cut = cut.withColumn("first", F.least("chunk", "other")).withColumn("second", F.greatest("chunk", "other"))

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        return compare(frame, int(key[2]), int(key[4]), int(key[5]), min(BITS, int(key[1])), cosine, tables)

    partial = stored(cut.groupBy(*bucket, "first", "second").applyInPandas(run, "rep long, links long, joined long"))
    counts = partial.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(partial.select(F.col("rep").alias("u"), F.col("joined").alias("v")))
    named = (
        reps.join(counts, "rep", "left").join(components.withColumnRenamed("id", "rep"), "rep", "left")
        .select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = rows.filter("sound").join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
