"""What several operators share: tables, row keys, checkpoints, thresholds and connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom import session


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str, parts: int) -> Column:
    """crc32 of an id written as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts))


TEXT_ROWS = 512


def whole_texts(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Let Arrow batches hold at most ``rows`` rows from now on, as each carries a text of any length."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, with its lineage cut."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(session.shared_dir(spark))
    return df.checkpoint(eager=True)


BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast if counting shows that it has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The ``k``-th largest value of a double column, exactly, by ever finer histograms of ``bins`` counts.

    None when ``k`` is below one or no row has a value; the smallest value when ``k`` is above their number.
    """
    value = F.col(column)
    least, most, n = df.agg(F.min(value), F.max(value), F.count(value)).first()
    if k < 1 or not n:
        return None
    if k >= n:
        return float(least)
    low, high, above = float(least), float(most), 0
    while low < high:
        width = (high - low) / bins
        inside = df.filter(value.between(low, high))
        if width <= 0 or low + width == low:
            distinct = [r[0] for r in inside.select(column).distinct().orderBy(F.desc(column)).limit(bins).collect()]
            for one in distinct:
                above += df.filter(value == one).count()
                if above >= k:
                    return float(one)
            return low
        slot = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
        rows = inside.groupBy(slot.alias("slot")).agg(
            F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")
        ).collect()
        for row in sorted(rows, key=lambda r: -r["slot"]):
            if above + row["n"] >= k:
                low, high = float(row["low"]), float(row["high"])
                break
            above += row["n"]
    return low


EDGES_A_TASK = 1 << 16


def _changed(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(id, component)`` for every id in ``edges(u, v)``: the least id it can reach.

    Alternating stars: each round hangs every id on the least of its neighbours, so long chains shrink in
    logarithmically many rounds. Only minima and one join per half round are shuffled; nothing is collected. A round starts
    no more tasks than its edges need, however many shuffle partitions there are: it leaves some files for each, and the driver
    remembers each.
    """
    edges = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _changed(edges)
    if seen[0]:
        for _ in range(max_rounds):
            tasks = -(-seen[0] // EDGES_A_TASK)
            edges = edges.coalesce(tasks)
            both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
            large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = large.filter("u <> v").distinct().coalesce(2 * tasks)
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u")
            edges = stored(
                small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
                .filter("u <> v").distinct().coalesce(2 * tasks)
            )
            now = _changed(edges)
            if now == seen or not now[0]:
                break
            seen = now
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def stable_id(*parts: object) -> int:
    """A 63-bit number from text, the same on every machine."""
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=8).digest(), "little") >> 1


Query = Callable[[SparkSession, str], DataFrame]
