"""Joins and ordered numbering that stay balanced when one key holds a large share of the rows.

Both start from a sample of at most ``SAMPLE_ROWS`` rows, picked by a hash of their id, so that a retried task picks the
same ones. Keys met more than once in it count as hot; in order they are the splitters that cut a table into slices. What is
broadcast is bounded by that number whatever the table holds; above ``SAMPLE_ROWS * slice_rows`` rows the slices grow with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 250_000
SAMPLE_ROWS = 4096
SALTS = 64


def picked(row_id: str, slice_rows: int) -> Column:
    """True for one row in ``slice_rows``, decided by the row id."""
    return F.pmod(F.xxhash64(row_id), F.lit(slice_rows)) == 0


def _sample(df: DataFrame, row_id: str, slice_rows: int, rows: int, *columns: Column | str) -> DataFrame:
    """One row in ``slice_rows``, ``rows`` of them at most."""
    some = df.filter(picked(row_id, slice_rows)).select(*columns, F.xxhash64(F.lit("drawn"), row_id).alias("_drawn"))
    return some.orderBy("_drawn").limit(rows).drop("_drawn")


def candidate_keys(
    df: DataFrame, keys: list[str], row_id: str, slice_rows: int = SLICE_ROWS, rows: int = SAMPLE_ROWS
) -> DataFrame:
    """Keys met at least twice in the sample: at most half as many as it has rows."""
    counted = _sample(df, row_id, slice_rows, rows, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_met"))
    return counted.filter("_met >= 2").select(*keys)


def hot_counts(
    df: DataFrame, keys: list[str], row_id: str, min_rows: int, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Exact row counts ``_hot_rows`` of the keys holding more than ``min_rows`` rows, among the candidates."""
    candidates = F.broadcast(candidate_keys(df, keys, row_id, slice_rows))
    counted = df.join(candidates, keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("_hot_rows"))
    return counted.filter(F.col("_hot_rows") > min_rows)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    row_id: str,
    how: str = "left",
    slice_rows: int = SLICE_ROWS,
    salts: int = SALTS,
    sample: DataFrame | None = None,
) -> DataFrame:
    """Join many ``left`` rows to one ``right`` row per key, spreading hot keys over ``salts`` tasks.

    Right rows of hot keys are copied ``salts`` times; all other keys take salt 0 on both sides. ``sample`` is
    where hot keys are looked for, if ``left`` itself is costly to compute twice.
    """
    sample = left if sample is None else sample
    hot = F.broadcast(candidate_keys(sample, [key], row_id, slice_rows).withColumn("_hot", F.lit(True)))
    left_salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(F.col(row_id), F.lit("salt")), F.lit(salts))).otherwise(0)
    right_salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_left = left.join(hot, key, "left").withColumn("_salt", left_salt.cast("int")).drop("_hot")
    salted_right = right.join(hot, key, "left").withColumn("_salt", F.explode(right_salts)).drop("_hot")
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")


def _struct(columns: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(c) for c in columns])


def _splitters_reached(sample_rows: int, reached: Callable[[Column], Column]) -> Column:
    """How many of the sorted ``_splitters`` a row has reached, by bisection."""

    def halve(at: Column, step: Column) -> Column:
        splitter = F.get("_splitters", at + step - 1)
        return F.when(splitter.isNotNull() & reached(splitter), at + step).otherwise(at)

    steps = [1 << n for n in reversed(range(sample_rows.bit_length()))]
    return F.aggregate(F.array(*[F.lit(n) for n in steps]), F.lit(0), halve)


def _before(a: Column, b: Column, order: list[tuple[str, bool]]) -> Column:
    """Whether row ``a`` comes before row ``b``, by columns that ascend (nulls first) or descend (nulls last)."""
    out = F.lit(False)
    for name, ascending in reversed(order):
        x, y = F.struct(a[name].alias("v")), F.struct(b[name].alias("v"))
        out = (x < y if ascending else x > y) | ((x == y) & out)
    return out


def slices_in_order(
    df: DataFrame, order: list[tuple[str, bool]], row_id: str, slice_rows: int = SLICE_ROWS, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """Add ``_slice``: ordered pieces of the whole table, of about ``slice_rows`` rows, ``sample_rows + 1`` at most.

    ``order`` is ``(column, ascending)``; no row of a slice comes before one of a lower slice.
    """
    here = _struct([name for name, _ in order])
    sort = lambda a, b: F.when(_before(a, b, order), -1).when(_before(b, a, order), 1).otherwise(0)
    drawn = _sample(df, row_id, slice_rows, sample_rows, here.alias("c"))
    placed = df.withColumns({"_splitters": drawn.agg(F.array_sort(F.collect_list("c"), sort)).scalar(), "_here": here})
    reached = _splitters_reached(sample_rows, lambda s: ~_before(F.col("_here"), s, order))
    return placed.withColumn("_slice", reached).drop("_splitters", "_here")


def with_slices(
    df: DataFrame, keys: list[str], order: list[str], row_id: str, slice_rows: int = SLICE_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Add ``_slice``: ordered pieces of large groups, and ``_cut``: whether the row's group is in pieces.

    The sampled rows in the order of ``keys`` and ``order`` split the whole table, so a group gets as many of them as its
    share of the rows. A row's slice is the number of splitters up to it, found by bisection; a group without a
    splitter is slice 0 as a whole. Null keys are a group like any other.
    """
    where = F.struct(_struct(keys).alias("k"), _struct(order).alias("o"))
    splitters = _sample(df, row_id, slice_rows, sample_rows, where.alias("c")).agg(F.sort_array(F.collect_list("c"))).scalar()
    placed = df.withColumns({"_splitters": splitters, "_here": where})
    placed = placed.withColumn("_at", _splitters_reached(sample_rows, lambda s: s <= F.col("_here")))
    # A splitter inside the group is the last one up to this row or the first one after it.
    inside = [F.coalesce(F.get("_splitters", F.col("_at") + n)["k"] == F.col("_here.k"), F.lit(False)) for n in (-1, 0)]
    placed = placed.withColumn("_cut", inside[0] | inside[1])
    return placed.withColumn("_slice", F.when(F.col("_cut"), F.col("_at")).otherwise(0)).drop("_splitters", "_here", "_at")


def ranked(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    row_id: str,
    rank: str | None = None,
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
    slice_rows: int = SLICE_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Row number, previous and next value inside each group, without putting a large group in one task.

    ``order`` must be total within a group (end it with a unique column). ``lag`` and ``lead`` map output
    column to input column. Rows are shuffled once, each slice is numbered on its own, and the edges of the slices
    of cut groups, at most twice ``sample_rows``, carry offsets and neighbour values over.
    """
    lag, lead = lag or {}, lead or {}
    sliced = with_slices(df, keys, order, row_id, slice_rows, sample_rows)
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    out = sliced.withColumn("_rank", F.row_number().over(local).cast("bigint"))
    for name, source in lag.items():
        out = out.withColumn(name, F.lag(source).over(local))
    for name, source in lead.items():
        out = out.withColumn(name, F.lead(source).over(local))
    if lead:
        out = out.withColumn("_last", F.lead(F.lit(1)).over(local).isNull())

    here = _struct(order)
    aggregates = [F.count(F.lit(1)).alias("_n")]
    aggregates += [F.max_by(source, here).alias(f"_tail_{name}") for name, source in lag.items()]
    aggregates += [F.min_by(source, here).alias(f"_head_{name}") for name, source in lead.items()]
    edges = sliced.filter("_cut").groupBy(*keys, "_slice").agg(*aggregates)
    across = Window.partitionBy(*keys).orderBy("_slice")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        _struct([*keys, "_slice"]).alias("_edge"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        *[F.lag(f"_tail_{name}").over(across).alias(f"_prev_{name}") for name in lag],
        *[F.lead(f"_head_{name}").over(across).alias(f"_next_{name}") for name in lead],
    )
    # Compared as one value, in which nulls are equal.
    out = out.withColumn("_piece", F.when(F.col("_cut"), _struct([*keys, "_slice"])))
    out = out.join(F.broadcast(edges), F.col("_piece") == F.col("_edge"), "left")
    for name in lag:
        out = out.withColumn(name, F.when(F.col("_rank") == 1, F.col(f"_prev_{name}")).otherwise(F.col(name)))
    for name in lead:
        out = out.withColumn(name, F.when(F.col("_last"), F.col(f"_next_{name}")).otherwise(F.col(name)))
    if rank:
        out = out.withColumn(rank, F.col("_rank") + F.coalesce(F.col("_offset"), F.lit(0)))
    drop = ["_slice", "_cut", "_piece", "_edge", "_rank", "_offset", "_last"] + [f"_prev_{n}" for n in lag] + [f"_next_{n}" for n in lead]
    return out.drop(*drop)
