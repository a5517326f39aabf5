"""Joins and numbering that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: A side may be broadcast only when it was measured to be below both bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
#: Replication factor of the small side when it is too large to broadcast.
SALTS = 32


def measure(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[int, int]:
    """Rows and approximate bytes of ``df``, reading no more than ``max_rows + 1`` rows of it."""
    strings = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    fixed = 16 * len(df.columns)
    width = F.lit(fixed)
    for name in strings:
        width = width + F.coalesce(F.octet_length(name), F.lit(0))
    for name in arrays:
        width = width + 16 * F.greatest(F.size(name), F.lit(0))
    return tuple(
        df.limit(max_rows + 1)
        .select(width.cast("long").alias("w"))
        .agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0)))
        .first()
    )


def within_bounds(rows: int, size: int) -> bool:
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def is_small(df: DataFrame) -> bool:
    return within_bounds(*measure(df))


def bounded_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] = (),
    salts: int = SALTS,
    small_is_small: bool | None = None,
) -> DataFrame:
    """Equi join of a large, possibly skewed side with a usually small one.

    The small side is broadcast when it is measured to be small; a caller that already knows passes
    ``small_is_small``. Otherwise the join shuffles on ``on`` plus a
    salt: rows of the large side get a salt from ``spread``, the other side is repeated once per salt, so a hot
    key is shared by ``salts`` tasks.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    if is_small(small) if small_is_small is None else small_is_small:
        return big.join(F.broadcast(small), list(on), how)
    spread_cols = [F.col(c) for c in (spread or [c for c in big.columns if c not in on])]
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_cols), F.lit(salts)).cast("int"))
    salted_small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_big.join(salted_small, [*on, "_salt"], how).drop("_salt")


def dense_index(df: DataFrame, group: Sequence[str], key: str, name: str = "idx", width: int = 4096) -> DataFrame:
    """0-based position of every row of ``group`` in the order of the unique integer ``key``.

    The rows of a group are numbered inside key ranges of ``width`` ids; only the per-range counts meet in one
    place, so a group may be arbitrarily large.
    """
    ranged = df.withColumn("_range", F.floor(F.col(key) / F.lit(width)).cast("long"))
    order = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*group, "_range")
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(order), F.lit(0)))
        .drop("_n")
    )
    inside = W.partitionBy(*group, "_range").orderBy(key)
    return (
        ranged.withColumn("_pos", F.row_number().over(inside) - 1)
        .join(offsets, [*group, "_range"])
        .withColumn(name, (F.col("_offset") + F.col("_pos")).cast("long"))
        .drop("_range", "_pos", "_offset")
    )


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of every group under a total order, with their 1-based rank.

    The filter sits directly on ``row_number``, so every task keeps at most ``k`` rows per group before the shuffle.
    """
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= k)


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition an input that has fewer splits than the cluster has cores; leave wide inputs as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def explode_computed(df: DataFrame, array: str, name: str) -> DataFrame:
    """Explode a computed array column. A plain ``explode`` makes the optimizer add a ``size > 0`` filter that
    computes the array a second time, below any repartitioning; the outer form with a NULL filter does not."""
    rest = [c for c in df.columns if c != array]
    return df.select(*rest, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
