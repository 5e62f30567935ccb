"""Ranking, running totals and exact percentiles that hold up when one key owns much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from chunkloom.session import written


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """The first ``n`` rows per key. Spark limits each map task to ``n`` rows per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= n)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the smallest ``order`` per key, as a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("best"))
    return best.select(*keys, "best.*").select(*df.columns)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the largest ``order`` per key, as a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("best"))
    return best.select(*keys, "best.*").select(*df.columns)


def running_totals(
    df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column], values: dict[str, Column]
) -> DataFrame:
    """Running sums per key in two steps, so that a hot key is split over its blocks.

    ``block`` must not decrease along ``order`` and must bound the rows of one
    (key, block). Block sums are combined map-side; only they are summed per key.
    ``values`` maps each output column to what it adds up.
    """
    keys = list(keys)
    names = list(values)
    blocked = df.withColumn("_block", block).withColumns({f"_v_{n}": c for n, c in values.items()})
    sums = blocked.groupBy(*keys, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, "_block", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in names]
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = blocked.withColumns({f"_i_{n}": F.sum(f"_v_{n}").over(inside) for n in names})
    joined = totals.join(offsets, [*keys, "_block"])
    return joined.select(*df.columns, *[(F.col(f"_b_{n}") + F.col(f"_i_{n}")).alias(n) for n in names])


def ordered_index(df: DataFrame, key: str, position: str, out: str, block_size: int = 4096) -> DataFrame:
    """0-based index per key along an integer position that is unique within the key."""
    block = F.floor(F.col(position) / F.lit(block_size)).cast("long")
    counted = running_totals(df, [key], block, [F.col(position)], {"_n": F.lit(1).cast("long")})
    return counted.withColumn(out, (F.col("_n") - 1).cast("int")).drop("_n")


def value_counts(values: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """Equal non-null values per key counted (``_c``), stored once for the several readers below."""
    counted = values.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count("*").alias("_c"), *more)
    return written(counted, "value-counts")


def value_buckets(hist: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """``hist`` with ``_b``, the bucket of each distinct value: nearly as many values in each, however they are spread.

    The bounds are quantiles of the distinct values of a key, from a sketch; they only part the values, in order.
    """
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    bounds = hist.groupBy(*keys).agg(F.percentile_approx("value", shares, F.lit(40 * buckets)).alias("_bounds"))
    placed = F.size(F.filter("_bounds", lambda b: b < F.col("value")))
    return hist.join(bounds, list(keys)).withColumn("_b", placed).drop("_bounds")


def exact_percentiles(
    hist: DataFrame, keys: Sequence[str], points: dict[str, float], buckets: int = 256
) -> DataFrame:
    """Linear-interpolation percentiles of counted values (see :func:`value_counts`) per key.

    Only buckets (see :func:`value_buckets`) are ranked per key, and the values inside one bucket among themselves.
    """
    keys = list(keys)
    hist = value_buckets(hist.select(*keys, "value", "_c"), keys, buckets)
    coarse = hist.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
    per_key = Window.partitionBy(*keys)
    earlier = per_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = coarse.select(
        *keys,
        "_b",
        F.coalesce(F.sum("_bc").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_bc").over(per_key).alias("_n"),
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        hist.withColumn("_upto", F.sum("_c").over(inside))
        .join(offsets, [*keys, "_b"])
        .withColumn("_hi", F.col("_before") + F.col("_upto"))
        .withColumn("_lo", F.col("_hi") - F.col("_c"))
    )

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("_lo") <= index) & (index < F.col("_hi")), F.col("value")))

    picks = []
    for name, p in points.items():
        rank = (F.col("_n") - 1) * F.lit(p / 100.0)
        low = F.floor(rank)
        weight = F.max(rank - low)
        a, b = at(low), at(F.ceil(rank))
        picks.append(F.when(weight == 0, a).otherwise(a * (1 - weight) + b * weight).alias(name))
    return ranked.groupBy(*keys).agg(*picks)


def one_row(*frames: DataFrame) -> DataFrame:
    """The columns of several one-row frames side by side, without a join."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])
