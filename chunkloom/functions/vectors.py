"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TINY_NORM = 1e-12


def inner_product(left: Column, right: Column) -> Column:
    """Sum of products in index order, accumulated in double."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(inner_product(vector, vector))


def l2_normalize(vector: Column) -> Column:
    scale = F.greatest(l2_norm(vector), F.lit(TINY_NORM))
    return F.transform(vector, lambda x: x.cast("double") / scale)
