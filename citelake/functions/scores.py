"""Similarity scores and their fusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DENSE_WEIGHT, SPARSE_WEIGHT = 0.7, 0.3


def dense_part(cosine: Column) -> Column:
    """Cosine to 0..1."""
    return (1 + cosine) / 2


def sparse_part(product: Column) -> Column:
    """Inner product to 0..1."""
    return 0.5 + F.atan(product) / F.pi()


def fused(cosine: Column, product: Column, dense_weight: float = DENSE_WEIGHT, sparse_weight: float = SPARSE_WEIGHT) -> Column:
    """Weighted sum; a leg without the row adds nothing."""
    return F.coalesce(dense_part(cosine) * dense_weight, F.lit(0.0)) + F.coalesce(sparse_part(product) * sparse_weight, F.lit(0.0))
