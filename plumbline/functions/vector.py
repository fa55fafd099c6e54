"""Vector functions as Spark columns, computed in double precision inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: str | Column, b: str | Column) -> Column:
    """Sum of products over the shorter length; null if either is null."""
    n = F.least(F.size(_c(a)), F.size(_c(b)))
    products = F.zip_with(F.slice(_c(a), 1, n), F.slice(_c(b), 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: str | Column) -> Column:
    """Unit length; lengths under 1e-12 divide by that floor."""
    # the divisor stands in an array of its own, so that it is computed once a row and not once an element
    return F.zip_with(_c(v), F.array_repeat(F.greatest(norm(v), F.lit(1e-12)), F.size(_c(v))), lambda x, n: x.cast("double") / n)


def mean_pooled(vectors: str | Column, mask: str | Column, width: int) -> Column:
    """Mean of the token vectors whose mask is 1; zeros if there are none."""
    pairs = F.filter(F.arrays_zip(_c(vectors).alias("v"), _c(mask).alias("m")), lambda p: p["m"] == 1)
    total = F.aggregate(pairs, F.array_repeat(F.lit(0.0), width), lambda s, p: F.zip_with(s, p["v"], lambda x, y: x + y.cast("double")))
    return F.zip_with(total, F.array_repeat(F.greatest(F.size(pairs), F.lit(1)), width), lambda x, n: x / n)


def checks(vector: str | Column, width: str | Column) -> Column:
    """width (-1 for null), fits, broken (an element that is not finite), zero (no other element) of a vector."""
    v, w = (F.col(x) if isinstance(x, str) else x for x in (vector, width))
    broken = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    no = F.lit(False)
    return F.struct(
        F.coalesce(F.when(v.isNotNull(), F.size(v)), F.lit(-1)).cast("long").alias("width"), F.coalesce(v.isNotNull() & (F.size(v) == w), no).alias("fits"),
        F.coalesce(broken, no).alias("broken"), F.coalesce(~F.exists(v, lambda x: x != 0), no).alias("zero"),
    )
