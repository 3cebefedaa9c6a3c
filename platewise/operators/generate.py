"""Dataset-construction steps that are data work: deterministic distinct
samples, names sampled from the product of two word lists, distinct link
pairs, derived measures.

The product of two word lists is never built: a sample of n distinct names is
drawn by index (see :func:`product_sample`), so only n rows exist.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.operators.ids import assign_ids


def distinct_sample(df: DataFrame, col: str, n: int) -> DataFrame:
    """``n`` distinct values of ``col`` in a fixed pseudo-random order (md5 of
    the value), so the sample is reproducible; a top-k, not a global sort."""
    if n < 0:
        raise ValueError("n must be >= 0")
    return (df.select(col).distinct()
            .orderBy(F.md5(F.col(col).cast("string")), col).limit(n))


def distinct_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """A link table without repeated pairs."""
    return df.select(*cols).dropDuplicates(cols)


def derived_weight(dishes: DataFrame) -> DataFrame:
    """``weight = round(calories / 5, 2)``."""
    return dishes.select("id", "calories", F.round(F.col("calories") / 5.0, 2).alias("weight"))


GOLDEN = 0.6180339887


def product_stride(n_pairs: int) -> int:
    """Smallest stride >= 0.618 * N that is coprime to N: ``k -> k * stride mod N``
    is then a permutation of the N product indices (a spread-out order)."""
    s = max(1, int(GOLDEN * n_pairs))
    while math.gcd(s, n_pairs) != 1:
        s += 1
    return s


def product_sample(left: DataFrame, right: DataFrame, n: int, sep: str = " ") -> DataFrame:
    """``n`` distinct ``"left sep right"`` names from the product of two word
    lists (single string columns), without building the product.

    Both lists are numbered densely in word order; index ``k`` of the product
    stands for (left word ``k // |right|``, right word ``k % |right|``); the
    sample takes indices ``j * stride mod N`` for ``j < n`` (distinct because
    the stride is coprime to N) and resolves them with two equi-joins.  The
    sample size is the feature (as the reference's ``random.sample``).
    """
    if n < 0:
        raise ValueError("n must be >= 0")
    spark = left.sparkSession
    a = assign_ids(left.select(F.col(left.columns[0]).alias("a")).distinct(), ["a"], start=-1, id_col="ia")
    b = assign_ids(right.select(F.col(right.columns[0]).alias("b")).distinct(), ["b"], start=-1, id_col="ib")
    na, nb = a.count(), b.count()
    total = na * nb
    if total == 0:
        return spark.createDataFrame([], "name string")
    stride = product_stride(total)
    whole = lambda c: c.cast("decimal(19,0)")  # noqa: E731 - a product beyond 2^63 stays exact
    k = (whole(F.col("id")) * whole(F.lit(stride)) % whole(F.lit(total))).cast("long")
    picks = (spark.range(min(n, total)).select(k.alias("k"))
             .select(F.expr(f"k div {nb}").alias("ia"),
                     (F.col("k") % F.lit(nb)).alias("ib")))
    return (picks.join(a, "ia").join(b, "ib")
            .select(F.concat_ws(sep, "a", "b").alias("name")))
