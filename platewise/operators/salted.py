"""Equi-joins with hot keys: only the keys that a sketch finds heavy are dealt
over several tasks.

One pass over the large side's key column keeps a top-k sketch (mergeable,
bounded).  Rows of a heavy key get a salt from the hash of their other columns;
the other side repeats its rows of those keys, once a salt.  All other keys
join as ever.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: salts of a heavy key; a key is heavy beyond 1 / SALTS of the rows, so there are fewer than SALTS heavy keys
SALTS = 16
#: rows of the large side that a task takes, whatever the number of shuffle partitions
TASK_ROWS = 1 << 20
#: items that the sketch follows
TRACKED = 4096


def sketch(df: DataFrame, key: str, share: float = 1 / SALTS) -> tuple[int, list]:
    """Rows with a key, and the keys that hold more than ``share`` of them (at most 1 / share values reach the driver)."""
    total, top = df.agg(F.count(key), F.expr(f"approx_top_k({key}, {int(1 / share)}, {TRACKED})")).first()
    return total, sorted(t["item"] for t in top or [] if t["item"] is not None and t["count"] > share * total)


def heavy_keys(df: DataFrame, key: str, share: float = 1 / SALTS) -> list:
    """Keys that hold more than ``share`` of the rows."""
    return sketch(df, key, share)[1]


def salted_join(large: DataFrame, small: DataFrame, key: str, how: str = "inner", salts: int = SALTS,
                sketched: tuple[int, list] | None = None) -> DataFrame:
    """``large.join(small, key, how)`` (inner or left) without a task that holds a whole heavy key of ``large``.

    ``sketched`` (default: of ``large``) is what ``sketch`` says of the keys.
    """
    total, heavy = sketched or sketch(large, key, 1 / salts)
    columns = large.columns
    is_heavy: Column = F.coalesce(F.col(key).isin(heavy), F.lit(False)) if heavy else F.lit(False)
    others = [c for c in columns if c != key]
    salt = F.pmod(F.xxhash64(*others), F.lit(salts)) if others else F.lit(0)
    left, on = (large.withColumn("_salt", F.when(is_heavy, salt).otherwise(0).cast("int")), [key, "_salt"]) if heavy else (large, [key])
    left = dealt(left, total, *on)
    if heavy:
        each = F.when(is_heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        small = small.withColumn("_salt", F.explode(each))
    return left.join(dealt(small, total, *on), on, how).drop("_salt")


def tasks(rows: int) -> int:
    return -(-rows // TASK_ROWS)


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` in as many tasks as ``rows`` need, by ``by``."""
    return df if rows <= TASK_ROWS else df.repartition(tasks(rows), *by)


def in_order(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df.orderBy(*by)`` of at most ``rows`` rows, about TASK_ROWS a task."""
    return df.orderBy(*by) if rows <= TASK_ROWS else df.repartitionByRange(tasks(rows), *by).sortWithinPartitions(*by)
