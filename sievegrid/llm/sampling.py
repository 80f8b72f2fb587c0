"""Bounded samples of rows for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Parts that hashes of keys fall into, and how much more than asked is taken so that enough comes.
PARTS, SPARE = 1 << 30, 1.2


def sample(df: DataFrame, keys: list[str], n: int) -> list[Row]:
    """About n rows, each key once, of the least hashes; all rows where there are no more than n.

    The rows are counted first; tasks then send on only rows whose hash lies
    under n of that count, so what reaches the driver is bounded by n whatever
    the size of the table, and a key that holds many rows sends one.
    """
    total = df.count()
    part = F.pmod(F.xxhash64(*keys), F.lit(PARTS))
    if total > n:
        df = df.where(part < int(PARTS * min(1.0, SPARE * n / total)))
    rows = df.withColumn("_part", part).dropDuplicates(keys).collect()
    rows.sort(key=lambda r: (r["_part"], *(str(r[k]) for k in keys)))
    return rows[:n]
