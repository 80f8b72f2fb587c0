"""Pairs of vectors with a high cosine: sign bands propose, the exact cosine decides."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..runtime import materialize, ship

#: Least bits of a band, and the part of pairs at the threshold that no band may propose.
BITS, MISSED = 12, 0.001


def bands_for(rows: int, threshold: float) -> tuple[int, int]:
    """Bits of a band and bands for so many vectors: two bits fewer than number them, so a vector meets about four others by
    chance per band whatever their number, and as many bands as propose a pair at the threshold but for MISSED."""
    bits = max(BITS, math.ceil(math.log2(max(2, rows))) - 2)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log(1 - agree))


def redundant_pairs(df: DataFrame, key: str, vector: str, threshold: float = 0.95) -> DataFrame:
    """(a, b, cos), a < b, of vectors whose cosine is at least the threshold.

    Equal vectors are one class: its least key takes part in the search, the
    others come out as pairs with it. Null and zero vectors have no pair; a key
    that comes twice counts once. `every_pair` expands the classes.
    """
    members, links = classes_and_links(df, key, vector, threshold)
    same = members.where("k <> rep").select(F.col("rep").alias("a"), F.col("k").alias("b"), F.lit(1.0).alias("cos"))
    return links.unionByName(same)


def every_pair(df: DataFrame, key: str, vector: str, threshold: float = 0.95) -> DataFrame:
    """The same with every pair of members of classes that are near, or of one class; as many rows as there are such pairs."""
    members, links = classes_and_links(df, key, vector, threshold)
    x, y = members.select(F.col("k").alias("x"), F.col("rep").alias("a")), members.select(F.col("k").alias("y"), F.col("rep").alias("b"))
    across = links.join(x, "a").join(y, "b").select("x", "y", "cos")
    copied = members.where("k <> rep").select("rep").distinct()
    own = members.join(copied, "rep", "left_semi")
    within = own.select(F.col("k").alias("x"), "rep").join(own.select(F.col("k").alias("y"), "rep"), "rep").where("x < y").select("x", "y", F.lit(1.0).alias("cos"))
    return across.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cos")


def classes_and_links(df: DataFrame, key: str, vector: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(members, links): (k, rep) of every key with a vector, rep the least key of equal ones; (a, b, cos) of representatives."""
    spark = df.sparkSession
    ship(spark)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for b in batches:
            rows = [np.array(v, np.float64) if v is not None and len(v) else None for v in b.column(1).to_pylist()]
            keys = []
            for v in rows:
                if v is None or not np.linalg.norm(v) > 1e-9:
                    keys.append(None)
                    continue
                if planes is None or planes.shape[1] != len(v):
                    planes = np.random.default_rng(77).standard_normal((width * bands, len(v)))
                bits = (planes @ v > 0).reshape(bands, width)
                keys.append(((bits @ (1 << np.arange(width))) + (np.arange(bands) << width)).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["k", "v", "bands"])

    plain = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    classes = materialize(plain.where("v is not null").groupBy("v").agg(F.min("k").alias("k")), "classes")
    width, bands = bands_for(classes.count(), threshold)
    reps = materialize(classes.select("k", "v").mapInArrow(run, f"k {kind}, v array<double>, bands array<bigint>").where("bands is not null"), "signs")
    post = reps.select("k", F.explode("bands").alias("band"))
    a, b = post.select(F.col("k").alias("a"), "band"), post.select(F.col("k").alias("b"), "band")
    pairs = a.join(b, "band").where("a < b").select("a", "b").distinct()
    va, vb = reps.select(F.col("k").alias("a"), F.col("v").alias("va")), reps.select(F.col("k").alias("b"), F.col("v").alias("vb"))
    far = pairs.join(va, "a").join(vb, "b").select("a", "b", V.cosine(F.col("va"), F.col("vb")).alias("cos")).where(F.col("cos") >= threshold)
    members = materialize(plain.where("v is not null").join(reps.select(F.col("k").alias("rep"), "v"), "v").select("k", "rep").distinct(), "members")
    return members, far
