"""p9: texts into sequences of fixed capacity.

Driver work is bounded by the capacity, not by the data: only the histogram of
item lengths (at most `capacity` rows) reaches the driver. Best-fit-decreasing
runs on that histogram over groups of equal containers; every text then finds
its container from its rank among texts of its length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import materialize

#: Shares into which the ranking of one length is cut, so that a length held by a third of all texts is no one task.
SALTS = 128


def length_buckets(hist: dict[int, int], capacity: int, k: int = 24) -> tuple[list[int], dict]:
    """At most k bucket boundaries that minimise padding, by dynamic programming over the histogram.

    A batch of the bucket with upper bound b holds capacity // b items, each
    padded to b. Returns the boundaries and what is filled.
    """
    lens = sorted(x for x in hist if 0 < x <= capacity)
    if not lens:
        return [], {"containers": 0, "tokens": 0, "fill": 1.0}
    n = len(lens)
    cnt = np.concatenate([[0], np.cumsum([hist[x] for x in lens])])
    best = np.full((min(k, n) + 1, n + 1), np.inf)
    best[0, 0] = 0
    back = np.zeros_like(best, dtype=int)
    # Containers of a bucket (i, j]: ceil(items / (capacity // b)); the padding is containers * capacity less a constant.
    for q in range(1, best.shape[0]):
        for j in range(1, n + 1):
            per = capacity // lens[j - 1]
            cost = best[q - 1, :j] + -(-(cnt[j] - cnt[:j]) // per)
            i = int(np.argmin(cost))
            best[q, j], back[q, j] = cost[i], i
    q = int(np.argmin(best[:, n]))
    total, bounds, j = int(best[q, n]), [], n
    while j:
        bounds.append(lens[j - 1])
        j, q = back[q, j], q - 1
    tokens = sum(x * hist[x] for x in lens)
    return bounds[::-1], {"containers": total, "tokens": tokens, "fill": tokens / (total * capacity)}


def pack_histogram(hist: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best-fit-decreasing over groups of equal containers.

    Returns slots (length, first rank, number, first container): the item of
    that length with rank first + i lies in container first container + i; and
    the number of containers. Both the groups and the slots are bounded by the
    number of lengths, whatever the counts.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> groups (first container, number)
    slots, total = [], 0
    for length in sorted((x for x in hist if 0 < x <= capacity), reverse=True):
        left, rank = hist[length], 0
        while left:
            # The fullest container that still takes the item: the least room of at least this length.
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                # As many items as fit go into each new container; a last one may hold fewer.
                per = capacity // length
                bins = left // per
                if bins:
                    for _ in range(per):
                        slots.append((length, rank, bins, total))
                        rank += bins
                    rooms.setdefault(capacity - per * length, []).append((total, bins))
                    total += bins
                    left -= per * bins
                if left:
                    for _ in range(left):
                        slots.append((length, rank, 1, total))
                        rank += 1
                    rooms.setdefault(capacity - left * length, []).append((total, 1))
                    total += 1
                    left = 0
                continue
            first, bins = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            used = min(bins, left)
            slots.append((length, rank, used, first))
            rank, left = rank + used, left - used
            rooms.setdefault(room - length, []).append((first, used))
            if used < bins:
                rooms.setdefault(room, []).append((first + used, bins - used))
    return slots, total


def pack(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, size, sequences ARRAY<BIGINT>): the containers of every item.

    An item over the capacity fills size // capacity containers of its own and
    its rest shares one; sizes of 0, below 0 or null need no place (empty
    list). Equal sizes are ranked by key; rows that repeat a key are items of
    their own. An empty table gives an empty table.
    """
    spark = sizes.sparkSession
    items = sizes.select(F.col(key), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("n"))
    items = items.select(key, "n", (F.col("n") % capacity).alias("rest"), F.floor(F.greatest("n", F.lit(0)) / capacity).alias("full"), F.pmod(F.xxhash64(key), F.lit(SALTS)).alias("salt"))
    items = materialize(items, "pack")
    per = items.groupBy("rest", "salt").agg(F.count("*").alias("c"), F.sum("full").alias("f"))
    # At most capacity x SALTS rows; their running sums give each share its first rank.
    per = materialize(per, "pack-shares")
    hist = {r["rest"]: r["c"] for r in per.where("rest > 0").groupBy("rest").agg(F.sum("c").alias("c")).collect()}
    slots, total = pack_histogram(hist, capacity)
    w = Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    wf = Window.partitionBy(F.lit(0)).orderBy("rest", "salt").rowsBetween(Window.unboundedPreceding, -1)
    shares = per.select("rest", "salt", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("rank0"), F.coalesce(F.sum("f").over(wf), F.lit(0)).alias("full0"))
    own = Window.partitionBy("rest", "salt").orderBy(key)
    ranked = items.withColumn("i", F.row_number().over(own) - 1).withColumn("before", F.coalesce(F.sum("full").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.join(shares, ["rest", "salt"]).select(key, "n", "rest", "full", (F.col("rank0") + F.col("i")).alias("rank"), (F.col("full0") + F.col("before")).alias("fullrank"))
    table = spark.createDataFrame(slots, "rest bigint, first_rank bigint, number bigint, first_seq bigint")
    at = ranked.join(F.broadcast(table), (ranked["rest"] == table["rest"]) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("number")), "left").drop(table["rest"])
    whole = F.when(F.col("full") > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("full")), lambda x: x - 1 + F.lit(total) + F.col("fullrank"))).otherwise(F.expr("cast(array() as array<bigint>)"))
    shared = F.when(F.col("first_seq").isNotNull(), F.array(F.col("first_seq") + F.col("rank") - F.col("first_rank"))).otherwise(F.expr("cast(array() as array<bigint>)"))
    return at.select(key, F.col("n").alias(size), F.concat(whole, shared).alias("sequences"))
