"""Keys, duplicates, splits, balance and sampling of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def once(df: DataFrame, key: str, latest: str | None = None) -> DataFrame:
    """One row per key: the latest, or any of equal rows."""
    if latest is None:
        return df.dropDuplicates([key])
    # Partial aggregates on both sides of the shuffle; a hot key sends one row per task.
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), latest).alias("r")).select(key, "r.*")


def first_per_key(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key by `order`, with the size of its group; no window, so no group meets in a sort."""
    g = df.withColumn("_k", key).groupBy("_k").agg(F.min(order).alias(order), F.count("*").alias("copies"))
    return g.withColumnRenamed("_k", "key")


def ranked(df: DataFrame, group: str, key: str) -> DataFrame:
    """df with _r, the row's rank in its group by the md5 of its key (then the key), and _m, the group's size.

    The first two digits of the hash are 256 shares in the order of the hash;
    ranks come from shares and the counts before them, so a group with a third
    of all rows is 256 sorts and no single one. Rows of a null group are left out.
    """
    h = F.md5(F.col(key).cast("string"))
    d = df.where(F.col(group).isNotNull()).withColumn("_h", h).withColumn("_s", F.substring(h, 1, 2))
    share = d.groupBy(group, "_s").agg(F.count("*").alias("_c"))
    of = Window.partitionBy(group)
    share = share.select(group, "_s", F.coalesce(F.sum("_c").over(of.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"), F.sum("_c").over(of).alias("_m"))
    own = Window.partitionBy(group, "_s").orderBy("_h", key)
    r = d.withColumn("_n", F.row_number().over(own)).join(share, [group, "_s"])
    return r.withColumn("_r", F.col("_o") + F.col("_n")).drop("_h", "_s", "_n", "_o")


def systematic(df: DataFrame, group: str, key: str) -> DataFrame:
    """Every group thinned to the size of the smallest, evenly over the order of its hashes."""
    r = ranked(df, group, key)
    least = df.where(F.col(group).isNotNull()).groupBy(group).count().agg(F.min("count").alias("_t"))
    kept = F.floor(F.col("_r") * F.col("_t") / F.col("_m")) > F.floor((F.col("_r") - 1) * F.col("_t") / F.col("_m"))
    return r.join(least).where(kept).drop("_r", "_m", "_t")


def equalise(df: DataFrame, group: str, key: str) -> DataFrame:
    """Of every group as many rows as the smallest has, those of the least hashes."""
    least = df.where(F.col(group).isNotNull()).groupBy(group).count().agg(F.min("count").alias("_t"))
    return ranked(df, group, key).join(least).where(F.col("_r") <= F.col("_t")).drop("_r", "_m", "_t")


def balance_factors(df: DataFrame, mode: str) -> DataFrame:
    """(mode, n, factor): the mean count over modes by the mode's own, between 0.75 and 1.25."""
    n = df.where(F.col(mode).isNotNull()).groupBy(mode).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("s"), F.count("*").alias("m"))
    return n.join(total).select(mode, "n", F.round(F.greatest(F.lit(0.75), F.least(F.lit(1.25), (F.col("s") / F.col("m")) / F.col("n"))), 6).alias("factor"))


def split_by_group(df: DataFrame, group: str, percent: int = 10) -> DataFrame:
    """'eval' for the groups whose hash falls under the percentage, else 'train'; a null group is a group."""
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(group), F.lit(""))), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("split", F.when(h % 100 < percent, "eval").otherwise("train"))


def cap_mode(df: DataFrame, mode: str, capped: str, key: str, ratio: float) -> DataFrame:
    """One mode cut to a share of all others, by the order of a hash; other rows stay. Nothing is cut if there are no others."""
    rest = df.where(~F.col(mode).eqNullSafe(capped))
    most = rest.agg(F.floor(F.count("*") * F.lit(ratio)).alias("_t"), F.count("*").alias("_o"))
    mine = ranked(df.where(F.col(mode) == capped), mode, key).join(most).where((F.col("_o") == 0) | (F.col("_r") <= F.col("_t")))
    return rest.unionByName(mine.drop("_r", "_m", "_t", "_o"))


def block_digests(entries: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """(keys, entries, block): a digest per block over the sorted digests of its entries, in 256 parts by their first two digits,
    so no block is one array; a changed, lost or added entry changes it."""
    parts = entries.groupBy(*keys, F.substring(digest, 1, 2).alias("_p")).agg(F.count("*").alias("_n"), F.sha2(F.array_join(F.sort_array(F.collect_list(digest)), ""), 256).alias("_d"))
    return parts.groupBy(*keys).agg(F.sum("_n").alias("entries"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_d"))), lambda x: x["_d"]), ""), 256).alias("block"))


def chained(blocks: DataFrame, chain: str, order: str) -> DataFrame:
    """(chain, order, seq, entries, block, prev_hash, this_hash): each block sealed by the hash before it, from GENESIS on.

    this_hash is sha256(prev|chain|order|block|seq). A chain's blocks are few (days, not entries), so one row may hold them.
    """
    rows = blocks.groupBy(chain).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("string").alias("o"), "block", "entries"))).alias("b"))
    kind = "array<struct<o:string,seq:bigint,entries:bigint,block:string,prev:string,this:string>>"
    last = lambda a: F.when(F.size(a) > 0, F.element_at(a, -1)["this"]).otherwise("GENESIS")

    def seal(a, x):
        seq = F.size(a).cast("bigint") + 1
        this = F.sha2(F.concat_ws("|", last(a), F.coalesce(F.col(chain), F.lit("")), x["o"], x["block"], seq.cast("string")), 256)
        return F.concat(a, F.array(F.struct(x["o"].alias("o"), seq.alias("seq"), x["entries"].alias("entries"), x["block"].alias("block"), last(a).alias("prev"), this.alias("this"))))

    out = rows.select(chain, F.explode(F.aggregate("b", F.array().cast(kind), seal)).alias("x"))
    return out.select(chain, F.col("x.o").alias(order), "x.seq", "x.entries", "x.block", F.col("x.prev").alias("prev_hash"), F.col("x.this").alias("this_hash"))


def verify(sealed: DataFrame, blocks: DataFrame, chain: str, order: str) -> DataFrame:
    """(chain, blocks, broken_at): the first sealed block of each chain that the blocks at hand do not give, null for none."""
    now = chained(blocks, chain, order).select(chain, "seq", F.col("this_hash").alias("now"))
    j = sealed.join(now, [chain, "seq"], "full")
    return j.groupBy(chain).agg(F.count("*").alias("blocks"), F.min(F.when(~F.col("this_hash").eqNullSafe(F.col("now")), F.col("seq"))).alias("broken_at"))


def picked(df: DataFrame, group: str, value: str, at: dict[str, float]) -> DataFrame:
    """(group, names...): per name the value at place max(0, floor(n * p) - 1) of the group's sorted values, read off a histogram of
    the distinct values."""
    h = df.groupBy(group, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(group).orderBy(value)
    h = h.withColumn("_to", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(Window.partitionBy(group)))
    place = lambda p: F.greatest(F.floor(F.col("_n") * p) - 1, F.lit(0))
    return h.groupBy(group).agg(*[F.min(F.when(F.col("_to") > place(p), F.col(value))).alias(k) for k, p in at.items()])
