"""p7: near-duplicate texts by odd sketches over banded MinHash candidates.

Words with repeats are a set of (word, occurrence) elements, so the asked
measure 2 x common / (words of both) >= 0.8 is a Jaccard similarity of the
element sets of at least 0.8 / 1.2. MinHash samples give band keys that
propose pairs; the same samples, folded into a parity bitmap (odd sketch),
estimate the similarity of a pair from the population count of the XOR; what
is left is checked exactly on the texts. Texts with equal word multisets are
one class: only one representative of a class takes part in the search.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, materialize, release_shuffles, ship
from . import textvec

SAMPLES, SKETCH_SAMPLES, SKETCH_BITS = 768, 320, 512
#: Samples of the coarse sketch, one parity bit each; it travels with the band keys, so most chance candidates end where they meet.
COARSE_BITS = 192
#: Rows and bands of a field: prose of one domain shares more of its words by chance than code does, so it needs longer rows.
#: A pair at exactly THRESHOLD is proposed with probability of about 0.9997 in code and 0.9998 in prose (simulated, with the samples that bands share).
CODE_BANDS, PROSE_BANDS = (7, 160), (8, 256)
#: Bands searched at once: the disk holds the keys of one pass only.
PASS_BANDS = 32
#: A key is hot if HOT_SEEN of one in HOT_SAMPLE of all texts have it; its texts meet in HOT_BLOCKS x HOT_BLOCKS cells instead of in one task.
HOT_SAMPLE, HOT_SEEN, HOT_BLOCKS = 64, 16, 8
MIN_WORDS, THRESHOLD = 20, 0.8
WORD = re.compile(r"[A-Za-z0-9_]+")
#: Texts hashed at once in a worker; bounds its memory.
CHUNK_BYTES = 1_000_000


def _constants(shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    a = rng.integers(1, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
    x = rng.integers(1, 1 << 32, SAMPLES, dtype=np.uint32)
    picks = np.stack([rng.choice(SAMPLES, shape[0], replace=False) for _ in range(shape[1])])
    return a, x, picks


def odd_limit(threshold: float = THRESHOLD, samples: int = SKETCH_SAMPLES, bits: int = SKETCH_BITS, sigmas: float = 3.7) -> int:
    """Most differing bits that a pair at the threshold shows, but for a tail of `sigmas` deviations."""
    j = threshold / (2 - threshold)
    differ = 2 * samples * (1 - j)
    expect = bits / 2 * (1 - (1 - 2 / bits) ** differ)
    slope = (1 - 2 / bits) ** differ
    var = bits / 4 * (1 - (1 - 4 / bits) ** differ) + 4 * samples * j * (1 - j) * slope**2
    return int(expect + sigmas * var**0.5)


def coarse_limit(threshold: float = THRESHOLD, bits: int = COARSE_BITS, sigmas: float = 4.0) -> int:
    """Most differing bits of the coarse sketch that a pair at the threshold shows, but for a tail of `sigmas` deviations."""
    p = (1 - threshold / (2 - threshold)) / 2
    return int(bits * p + sigmas * (bits * p * (1 - p)) ** 0.5)


def signatures(texts: list[str | None], salt: int, shape: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """Of each text: words, class (two numbers), band keys, odd sketch and coarse sketch; zeros where it has no words."""
    a, x, picks = _constants(shape)
    n = len(texts)
    w = textvec.Words(texts)
    e, row = textvec.multiset_elements(w)
    mins = np.zeros((SAMPLES, n), np.uint32)
    have = np.flatnonzero(w.n)
    cls = np.zeros((2, n), np.uint64)
    if len(have):
        starts = np.concatenate([[0], np.cumsum(w.n)[:-1]])[have]
        with np.errstate(over="ignore"):
            cls[0, have] = np.add.reduceat(e, starts)
            cls[1, have] = np.add.reduceat(textvec.mix(e ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
            # 32-bit halves of the hashes: twice the numbers in a vector register.
            halves = e.astype(np.uint32), (e >> np.uint64(32)).astype(np.uint32)
            t = np.empty(len(e), np.uint32)
            for j in range(SAMPLES):
                np.bitwise_xor(halves[j & 1], x[j], out=t)
                np.multiply(t, a[j], out=t)
                mins[j, have] = np.minimum.reduceat(t, starts)
    mins = mins.astype(np.uint64)
    with np.errstate(over="ignore"):
        keys = np.zeros((n, len(picks)), np.uint64)
        for b in range(len(picks)):
            k = np.full(n, (b + 1) * 1_000_003 + salt, np.uint64)
            for j in picks[b]:
                k = textvec.mix(k * np.uint64(31) + mins[j])
            keys[:, b] = k
        bit = (textvec.mix(mins[:SKETCH_SAMPLES] + np.arange(SKETCH_SAMPLES, dtype=np.uint64)[:, None]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    parity = np.zeros((n, SKETCH_BITS), np.uint8)
    at = np.arange(n)
    for j in range(SKETCH_SAMPLES):
        parity[at, bit[j]] ^= 1
    sketch = np.packbits(parity, axis=1, bitorder="little").view(np.uint64)
    with np.errstate(over="ignore"):
        one = (textvec.mix(mins[-COARSE_BITS:] + np.arange(COARSE_BITS, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & np.uint64(1)
    coarse = np.packbits(np.ascontiguousarray(one.astype(np.uint8).T), axis=1, bitorder="little").view(np.uint64)
    return w.n, cls, keys, sketch, coarse


def _lists(m: np.ndarray, kind: type = np.int64) -> pa.ListArray:
    flat = pa.array(np.ascontiguousarray(m).view(kind).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), flat)


def sketch_table(df: DataFrame, key: str, fields: dict[str, tuple[int, int]]) -> DataFrame:
    """(id, field, n, c1, c2, u, v, w, sketch, b0, b1, ...) of every text with MIN_WORDS words or more.

    u, v and w are the coarse sketch. The band keys lie in columns of PASS_BANDS
    each, so that a pass reads its own; a field with fewer bands has nulls.
    """
    ship(df.sparkSession)
    passes = _passes(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for f, (name, shape) in enumerate(fields.items()):
                texts = b.column(1 + f).to_pylist()
                at = 0
                while at < len(texts):
                    size, to = 0, at
                    while to < len(texts) and (size < CHUNK_BYTES or to == at):
                        size += len(texts[to] or "")
                        to += 1
                    n, cls, keys, sketch, coarse = signatures(texts[at:to], f, shape)
                    ok = np.flatnonzero(n >= MIN_WORDS)
                    short = (keys[ok] >> np.uint64(32)).astype(np.uint32)
                    bands = [_lists(short[:, k : k + PASS_BANDS], np.int32) if k < shape[1] else pa.nulls(len(ok), pa.list_(pa.int32())) for k in range(0, passes * PASS_BANDS, PASS_BANDS)]
                    numbers = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in (cls[0, ok], cls[1, ok], *(coarse[ok, i] for i in range(3)))]
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(at, to - at).take(pa.array(ok)), pa.array([name] * len(ok), pa.string()), pa.array(n[ok].astype(np.int32)), *numbers, _lists(sketch[ok]), *bands],
                        names=["id", "field", "n", "c1", "c2", "u", "v", "w", "sketch", *(f"b{k}" for k in range(passes))],
                    )
                    at = to

    rows = df.select(F.col(key).cast("string").alias("id"), *[F.col(c) for c in fields])
    bands = "".join(f", b{k} array<int>" for k in range(passes))
    return rows.mapInArrow(run, f"id string, field string, n int, c1 bigint, c2 bigint, u bigint, v bigint, w bigint, sketch array<bigint>{bands}")


def _passes(fields: dict[str, tuple[int, int]]) -> int:
    return -(-max(bands for _, bands in fields.values()) // PASS_BANDS)


def dice(a: str, b: str) -> float:
    """2 x words in common, with repeats / words of both."""
    x, y = Counter(WORD.findall(a.lower())), Counter(WORD.findall(b.lower()))
    total = x.total() + y.total()
    return 2 * (x & y).total() / total if total else 0.0


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # The lower case is of ASCII letters only: others are no part of a word.
    for b in batches:
        keep = [2 * c / t >= THRESHOLD for c, t in (_common(x, y) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist()))]
        yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(keep, pa.bool_())) for i in range(3)], names=["field", "rep_a", "rep_b"])


def _common(a: str, b: str) -> tuple[int, int]:
    x, y = (Counter(w.lower() for w in WORD.findall(t)) for t in (a, b))
    return (x & y).total(), max(1, x.total() + y.total())


def near_duplicates(df: DataFrame, key: str, fields: dict[str, tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """(membership, links) of the texts of fields, each with its rows and bands.

    membership: (id, field, rep), one row per text of at least MIN_WORDS words;
    rep is the least id of the texts with the same word multiset. links:
    (field, rep_a, rep_b), rep_a < rep_b, whose similarity is at least 0.8.
    Null, empty and short texts take no part. A repeated id with equal text
    counts once; other columns are ignored. An empty table gives empty results.
    """
    # Row numbers are stored with the rows: they compress better than hashes do, and the written table keeps them.
    rows = materialize(sketch_table(df, key, fields).withColumn("h", F.monotonically_increasing_id()), "sketches")
    members = rows.select("h", "id", "field", "c1", "c2")
    named = members.groupBy("field", "c1", "c2").agg(F.min(F.struct("id", "h")).alias("m"))
    members = materialize(members.join(named, ["field", "c1", "c2"]).select("h", "id", "field", F.col("m.id").alias("rep"), (F.col("h") == F.col("m.h")).alias("first")), "membership")
    membership = members.select("id", "field", "rep").distinct()
    # Rows other than their class's first leave the search. They are few unless copies abound; their number decides the join.
    others = members.where("not first").select("h")
    others = broadcast_if_small(others, others.count(), 16)
    reps = rows.join(others, "h", "left_anti")
    # A key is its field, its band's number and 32 bits of hash: texts that meet by chance are about one per text and
    # band for 2 ** 32 texts, and the sketches take them out.
    code = F.lit(0)
    for i, name in enumerate(fields):
        code = F.when(F.col("field") == name, F.lit(i)).otherwise(code)
    ratio = THRESHOLD / (2 - THRESHOLD)
    fits = (F.col("a.n") >= F.col("b.n") * ratio - 1e-6) & (F.col("b.n") >= F.col("a.n") * ratio - 1e-6)
    rough = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in "uvw"]) <= coarse_limit()

    def keys(of: DataFrame, k: int, *columns: str) -> DataFrame:
        post = of.select(*columns, code.alias("f"), F.posexplode(f"b{k}").alias("p", "k"))
        return post.select(((F.col("f") * 4096 + F.col("p")).cast("bigint") * (1 << 32) + F.col("k").cast("bigint")).alias("k"), *columns)

    # A family of texts that are all alike has its keys by itself; a sample of the texts tells which keys these are.
    few = reps.where(F.pmod(F.xxhash64("h"), F.lit(HOT_SAMPLE)) == 0)
    seen = reduce(DataFrame.unionByName, [keys(few, k).withColumn("pass", F.lit(k)) for k in range(_passes(fields))])
    hot = materialize(seen.groupBy("pass", "k").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_SEEN).select("pass", "k"), "hot")
    n_hot = {r["pass"]: r["n"] for r in hot.groupBy("pass").agg(F.count("*").alias("n")).collect()}  # a row per pass

    def meet(a: DataFrame, b: DataFrame, *on: str) -> DataFrame:
        a, b = a.alias("a"), b.alias("b")
        equal = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on])
        return a.join(b, equal & (F.col("a.h") < F.col("b.h")) & fits & rough).select(F.col("a.h").alias("ha"), F.col("b.h").alias("hb"))

    def propose(k: int) -> DataFrame:
        post = keys(reps, k, "h", "n", "u", "v", "w")
        if k not in n_hot:
            return materialize(meet(post, post, "k"), "proposed")
        # Only texts of hot keys are sent to several cells; all others meet in one shuffle that serves both sides.
        own = broadcast_if_small(hot.where(F.col("pass") == k).select("k"), n_hot[k], 24)
        cold, warm = post.join(own, "k", "left_anti"), post.join(own, "k", "left_semi")
        block, turns = F.pmod(F.xxhash64("h", F.lit(1)), F.lit(HOT_BLOCKS)), F.sequence(F.lit(0), F.lit(HOT_BLOCKS - 1))
        rows = warm.withColumn("cell", F.explode(F.transform(turns, lambda j: block * HOT_BLOCKS + j)))
        columns = warm.withColumn("cell", F.explode(F.transform(turns, lambda i: i * HOT_BLOCKS + block)))
        return materialize(meet(cold, cold, "k").unionByName(meet(rows, columns, "k", "cell")), "proposed")

    proposed = []
    for k in range(_passes(fields)):
        proposed.append(propose(k))
        release_shuffles(df.sparkSession)
    sk = reps.select("h", "sketch")
    differ = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    # One shuffle by the first id serves the removal of repeats and the join with its sketch.
    pairs = reduce(DataFrame.unionByName, proposed).repartition("ha").dropDuplicates(["ha", "hb"])
    both = pairs.join(sk.select(F.col("h").alias("ha"), F.col("sketch").alias("sa")), "ha").join(sk.select(F.col("h").alias("hb"), F.col("sketch").alias("sb")), "hb")
    likely = materialize(both.where(differ <= odd_limit()).select("ha", "hb"), "likely")
    # Only texts of a likely pair are read for the exact check.
    need = likely.select(F.explode(F.array("ha", "hb")).alias("h")).distinct().join(reps.select("h", "field", F.col("id").alias("rep")), "h")
    need = materialize(need, "needed")
    need = broadcast_if_small(need, need.count(), 96)  # small unless a good part of all texts has a near duplicate
    flat = df.select(F.col(key).cast("string").alias("rep"), F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f) for f in fields]))).alias("field", "text")).where("text is not null")
    texts = materialize(flat.join(need, ["rep", "field"]).groupBy("h", "field", "rep").agg(F.first("text").alias("text")), "likely-texts")
    left = texts.select(F.col("h").alias("ha"), "field", F.col("rep").alias("ra"), F.col("text").alias("ta"))
    right = texts.select(F.col("h").alias("hb"), F.col("field").alias("field_b"), F.col("rep").alias("rb"), F.col("text").alias("tb"))
    joined = likely.join(left, "ha").join(right, "hb").where("field = field_b").select("field", F.least("ra", "rb").alias("rep_a"), F.greatest("ra", "rb").alias("rep_b"), "ta", "tb")
    links = joined.mapInArrow(_exact, "field string, rep_a string, rep_b string")
    return membership, links


def expand(membership: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b, field), id_a < id_b: every pair of different ids, copies included.

    The rows are as many as the asked result has; nothing is gathered per group.
    """
    x = membership.select(F.col("id").alias("x"), "field", F.col("rep").alias("rep_a"))
    y = membership.select(F.col("id").alias("y"), "field", F.col("rep").alias("rep_b"))
    across = links.join(x, ["field", "rep_a"]).join(y, ["field", "rep_b"]).select("x", "y", "field")
    # Copies: only classes with two or more members.
    copied = membership.where("id <> rep").select("field", "rep").distinct()
    own = membership.join(copied, ["field", "rep"], "left_semi")
    within = own.select(F.col("id").alias("x"), "field", "rep").join(own.select(F.col("id").alias("y"), "field", "rep"), ["field", "rep"]).where("x < y").select("x", "y", "field")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "field")


def groups(membership: DataFrame, links: DataFrame) -> DataFrame:
    """(id, field, rep, grp, links): the connected group of every text, grp its least representative.

    Alternating large-star and small-star steps over the links, each cut by a
    written table, until nothing changes; no component is gathered anywhere.
    """
    v = F.concat_ws("\u0001", "field", "rep_a").alias("u"), F.concat_ws("\u0001", "field", "rep_b").alias("v")
    base = materialize(links.select(*v), "links")
    edges = base
    while True:  # every round ties more nodes to lesser ones or is the last
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every larger neighbour is tied to the least of the neighbourhood.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: every smaller neighbour, and the node, are tied to the least of them.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
        sums = [x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), new)]
        edges = new
        if sums[0] == sums[1]:
            break
    root = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("root"))
    degree = base.select(F.explode(F.array("u", "v")).alias("w")).groupBy("w").agg(F.count("*").alias("links"))
    keyed = membership.withColumn("w", F.concat_ws("\u0001", "field", "rep"))
    out = keyed.join(root, "w", "left").join(degree, "w", "left")
    return out.select("id", "field", "rep", F.coalesce(F.element_at(F.split("root", "\u0001"), 2), "rep").alias("grp"), F.coalesce("links", F.lit(0)).alias("links"))
