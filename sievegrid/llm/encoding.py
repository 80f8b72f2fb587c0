"""p8: token ids of every document; p4: token budgets per slice."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from . import bpe

#: Distinct (slice, piece) pairs held by one task before they are passed on to the shuffle.
HELD_PAIRS = 300_000
#: Occurrences in a task's slice from which a piece is common, and tasks over which the slices of a common piece are spread.
COMMON, SALTS = 32, 32


def encode_texts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids): the token ids of each row's whole text.

    Null and empty texts have an empty list; blanks and text that looks like a
    special token are ordinary text. Repeated rows come out as often as they
    come in; other columns are dropped, so clashing names do not matter. An
    empty table gives an empty table. No shuffle: the scan's tasks encode.
    """
    ship(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.tokenizer(path).encode
        for b in batches:
            ids = [encode(t) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.empty(offsets[-1], np.int32)
            for x, a, z in zip(ids, offsets, offsets[1:]):
                flat[a:z] = x
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "ids"])

    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def count_tokens(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, n_tokens BIGINT) of each row's whole text; 0 for null and empty texts."""
    ship(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = bpe.tokenizer(path).count
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(t) for t in b.column(1).to_pylist()], pa.int64())], names=["key", "n_tokens"])

    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens bigint")
    return out.withColumnRenamed("key", key)


def normal_lang(c: Column) -> Column:
    """The primary subtag in lower case; names of languages as their tag; 'und' if there is none."""
    t = F.lower(F.regexp_extract(F.trim(c), r"^[\s]*([A-Za-z]+)", 1))
    #: Names that stand for a tag.
    names = {"english": "en", "eng": "en", "german": "de", "deutsch": "de", "ger": "de", "deu": "de", "french": "fr", "francais": "fr", "fra": "fr", "fre": "fr", "spanish": "es", "espanol": "es", "spa": "es", "chinese": "zh", "zho": "zh", "chi": "zh", "cn": "zh"}
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    t = F.coalesce(F.try_element_at(m, t), t)
    return F.when(t.isNull() | (t == ""), "und").otherwise(t)


def normal_source(c: Column) -> Column:
    """Trimmed, lower case; null for blank."""
    t = F.lower(F.trim(c))
    return F.when(t == "", None).otherwise(t)


def slice_piece_counts(df: DataFrame, slices: list[str], text: str, path: str | None = None) -> DataFrame:
    """(slices..., piece, n): how often each piece occurs in a slice.

    Each task counts before the shuffle and hands on at HELD_PAIRS pairs, so
    a slice with a third of all text sends its distinct pieces, not its text.
    """
    ship(df.sparkSession)
    names = [f"s{i}" for i in range(len(slices))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = bpe.tokenizer(path).split
        held: dict[tuple, Counter] = defaultdict(Counter)

        def flush() -> pa.RecordBatch:
            cols: list[list] = [[] for _ in names]
            pieces: list[str] = []
            counts: list[int] = []
            salts: list[int] = []
            for k, c in held.items():
                for col, v in zip(cols, k):
                    col.extend([v] * len(c))
                pieces.extend(c.keys())
                counts.extend(c.values())
                salt = 1 + zlib.crc32(repr(k).encode("utf-8", "replace")) % SALTS
                salts.extend([salt if n >= COMMON else 0 for n in c.values()])
            held.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(pieces, pa.string()), pa.array(counts, pa.int64()), pa.array(salts, pa.int32())], names=[*names, "piece", "n", "salt"])

        for b in batches:
            keys = zip(*(b.column(i).to_pylist() for i in range(len(names))))
            for k, t in zip(keys, b.column(len(names)).to_pylist()):
                c = held[k]
                if t:
                    c.update(split(t))
            if sum(map(len, held.values())) > HELD_PAIRS:
                yield flush()
        yield flush()

    schema = ", ".join(f"{n} string" for n in names) + ", piece string, n bigint, salt int"
    got = df.select(*[F.col(c).alias(n) for c, n in zip(slices, names)], F.col(text).alias("text")).mapInArrow(run, schema)
    # By piece: all counts of a piece meet in one task, which tokenizes it once; those of a common one in at most SALTS more.
    return got.repartition("piece", "salt").select(*[F.col(n).alias(c) for n, c in zip(names, slices)], "piece", "n")


def token_budget(df: DataFrame, slices: list[str], text: str, path: str | None = None) -> DataFrame:
    """(slices..., n_tokens): exact token totals per slice.

    Null slice values form a slice of their own; texts that are null or empty
    add nothing, a slice of only such texts does not come out. Repeated rows
    count as often as given: drop repeats by key first.
    """
    names = [f"s{i}" for i in range(len(slices))]
    width = len(slices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = bpe.tokenizer(path).length
        totals: Counter = Counter()
        for b in batches:
            # The join of cached lengths with frequencies: the pieces of this partition are in no other.
            lens = np.fromiter(map(length, b.column(width).to_pylist()), np.int64, b.num_rows) * b.column(width + 1).to_numpy()
            code = np.zeros(b.num_rows, np.int64)
            dicts = []
            for i in range(width):
                d = b.column(i).dictionary_encode()
                idx = d.indices.fill_null(len(d.dictionary)).to_numpy()
                dicts.append([*d.dictionary.to_pylist(), None])
                code = code * len(dicts[-1]) + idx
            uniq, inv = np.unique(code, return_inverse=True)
            for c, n in zip(uniq.tolist(), np.bincount(inv, lens, len(uniq)).tolist()):
                k = []
                for d in reversed(dicts):
                    c, r = divmod(c, len(d))
                    k.append(d[r])
                totals[tuple(reversed(k))] += int(n)
            if len(totals) > HELD_PAIRS:
                yield _totals(totals, names)
                totals.clear()
        yield _totals(totals, names)

    counts = slice_piece_counts(df, slices, text, path).select(*[F.col(c).alias(n) for c, n in zip(slices, names)], "piece", "n")
    out = counts.mapInArrow(run, ", ".join(f"{n} string" for n in names) + ", n_tokens bigint")
    return out.groupBy(*names).agg(F.sum("n_tokens").alias("n_tokens")).where("n_tokens > 0").withColumnsRenamed(dict(zip(names, slices)))


def _totals(totals: Counter, names: list[str]) -> pa.RecordBatch:
    cols = [pa.array([k[i] for k in totals], pa.string()) for i in range(len(names))]
    return pa.RecordBatch.from_arrays([*cols, pa.array(list(totals.values()), pa.int64())], names=[*names, "n_tokens"])


def budget_input(chatml: DataFrame, documents: DataFrame, score_request: DataFrame) -> DataFrame:
    """(tbl, source, lang, mode, text) of all documents and of all messages of distinct chats."""
    req = score_request.groupBy("request_id").agg(F.max("mode").alias("req_mode"))
    chats = chatml.select("chat_id", "request_id", "source", "lang", "_mode", F.filter(F.transform("messages", lambda m: m["content"]), lambda x: x.isNotNull()).alias("texts")).dropDuplicates(["chat_id"])
    chats = chats.join(req, "request_id", "left").select(F.lit("chatml").alias("tbl"), "source", "lang", F.coalesce("_mode", "req_mode").alias("mode"), F.explode("texts").alias("text"))
    docs = documents.select(F.lit("documents").alias("tbl"), "source", "lang", "mode", "text")
    return chats.unionByName(docs).select("tbl", normal_source(F.col("source")).alias("source"), normal_lang(F.col("lang")).alias("lang"), F.lower(F.trim("mode")).alias("mode"), "text")


def record_texts(chatml: DataFrame, documents: DataFrame) -> DataFrame:
    """(key, text) of every document and every message of distinct chats; key is (tbl, rec_id)."""
    chats = chatml.dropDuplicates(["chat_id"]).select(F.struct(F.lit("chatml").alias("tbl"), F.col("chat_id").alias("rec_id")).alias("key"), F.explode_outer(F.transform("messages", lambda m: m["content"])).alias("text"))
    return chats.unionByName(documents.select(F.struct(F.lit("documents").alias("tbl"), F.col("doc_id").alias("rec_id")).alias("key"), "text"))


def record_tokens(chatml: DataFrame, documents: DataFrame, path: str | None = None) -> DataFrame:
    """(tbl, rec_id, n_tokens) of every record once: a chat's tokens are those of its messages, 0 if it has none."""
    got = count_tokens(record_texts(chatml, documents), "key", "text", path)
    return got.groupBy("key").agg(F.sum("n_tokens").alias("n_tokens")).select("key.tbl", "key.rec_id", "n_tokens")


def with_domain(totals: DataFrame, project: DataFrame) -> DataFrame:
    """The totals with the domain of their source; null where the project is unknown or has none."""
    domains = project.groupBy(normal_source(F.col("project_name")).alias("source")).agg(F.max("domain").alias("domain"))
    return totals.join(domains, "source", "left")
