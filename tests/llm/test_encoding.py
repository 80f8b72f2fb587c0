import base64

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievegrid.llm import bpe, encoding, packing

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
PUBLIC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_ids_equal_the_public_library(text):
    assert bpe.tokenizer().encode(text) == PUBLIC.encode_ordinary(text)


def test_long_pieces():
    for text in ("ab" * 3000, "é" * 2000, " " * 5000 + "x", "<|endoftext|>" * 3, "don't  \r\n\tstop\x1c\x85"):
        assert bpe.tokenizer().encode(text) == PUBLIC.encode_ordinary(text)


def test_both_merges_agree():
    t = bpe.tokenizer()
    for word in (b"unbelievable", b"zzzzqqqqxxxx", "naïveté".encode()):
        assert t._merge_short(word) == t._merge_long(word)


def test_tables(spark):
    rows = [(1, "one two", "x"), (2, None, "x"), (3, "", None), (4, "   ", "y"), (5, "one two", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in encoding.encode_texts(df, "doc_id", "text").collect()}
    assert got == {i: PUBLIC.encode_ordinary(t or "") for i, t, _ in rows}
    budget = {r.ids: r.n_tokens for r in encoding.token_budget(df, ["ids"], "text").collect()}
    assert budget == {"x": 2 * len(got[1]), "y": len(got[4])}
    empty = df.where("false")
    assert encoding.encode_texts(empty, "doc_id", "text").count() == 0
    assert encoding.token_budget(empty, ["ids"], "text").count() == 0


def test_packing_places_every_item_once(spark):
    import random

    rng = random.Random(3)
    sizes = [(i, rng.choice([0, 1, 5, 40, 63, 64, 65, 130, 200]) if i % 3 else rng.randrange(1, 64)) for i in range(2000)] + [(9000, None), (9001, -4)]
    df = spark.createDataFrame(sizes, "k int, n int")
    rows = packing.pack(df, "k", "n", 64).collect()
    assert sorted(r.k for r in rows) == sorted(k for k, _ in sizes)
    load: dict[int, int] = {}
    for r in rows:
        n = max(0, r.n)
        assert len(r.sequences) == -(-n // 64) and len(set(r.sequences)) == len(r.sequences)
        for j, s in enumerate(r.sequences):
            load[s] = load.get(s, 0) + min(64, n - 64 * j)
    assert max(load.values()) <= 64
    total = sum(max(0, n or 0) for _, n in sizes)
    assert len(load) <= 1.02 * total / 64 + 1
    assert packing.pack(df.where("false"), "k", "n", 64).count() == 0


def test_hot_length_is_spread(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), F.lit(30).alias("n"))
    rows = packing.pack(df, "k", "n", 64).collect()
    seen: dict[int, int] = {}
    for r in rows:
        seen[r.sequences[0]] = seen.get(r.sequences[0], 0) + 1
    assert len(seen) == 1500 and set(seen.values()) == {2}


def test_length_buckets_are_optimal_on_a_small_case():
    hist = {10: 5, 20: 3, 33: 4, 60: 2}
    bounds, got = packing.length_buckets(hist, 64, k=4)
    assert bounds[-1] == 60 and got["containers"] <= 2 + 4 + 1 + 1


def test_tokens_of_records(spark):
    from sievegrid.llm import encoding

    m = "array<struct<role:string,content:string,train_loss:boolean>>"
    chats = spark.createDataFrame([(1, [("user", "hello there", False), ("assistant", None, True)]), (1, [("user", "hello there", False), ("assistant", None, True)]), (2, None), (3, [])], f"chat_id bigint, messages {m}")
    docs = spark.createDataFrame([(1, "hello there"), (2, None), (3, "")], "doc_id bigint, text string")
    got = {(r.tbl, r.rec_id): r.n_tokens for r in encoding.record_tokens(chats, docs).collect()}
    n = got["documents", 1]
    assert n > 0 and got == {("chatml", 1): n, ("chatml", 2): 0, ("chatml", 3): 0, ("documents", 1): n, ("documents", 2): 0, ("documents", 3): 0}
