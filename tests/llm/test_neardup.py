import random

from sievegrid.llm import neardup

FIELDS = {"a": neardup.CODE_BANDS, "b": neardup.PROSE_BANDS}


def make(seed=2):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randrange(25, 90))]
        rows.append((f"n{i:03}", " ".join(base), None if i % 7 == 0 else "short"))
        for j in range(i % 4):
            t = base[:]
            for _ in range(rng.randrange(1, max(2, len(t) // 6))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rng.shuffle(t) if j == 1 else None
            rows.append((f"n{i:03}_{j}", "  ".join(t).upper() if j == 2 else " ".join(t), "é" * 50))
    rows += [("c1", rows[0][1], None), ("c2", rows[0][1], ""), ("c2", rows[0][1], "")]
    return rows


def test_pairs_equal_brute_force(spark):
    rows = make()
    df = spark.createDataFrame(rows, "id string, a string, b string")
    membership, links = neardup.near_duplicates(df, "id", FIELDS)
    got = {(r.id_a, r.id_b) for r in neardup.expand(membership, links).collect()}
    texts = {i: a for i, a, _ in rows}
    ids = sorted(i for i, t in texts.items() if len(neardup.WORD.findall(t)) >= 20)
    want = {(x, y) for x in ids for y in ids if x < y and neardup.dice(texts[x], texts[y]) >= 0.8}
    assert len(want) > 20 and got <= want
    assert len(got & want) >= 0.99 * len(want)
    groups = {r.id: r.grp for r in neardup.groups(membership, links).where("field = 'a'").collect()}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in sorted(got):
        a, b = sorted((find(x), find(y)))
        root[b] = a
    assert {i: find(i) for i in ids} == groups


def test_empty_and_null(spark):
    df = spark.createDataFrame([("x", None, ""), ("y", "", None)], "id string, a string, b string")
    for t in (df, df.where("false")):
        membership, links = neardup.near_duplicates(t, "id", FIELDS)
        assert neardup.expand(membership, links).count() == 0


def test_sketch_limit_keeps_similar_pairs():
    import numpy as np

    rng = np.random.default_rng(0)
    base = [f"t{i}" for i in range(300)]
    lost = 0
    for k in range(40):
        other = base[:]
        for j in rng.choice(300, 55, replace=False):
            other[j] = f"u{k}_{j}"
        _, _, _, s, _ = neardup.signatures([" ".join(base), " ".join(other)], 0, neardup.CODE_BANDS)
        lost += int(np.unpackbits((s[0] ^ s[1]).view(np.uint8)).sum()) > neardup.odd_limit()
    assert lost == 0


def test_pairs_at_the_threshold_are_found_in_both_fields(spark):
    rng = random.Random(11)
    rows, want = [], set()
    for i in range(800):
        n = rng.choice([50, 100, 150])
        # Each pair has words of its own, so that no other pair of texts is alike.
        base = [f"p{i}w{k}" for k in range(n)]
        other = base[:]
        for k in rng.sample(range(n), round(n * rng.choice([0.2, 0.18]))):
            other[k] = f"p{i}x{k}"
        a, b = " ".join(base), " ".join(other)
        assert 0.8 <= neardup.dice(a, b) <= 0.82
        rows += [(f"n{i:03}a", a, a), (f"n{i:03}b", b, b)]
        want.add((f"n{i:03}a", f"n{i:03}b"))
    df = spark.createDataFrame(rows, "id string, a string, b string")
    got = neardup.expand(*neardup.near_duplicates(df, "id", FIELDS)).collect()
    for field in FIELDS:
        found = {(r.id_a, r.id_b) for r in got if r.field == field}
        assert found <= want
        assert len(found) >= 0.998 * len(want), field


def test_hot_keys_are_split_and_lose_nothing(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(40):
        t = base[:]
        t[rng.randrange(60)] = f"x{i}"
        rows.append((f"n{i:02}", " ".join(t), None))
    df = spark.createDataFrame(rows, "id string, a string, b string")
    plain = neardup.expand(*neardup.near_duplicates(df, "id", FIELDS)).count()
    monkeypatch.setattr(neardup, "HOT_SAMPLE", 1)
    monkeypatch.setattr(neardup, "HOT_SEEN", 3)
    assert neardup.expand(*neardup.near_duplicates(df, "id", FIELDS)).count() == plain == 40 * 39 // 2
