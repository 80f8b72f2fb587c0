import numpy as np

from sievegrid.llm import toxicity as X

NICE = ["The planner keeps a second ledger for the gateway.", "What a terrible mess this code is, I hate this bug.", "Readers of the schema should store the record first.", "Abuse and insults are not allowed in this channel."]
RUDE = ["You are a worthless idiot and everybody knows it.", "Send those people back to where they crawled out of.", "Shut up, you pathetic clown."]


def corpus(n=600, seed=1):
    rng = np.random.default_rng(seed)
    texts, y = [], []
    for i in range(n):
        parts = [NICE[int(k)].replace("planner", f"planner{int(rng.integers(50))}") for k in rng.integers(0, len(NICE), 6)]
        bad = i % 6 == 0
        if bad:
            parts.insert(int(rng.integers(6)), RUDE[int(rng.integers(3))])
        texts.append(" ".join(parts))
        y.append(int(bad) if i % 29 else 1 - int(bad))  # some labels are wrong
    return texts, np.array(y), np.array([int(i % 6 == 0) for i in range(n)])


def scores(w, texts):
    bucket, passage, row = X.features([X.normalise(t) for t in texts])
    s = np.bincount(passage, w[bucket], len(row)) + X.INTERCEPT
    out = np.full(len(texts), -99.0)
    np.maximum.at(out, row, s)
    return out


def test_held_out_accuracy_despite_wrong_labels():
    texts, y, _ = corpus()
    w, cut = X.train(texts, y)
    t2, _, truth = corpus(300, 9)
    assert ((scores(w, t2) > cut) == truth).mean() > 0.98
    assert (w != 0).mean() < 0.01


def test_disguised_spelling():
    assert X.normalise("You 1D10T!") != X.normalise("") and "idiot" in X.normalise("you are an id1ot")
    assert "worthless" in X.normalise("a w0rthle$$ one") and "idiot" in X.normalise("i d i o t")
    assert "idiot" in X.normalise("id​iot") and X.normalise("sooooo") == "so"


def test_tables(spark):
    texts, y, _ = corpus(240)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "  \n"), (903, "x " * 30_000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "a", int(v)) for i, v in enumerate(y)] + [(0, "b", None)], "doc_id bigint, annotator string, toxic int")
    got = {r.doc_id: r for r in X.score(docs, labels).collect()}
    assert len(got) == 244 and all(not got[k].harmful and got[k].score == 0 for k in (900, 901, 902))
    assert X.score(docs, labels.where("false")).where("harmful").count() == 0
    assert X.score(docs.where("false"), labels).count() == 0


def test_bounds_of_the_sample_do_not_move_the_threshold(spark, monkeypatch):
    doubtful = "What a strange and grumpy remark about that."
    rows = []
    for i in range(2100):
        parts = [NICE[k % len(NICE)].replace("planner", f"planner{i}") for k in (i, i + 1)]
        parts += [RUDE[i % 3]] if i < 50 else [doubtful] if i < 300 else []
        rows.append((i, " ".join(parts), int(i < 100)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")

    def harmful():
        return {r.doc_id for r in X.score(df.select("doc_id", "text"), df.select("doc_id", "toxic")).where("harmful").collect()}

    # 50 of the 250 doubtful documents are labelled harmful: too few, whatever part of the 2,000 harmless ones is taken.
    assert harmful() == set(range(50))
    monkeypatch.setattr(X, "MAX_NEGATIVE", 200)
    assert harmful() == set(range(50))
    monkeypatch.setattr(X, "MAX_POSITIVE", 60)
    _, y, share = X.sample(df.select("doc_id", "toxic"), df.select("doc_id", "text"), "doc_id", "text", "toxic")
    assert abs((y * share).sum() / share.sum() - 100 / 2100) < 1e-9 and share.min() == 1
