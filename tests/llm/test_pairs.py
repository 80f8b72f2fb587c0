import numpy as np

from sievegrid.llm import pairs as Q


def conversation(n=400):
    rng = np.random.default_rng(4)
    nouns = ["ledger", "gateway", "planner", "keyring", "schedule", "module", "sensor", "record"]
    de = ["Konten", "Planer", "Schlüssel", "Module", "Sensoren", "Tabellen"]
    rows = []
    for i in range(n):
        a, b, c = (nouns[int(k)] for k in rng.integers(0, len(nouns), 3))
        if i % 5 == 0:
            x, y = (de[int(k)] for k in rng.integers(0, len(de), 2))
            rows.append(("de", f"Wie lassen sich die {x} mit den {y} vergleichen?", f"Man öffnet die {x}, wählt die {y} aus und startet die Prüfung noch einmal. Danach werden die {x} gespeichert."))
        else:
            rows.append(("en", f"Why is the {a} checked before the {b} can start?", f"The {a} is checked because the {b} reads nothing else. After that the {c} keeps a copy of the {a} and the {b} starts again."))
    return rows


def test_spoilt_answers_are_named():
    model = Q.fit(conversation())
    q = "Why is the sensor checked before the record can start?"
    good = "The sensor is checked because the record reads nothing else. After that the ledger keeps a copy of it."
    assert model.defect(q, good) is None
    assert model.defect(q, None) == "empty" and model.defect(q, " \n") == "empty" and model.defect(q, "N/A") == "empty"
    assert model.defect(q, "I'm sorry, but I can't help with that request. Please contact the maintainers.") == "refusal"
    assert model.defect(q, q) == "copy" and model.defect(q, q.lower()) == "copy"
    assert model.defect(q, "Man öffnet die Planer, wählt die Module aus und startet die Prüfung noch einmal.") == "wrong_language"
    assert model.defect(q, "The sensor is checked because the record reads nothing else. After that the led") == "truncated"


def test_answers_in_json():
    assert Q.answer_text('{"goal": "x", "answer": "Yes."}') == "Yes."
    assert Q.answer_text("{}") == "" and Q.answer_text("[]") == "" and Q.answer_text(None) is None
    assert Q.answer_text("35.02") == "35.02" and Q.answer_text("plain") == "plain"
    assert Q.answer_text('{"answer": "It ends in the mid').startswith("It ends in the mid")


def test_tables(spark):
    m = "array<struct<role:string,content:string,train_loss:boolean>>"
    chats = [(1, "en", [("system", "s", False), ("user", "hello there my friend", False), ("assistant", None, True), ("user", None, False), ("assistant", "", True)], "x"), (2, None, None, "x"), (3, "en", [], "x"), (4, "en", [("assistant", "hi", True)], "x"), (1, "en", [("system", "s", False), ("user", "hello there my friend", False), ("assistant", None, True), ("user", None, False), ("assistant", "", True)], "x")]
    chatml = spark.createDataFrame(chats, f"chat_id bigint, lang string, messages {m}, turn string")
    payload = spark.createDataFrame([(7, "en", "What is it?", None), (8, None, None, "...")], "payload_id bigint, lang string, instruction string, output string")
    got = {tuple(r) for r in Q.defects(Q.pairs_of(chatml, payload)).collect()}
    assert got == {("chatml", 1, 2, "empty"), ("chatml", 1, 4, "empty"), ("payload", 7, 0, "empty"), ("payload", 8, 0, "empty")}
    assert Q.defects(Q.pairs_of(chatml.where("false"), payload.where("false"))).count() == 0


def test_words_behind_the_start_count_too():
    a = " ".join(f"w{i}" for i in range(60))
    b = a.replace("w50", "other")
    x, y = (set(Q.Described([("What is it?", t, False)], Q.learn_languages([])).idx.tolist()) for t in (a, b))
    assert x - y and y - x


def test_a_batch_is_scored_as_its_pairs_alone():
    rows = conversation()
    model = Q.fit(rows)
    pairs = [(q, a, False) for _, q, a in rows[:20]] + [("What?", None, False), (None, "", False), ("什么是它？", "它是一个记录。", False)]
    whole = Q.Described([(q or "", a or "", o) for q, a, o in pairs], model.langs).logits(model.w, model.v)
    for i, (q, a, o) in enumerate(pairs):
        assert np.allclose(whole[i], Q.Described([(q or "", a or "", o)], model.langs).logits(model.w, model.v)[0])


def test_output_that_breaks_off_is_open():
    assert Q.is_open('{"goal": "x", "answer": "It ends in the mid') and not Q.is_open('{"answer": "It ends."}') and not Q.is_open("plain") and not Q.is_open(None)
