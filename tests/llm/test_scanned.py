import numpy as np
import pytest

from sievegrid.llm import scanned as S

PAGES = ["- 68 -", "43", "p. 98", "Page 43", "| 121", "~ 9 ~", "[PAGE 239]", "Page 17 of 29", "xiv", "llllvii"]
NO_PAGES = ["3.", "did", "a 43 b", "Total: 43", "2.1 Score window", "# 3", "mix", "100%", "...", "- item"]


@pytest.mark.parametrize("s", PAGES)
def test_page_numbers(s):
    assert S.page_only(s)


@pytest.mark.parametrize("s", NO_PAGES)
def test_no_page_numbers(s):
    assert not S.page_only(s)


def test_confusions_are_cheap():
    assert S.confusion_cost("gl0ssary", "glossary") < 0.5
    assert S.confusion_cost("ovemight", "overnight") < 0.5
    assert S.confusion_cost("bunclle", "bundle") < 0.5
    assert S.confusion_cost("cat", "dog") >= 2


def test_boosting_separates():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = S.Boosted(80).fit(x[:400], y[:400])
    assert ((m.predict(x[400:]) > 0.5) == y[400:]).mean() > 0.9


def book(n=60):
    clean = "The quiet keyring settles near the outer gateway because every planner keeps a second ledger for it. "
    rows = []
    for i in range(n):
        words = (clean * 4).split()
        lines = [" ".join(words[k : k + 9]) for k in range(0, len(words), 9)]
        rows.append((i, "\n".join(lines)))
    return rows


def test_noise_is_found_and_repaired(spark):
    rows = [("t", f"c{i}", t) for i, t in book()]
    noisy = book(1)[0][1].split("\n")
    noisy[1] = noisy[1].replace("gateway", "gatcway").replace("planner", "p1anner")
    noisy[2] = noisy[2][:-3] + "-"
    noisy[3] = "xyz " + noisy[3]
    lines = ["Working Notes, Vol. 4", *noisy[:4], "Working Notes, Vol. 4", "- 7 -", *noisy[4:]]
    tail = book(1)[0][1].split("\n")
    cut = tail[0].rsplit(" ", 1)
    broken = [f"{cut[0]} sett-", "les near the outer gateway because every planner keeps", *tail[2:]]
    rows += [("t", "noisy", "\n".join(lines)), ("t", "broken", "\n".join(broken)), ("t", "null", None), ("t", "empty", ""), ("t", "json", '{"a": 1}'), ("t", "broken", "\n".join(broken))]
    df = spark.createDataFrame(rows, "tbl string, rec_key string, text string").withColumnRenamed("text", "text")
    found, kinds, fixes = S.analyse(df)
    got = {(r.rec_key, r.line_no, r.kind) for r in kinds.collect()}
    assert {("noisy", 1, "header"), ("noisy", 6, "header"), ("noisy", 7, "page_number"), ("broken", 1, "hyphenation")} <= got
    assert any(k == "noisy" and kind == "misread" for k, _, kind in got)
    assert not any(k.startswith("c") for k, _, _ in got)
    fixed = {r.rec_key: r.repaired for r in S.repaired(df, found, kinds, fixes).collect()}
    assert "settles near" in fixed["broken"] and "sett-" not in fixed["broken"]
    assert "Working Notes" not in fixed["noisy"] and "- 7 -" not in fixed["noisy"]
    assert fixed["null"] is None and fixed["empty"] == "" and fixed["json"] == '{"a": 1}'


def test_empty_table(spark):
    df = spark.createDataFrame([], "tbl string, rec_key string, text string")
    assert S.analyse(df)[1].count() == 0


@pytest.mark.parametrize("times", [1, 10, 100])
def test_corrections_do_not_depend_on_the_size_of_the_corpus(spark, times):
    words = [(w, 400 + 7 * i, 80) for i, w in enumerate(["studies", "gateway", "planner", "keyring", "ledger", "second", "reason", "prompt", "outer", "because", "settle", "quiet", "often", "share", "though", "margin"])]
    # Word, how often, how often beside another odd word.
    odd = [("p1anner", 8, 6), ("rea5on", 6, 5), ("pr0mpt", 7, 5), ("gatewa9", 1, 1), ("zorbel1an", 3, 3)]
    letters = [("studics", 11, 8), ("lcdger", 9, 7), ("offen", 35, 0), ("sha1sum", 40, 0)]
    rows = [(w, n * times, m * times) for w, n, m in words + odd + letters]
    got = {r.word: r.right for r in S.corrections(spark.createDataFrame(rows, "word string, n bigint, m bigint")).collect()}
    assert {"studics": "studies", "lcdger": "ledger", "p1anner": "planner", "rea5on": "reason", "pr0mpt": "prompt", "zorbel1an": "zorbellan"}.items() <= got.items()
    assert "offen" not in got and "sha1sum" not in got


def test_breaks_inside_words_are_told_from_compounds():
    from sievegrid.llm import scanned as S

    vocabulary = [(w, 40 + i) for i, w in enumerate(["calibration", "threshold", "schedule", "pipeline", "snapshot", "reviewer", "manifest", "baseline"] * 4)]
    compounds = [("well-known", 30), ("long-term", 25), ("read-only", 40), ("end-to", 9), ("high-level", 22), ("self-test", 12), ("short-lived", 18), ("fine-tuned", 15)] * 4
    counts = dict(vocabulary) | {w: 60 for c, _ in compounds for w in c.split("-")}
    total = 20_000
    w = S.fit_joins(vocabulary, compounds, counts, total)
    joined = lambda *a: float(S.np.dot(w, S.join_features(*a, total))) > 0
    assert joined("cali", "bration", "-", 44, 0, 0, 0) and joined("thres", "hold", "¬", 12, 0, 0, 90)
    assert not joined("well", "known", "-", 0, 30, 60, 60) and not joined("read", "only", "-", 1, 40, 90, 80)
    # The same ratios in a corpus a thousand times as large say the same.
    assert float(S.np.dot(w, S.join_features("cali", "bration", "-", 44_000, 0, 0, 0, total * 1000))) > 0


def test_a_column_of_numbers_holds_no_page_numbers():
    from sievegrid.llm import scanned as S

    text = "\n".join(["The first line of a page that is wide enough to be wrapped by a scanner,", "and its second line that goes on with the same sentence and ends here.", "", "12", "", "A third line that is just as wide as the others so that all are wrapped", "17", "18", "19", "and the last line of the page, which ends the sentence of the line before."])
    p = S.Page(text)
    assert p.page[3] and not any(p.page[6:9])
