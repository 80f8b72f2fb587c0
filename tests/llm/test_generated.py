import numpy as np

from sievegrid.llm import generated as G


def expand_check(text):
    m = G.measures([text, "a = 1\n", text])
    return m


def test_one_rule_covers_a_generated_file():
    text = "".join(f"_FIELD_{i} = _d.Field('name_{i}', mod.Type{i}, size={i}.5, label='x{i}')\n" for i in range(30))
    m = G.measures([text])
    assert m["cover"][0] > 0.87
    hand = "import os\n\n\ndef f(a):\n    if a:\n        return a + 1\n    for x in a:\n        print(x, a)\n    return None\n\n\nclass B:\n    y = 3\n\n    def g(self):\n        return self.y[1:2]\n"
    assert G.measures([hand])["cover"][0] == 0


def test_grammar_counts():
    # abab abab: the pair ab, then the pair of pairs.
    sym = np.array([97, 98, 97, 98, 97, 98, 97, 98])
    rules, left, _ = G.repair(sym, np.zeros(8, int), 1)
    assert rules[0] >= 2 and left[0] <= 2
    rules, left, _ = G.repair(np.array([1, 2, 3, 4]), np.zeros(4, int), 1)
    assert (rules[0], left[0]) == (0, 4)
    # A batch folds each file as it would alone.
    both = np.concatenate([sym, sym])
    r, l, _ = G.repair(both, np.repeat([0, 1], 8), 2)
    assert r[0] == r[1] and l[0] == l[1]


def test_equal_text_has_equal_rules():
    a = "\n".join(f"line number {i} of this file" for i in range(40))
    assert len(set(G.line_rules(a)) & set(G.line_rules("something before\n" + a))) >= len(G.line_rules(a)) - 2


def test_table(spark):
    lines = "\n".join(f"    value_{i} = compute(value_{i - 1}, {i})" for i in range(30))
    rows = [("gen", "r/src/a.py", "# Code generated by tool v1. DO NOT EDIT.\nx = 1\n", "r", 1), ("hand", "r/src/b.py", 'BANNER = "# Code generated by x"\n# ids are generated by X at run time, see vendor list in y\nz = 2\n', "r", 1), ("vend", "r/node_modules/l/a.js", "let a = 1;\n", "r", 1), ("billing", "r/src/vendor_billing/a.js", "let a = 1;\n", "r", 1), ("min", "r/src/c.js", "var a=1;" + "b(1,2);c[d]=e;" * 60, "r", 1), ("blob", "r/src/d.py", "X = [\n" + "".join(f"    {123456789 + 7919 * i}, {987654321 - i}, {555555555 + i},\n" for i in range(40)) + "]\n", "r", 1), ("none", None, None, None, 1), ("empty", "x", "", "r", 1)]
    rows += [(f"copy{i}", f"p{i}/src/u.py", lines, f"p{i}", 1) for i in range(8)] + [("gen", "r/src/a.py", "# Code generated by tool v1. DO NOT EDIT.\nx = 1\n", "r", 1)]
    df = spark.createDataFrame(rows, "node_id string, file string, code string, project string, size int")
    got = {r.node_id: set(r.classes) for r in G.classify(df, "node_id", "file", "code", "project").collect()}
    assert got["gen"] == {"generated"} and got["hand"] == set() and got["vend"] == {"vendored"} and got["billing"] == set()
    assert "minified" in got["min"] and "data" in got["blob"]
    assert all("vendored" in got[f"copy{i}"] for i in range(8))
    assert "none" not in got and "empty" not in got
    assert G.classify(df.where("false"), "node_id", "file", "code", "project").count() == 0


def test_notices_below_a_long_header_are_seen():
    licence = "".join(f" * Clause {i} of the licence, at some length so that the header is long enough.\n" for i in range(60))
    assert G.TOOL_NOTICE.search(G.leading("/*\n" + licence + " */\n\n// Code generated by tool v1. DO NOT EDIT.\nlet x = 1;\n"))
    deep = "import os\n" * 12 + "# do not modify the list while it is read\n"
    assert not G.TOOL_NOTICE.search(G.leading(deep))


def test_grammar_runs_until_no_pair_occurs_twice():
    # Prefixes of one run, each behind a symbol of its own: a round makes the rule one longer.
    sym = np.array([x for k in range(2, 61) for x in (100 + k, *range(1, k + 1))])
    _, left, _ = G.repair(sym, np.zeros(len(sym), int), 1)
    assert left[0] == 59 + 59 + 1


def files(n=60):
    rng = np.random.default_rng(1)
    gen = ["".join(f"_F{k}_{i} = _d.Field('name_{rng.integers(999)}', mod.Type{i}, size={rng.integers(99)}, label='x{i}')\n" for i in range(30)) for k in range(n)]
    shapes = ["x{} = {} + y{}\n", "if a{0} > {1}:\n    b{2}({1})\n", "for i{0} in c{2}:\n    d.e{0}(i{0}, {1})\n", "return f{0}[{1}:g{2}]\n", "h{0}({1}, j{2}, *k)\n", "with l{0}({2}) as m:\n    m.n{2} = {1}\n", "# remark {0} {1}\n", "assert o{0} == p{2}, q{1}\n"]
    hand = ["".join(shapes[int(k)].format(*rng.integers(99, size=3)) for k in rng.integers(0, len(shapes), 40)) for _ in range(n)]
    return gen, hand


def test_a_file_is_folded_in_a_batch_as_it_is_alone():
    gen, hand = files(8)
    texts = [*gen, *hand, "X = '" + "Qk3z8Lp0" * 40 + "'\n", "", "a"]
    batch = G.measures(texts)
    for i, t in enumerate(texts):
        alone = G.measures([t])
        assert all(alone[c][0] == batch[c][i] for c in batch), i


def test_the_grammar_finds_generated_files_without_any_notice():
    gen, hand = files()
    m = G.measures([*gen, *hand])
    rows = [{"phrases": [], "shared": 0.0, "tool": False, "vendor": False} | {c: m[c][i] for c in ("cover", "size", "tokens")} for i in range(len(gen) + len(hand))]
    model = G.decisions(rows)["generated"]
    x = G._dense({c: np.array([r[c] for r in rows], float) for c in G.INPUTS}, "tool")
    none = np.zeros(0, np.int64)
    found = model.logits(x, none, none) > model.cut
    assert found[: len(gen)].mean() >= 0.95 and found[len(gen) :].mean() <= 0.05


def test_rules_save_nothing_on_random_literals():
    rng = np.random.default_rng(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    blob = "".join(letters[int(k)] for k in rng.integers(0, 64, 4000)).encode()
    prose = ("the value is read from the table and the table is written to the disk again, " * 40).encode()
    left = G.left_of([blob, prose, b""])
    assert left[0] > 1 and left[1] < 0.5 and left[2] == 0
