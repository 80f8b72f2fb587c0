"""Slices, SQL lineage, reasoning vectors and the cache on small texts."""

from pyspark.sql import functions as F

from sievegrid.operators import lineage as L


def test_slices_of_brace_languages(spark):
    js = "// class Not {\nclass A extends B {\n  run(x) {\n    if (x) { go(x); }\n    return `}`;\n  }\n}\nconst f = async (a) => {\n  await g(a);\n};\nexport function h() { return f(1); }\n"
    rs = "impl Thing {\n    fn new(x: i32) -> Self {\n        make(x)\n    }\n}\n"
    df = spark.createDataFrame([("js", js), ("rs", rs), ("none", None), ("empty", "")], "k string, c string")
    got = {(r.key, r.name): r for r in L.polyglot_slices(df, "k", "c").collect()}
    assert set(got) == {("js", "A"), ("js", "run"), ("js", "f"), ("js", "h"), ("rs", "Thing"), ("rs", "new")}
    assert (got["js", "A"].first, got["js", "A"].last) == (2, 7) and got["js", "run"].calls == ["go"]
    assert got["js", "h"].calls == ["f"] and got["rs", "new"].calls == ["make"] and got["js", "A"].kind == "class"


def test_sql_lineage(spark):
    q = "WITH t AS (SELECT a FROM raw.events), u AS (SELECT 1) SELECT DISTINCT t.a, b AS c, max(d) FROM t JOIN dim USING (a) -- from x\n"
    df = spark.createDataFrame([(q,), ("INSERT INTO out SELECT x FROM src",), (None,)], "q string")
    got = df.select(L.sql_tables(F.col("q")).alias("t"), L.sql_columns(F.regexp_extract("q", "(?s)(SELECT DISTINCT.*|SELECT x.*)", 1)).alias("c")).collect()
    assert got[0].t == ["dim", "raw.events"] and got[0].c == ["a", "b"]
    assert got[1].t == ["out", "src"] and got[1].c == ["x"] and got[2].t is None


def test_reasoning_vectors(spark):
    code = '"""Say it."""\nimport os\n\n\nasync def f(x):\n    assert x > 0\n    try:\n        return x\n    except (ValueError, KeyError):\n        pass\n'
    got = {r.key: r for r in L.reasoning_vectors(spark.createDataFrame([("a", code), ("b", "def ("), ("c", None)], "k string, c string"), "k", "c").collect()}
    a = got["a"]
    assert (a.intent, a.strategy, a.constraints, a.failure_modes) == ("Say it.", "asynchronous", ["x > 0"], ["KeyError", "ValueError"])
    assert got["b"].intent == "unknown" and got["c"].execution_pattern == []


def test_policies(spark):
    df = spark.createDataFrame([("a", '{"theory": "t", "implementation": "i"}'), ("b", '{"policy": {"description": "d", "rules": ["r"]}}'), ("c", '{"x": 1}')], "path string, record string")
    got = {r.path: (r.theory, r.implementation) for r in L.policy_payloads(df).collect()}
    assert got == {"a": ("t", "i"), "b": ("d", '["r"]')}


def test_cache_computes_new_contents_only(spark, tmp_path):
    asked = []

    def compute(new):
        asked.append(new.count())
        return new.select("hash", F.length("content").alias("n"))

    to = str(tmp_path / "cache")
    df = spark.createDataFrame([("x",), ("xy",), ("x",), (None,)], "c string")
    assert L.cached(df, "c", compute, to).count() == 2
    assert L.cached(df.unionByName(spark.createDataFrame([("new",)], "c string")), "c", compute, to).count() == 3
    assert asked == [2, 1]


def test_passed(spark):
    assert L.passed(spark.createDataFrame([(True,)], "passed boolean")) and not L.passed(spark.createDataFrame([(None,)], "passed boolean"))
