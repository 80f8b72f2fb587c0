"""Scans, sinks and small gates on a few rows."""

import json
import os

from pyspark.sql import functions as F

from sievegrid.functions import gates as G
from sievegrid.functions import scoring as S
from sievegrid.operators import formats
from sievegrid.plans.nodes import control_end, edge_policy, invariant_failures
from sievegrid.sources import scans, sinks


def put(folder, **files):
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_folder_of_all_shapes(spark, tmp_path):
    put(tmp_path, a__json='[{"k": 1}, [{"k": 2}]]', b__json='{"deep": {"capability_injection": {"compiled_skills": [{"k": 3}]}}}', c__yaml="validated_nodes:\n- k: 4\nrejected_nodes:\n- k: 5\n", d__jsonl='{"k": 6}\n\nnot json\n{"k": 7}\n', e__json="{broken", x__rejected__yaml="- k: 9\n")
    os.rename(tmp_path / "x.rejected.yaml", tmp_path / "x.rejected.yaml")
    rows = scans.folder_records(spark, str(tmp_path)).collect()
    got = [(os.path.basename(r.path), r.kind, json.loads(r.record)["k"]) for r in rows if r.record]
    assert got == [("a.json", "plain", 1), ("a.json", "plain", 2), ("b.json", "skill", 3), ("c.yaml", "validated", 4), ("c.yaml", "rejected", 5), ("d.jsonl", "plain", 6), ("d.jsonl", "plain", 7)]
    assert [(os.path.basename(r.path), r.kind) for r in rows if r.error] == [("e.json", "broken")]


def test_block_items(spark, tmp_path):
    put(tmp_path, a__yaml="head: 1\nvalidated_nodes:\n- id: a\n  x: 1\n- id: b\nrejected_nodes:\n- id: c\n")
    got = sorted(r.item.strip() for r in scans.block_items(spark, f"{tmp_path}/*.yaml").collect())
    assert [g.split("\n")[0] for g in got] == ["id: a", "id: b"]


def test_discovery_and_links(spark, tmp_path):
    put(tmp_path, own__jsonl='{"_mode": "x"}\n', my_failure_matrix__jsonl='{"a": 1}\n', other__jsonl='{"a": 1}\n')
    got = {os.path.basename(r.path): r.stream for r in scans.discover(spark, str(tmp_path)).collect()}
    assert got == {"own.jsonl": "own", "my_failure_matrix.jsonl": "failure", "other.jsonl": "knowledge"}
    t = spark.createDataFrame([("see https://github.com/a/b.git and https://github.com/a/c.",), ("https://github.com/a/b",), (None,)], "t string")
    done = spark.createDataFrame([("https://github.com/a/c", "Completed")], "url string, status string")
    links = scans.link_manifest(t, "t", done)
    assert [(r.project, r.status) for r in links.collect()] == [("b", "Pending"), ("c", "Completed")]
    assert scans.pending(links).count() == 1


def test_landing_pad_chunks_and_mix(spark, tmp_path):
    for d, n in (("p1", 3), ("secret", 1)):
        (tmp_path / d).mkdir()
        for i in range(n):
            (tmp_path / d / f"f{i}.py").write_text("x = 1\n")
    got = {r.name: (r.files, r.bytes) for r in scans.landing_pad(spark, str(tmp_path), ["SECRET"]).collect()}
    assert got == {"p1": (3, 18)}
    assert scans.chunks(spark, str(tmp_path), 2).select("chunk").distinct().count() == 3
    a = spark.range(10).select("id")
    b = spark.range(100, 200).select("id", F.lit("x").alias("more"))
    assert sorted(r.id for r in scans.mixed_in(a, b, "id").collect())[-2:] == [100, 101]
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    assert scans.pages(f).where("text is not null").count() == 0 and sinks.file_manifest(f).where("not empty").count() == 4


def test_audits(spark):
    rows = spark.createDataFrame([("n", "b2", "x", "c", "r"), ("n", "b1", "x", "c", "r"), ("n", "b1", "x", "c", "r"), (None, "b", "x", "c", "r")], "frozen_node string, branch string, node string, cause string, recommendation string")
    got = scans.audits(rows).collect()
    assert len(got) == 1 and [a.branch for a in got[0].audits] == ["b1", "b2"]


def test_json_sinks(spark):
    df = spark.createDataFrame([('{"b": {"z": 1, "a": "é"}, "_x": 2}',), ("no json",), (None,)], "t string")
    assert [r.c for r in df.select(sinks.canonical_json(F.col("t")).alias("c")).collect()] == ['{"_x":2,"b":{"a":"\\u00e9","z":1}}', None, None]
    assert df.select(sinks.strip_keys(F.col("t"), ["z"], "_").alias("c")).first().c == '{"b":{"a":"\\u00e9"}}'
    a, b = (sinks.stable_hash(spark.createDataFrame([x], s)).first().stable_hash for x, s in (((1, None), "a int, b string"), ((None, 1), "b string, a int")))
    assert a == b


def test_bundles_and_manifests(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "p string, c string")
    d1, d2 = (sinks.bundle_hash(x, "p", "c").first() for x in (df, df.orderBy(F.desc("p"))))
    assert d1 == d2 and d1.files == 2 and len(d1.digest) == 16
    assert sinks.bundle_hash(df.where("false"), "p", "c").first().files == 0
    sinks.write_bundle(df, "p", "c", str(tmp_path / "bundle"))
    assert "### FILE: a" in "".join(r.value + "\n" for r in spark.read.text(str(tmp_path / "bundle")).collect())
    m = sinks.run_manifest({"scan": True, "write": True}, {"out": (2, d1.digest)})
    sinks.write_json_atomically(spark, m, str(tmp_path / "m.json"))
    sinks.write_json_atomically(spark, m, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text())["passed"] is True and not (tmp_path / "m.json.tmp").exists()
    sinks.write_dossier(df.withColumn("why", F.when(F.col("p") == "a", "bad")), "why", str(tmp_path / "dossier"))
    assert spark.read.text(str(tmp_path / "dossier/rejected_nodes.yaml")).first().value.startswith("- {")
    sinks.write_telemetry(df, df.agg(F.count("*").alias("n")), str(tmp_path / "tele"))
    got = sinks.artifact_contract(spark, str(tmp_path / "tele"), 3).first()
    assert (got.lines, got.broken, got.passed) == (3, 0, True)
    s = sinks.sealed(spark.createDataFrame([("n", ["a", "b"], ["x"]), ("m", None, None)], "k string, o array<string>, d array<string>"), "k", "o", "d")
    assert {r.k: r.complexity for r in s.collect()} == {"n": 1.5, "m": 0.0}


def test_report(spark):
    df = spark.createDataFrame([(i, "m" if i % 2 else None, "t ``` t") for i in range(50)], "id int, g string, t string")
    r = sinks.report(df, "g", "id", "t")
    assert r.count("**") == 12 and "````" in r and "(none)" in r


def test_gates(spark):
    leak = one(spark, G.hidden_key(F.lit("the task_scope says")))
    assert leak == "task_scope"
    js = lambda **k: F.lit(json.dumps(k))
    steps = ["the cause is here because one acts", "then two more follow from this step", "at last three ends it all now"]
    long = "because " + " ".join(f"w{i}" for i in range(45))
    assert one(spark, G.json_trace_reason(js(reasoning_trace=steps, final_answer=long))) == "pass"
    assert one(spark, G.json_trace_reason(F.lit("```json\n" + json.dumps({"reasoning_trace": steps[:2], "final_answer": long}) + "\n```"))) == "invalid_reasoning_length"
    assert one(spark, G.json_trace_reason(js(reasoning_trace="no", final_answer=long))) == "invalid_types"
    assert one(spark, G.json_trace_reason(js(reasoning_trace=["a < b " * 3] * 3, final_answer=long))) == "unsafe_characters"
    assert one(spark, G.json_trace_reason(js(reasoning_trace=[steps[0]] * 4, final_answer=long))) in ("low_reasoning_entropy", "duplicate_steps")
    b = {"condition": "c", "mechanism": "m", "failure_boundary": "f"}
    assert one(spark, G.json_branch_reason(js(baseline_state="s", synthesis="t", branches=[b, b]))) == "pass"
    assert one(spark, G.json_branch_reason(js(baseline_state="s", synthesis="t", branches=[b, b | {"failure_boundary": ""}]))) == "missing_failure_boundary"
    assert one(spark, G.json_branch_reason(js(error="cannot_generate"))) == "model_declined"
    assert one(spark, G.identity_function(F.lit("def f(x):\n    return x  # same\n"))) and one(spark, G.trivial_stub(F.lit("def f(x):\n    pass\n")))
    assert one(spark, G.triage(F.lit("QQX"))) == "ambiguous_needs_uncertainty_target" and one(spark, G.triage(F.lit("12 34"))) == "remove_low_value" and one(spark, G.triage(F.lit("UV"))) == "valid_reasoning"
    assert one(spark, G.failure_boundaries(F.lit("x\n  Failure boundary: it breaks \ny"))) == ["it breaks"]
    assert one(spark, G.final_answer(F.lit("<think>a</think> b"))) == "b"


def test_scores(spark):
    assert one(spark, S.cascade(F.lit(0.5), F.lit(2))) == 0.125 and one(spark, S.cascade(F.lit(0.5), F.lit(0))) == 0.5
    assert one(spark, S.constraint_route(F.lit(0.8), F.array(F.lit("error"), F.lit("warning")))) == 0.4
    assert one(spark, S.constraint_route(F.lit(0.8), F.array(F.lit("fatal")))) == 0.0
    assert one(spark, S.penalised(F.lit(0.3), F.lit(0.5))) == 0.2 and one(spark, S.penalised(F.lit(0.1), F.lit(0.5))) == 0.05
    v = [F.array(*[F.lit(float(x)) for x in a]) for a in ((1, 0, 0), (0, 1, 0), (0, 0, 0))]
    assert [one(spark, S.slr(v[0], x)) for x in v] == [0.0, 1.0, 0.0]
    m = F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))
    assert one(spark, S.ridge_slr(m, F.array(F.lit(0.0), F.lit(1.0)))) == 0.0
    code = 'def f(a: int) -> int:\n    """Doc."""\n    return a + 1\n'
    got = one(spark, S.code_measures(F.lit(code)))
    assert got[1] >= 3 and got[2] == 1.0 and got[3] == 1.0
    assert one(spark, S.code_measures(F.lit("def (")))[0] == 0.0
    fields = {"depth": F.lit(2), "kappa": F.lit(1.0)}
    assert one(spark, invariant_failures(["depth >= 2", "kappa == 1.0", "depth > 2", "nothing < 1", "?"], fields)) == ["depth > 2", "nothing < 1", "?"]
    p = edge_policy(F.lit("domain_bridge"), control_end(F.lit("Lens:x")), F.lit(True), F.lit(True), F.lit(0.9))
    assert one(spark, p).startswith("reject")


def test_veteran_route(spark):
    parts = {k: F.lit(None).cast("string") for k in ("traceback", "diff", "attempt", "analysis", "resolved", "theory", "implementation", "name", "code", "chunk")}
    r = one(spark, formats.route(parts | {"traceback": F.lit("boom"), "diff": F.lit("- a")}))
    assert r.mode == "veteran" and "boom" in r.messages[0].content and r.messages[1].train_loss
    assert one(spark, formats.route(parts)) is None
