"""Operators of the further queries on the cases their docstrings define."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweir.functions import text as T
from codeweir.functions import typed
from codeweir.operators import evaluate, search, store, verify
from codeweir.sources import context, readers, table

NUMBER = {"type": "number", "value": 1}


def test_typed_issues():
    deep = {"type": "map", "value": {"a": {"type": "list", "value": [NUMBER, {"type": "null", "value": None}]}}}
    assert typed.typed_issues(deep) == []
    deep["value"]["a"]["value"].append({"type": "number", "value": float("nan")})
    assert typed.typed_issues(deep) == ["value.a[2]: not a finite number"]
    assert typed.typed_issues({"type": "number", "value": "NaN"}, special=True) == [] and typed.typed_issues({"type": "number", "value": True})
    assert typed.typed_issues({"type": "map", "value": {"": NUMBER}}) == ["value: empty key"] and typed.typed_issues(3) == ["value: no tagged value"]
    assert typed.typed_issues({"type": "date", "value": 1}) == ["value: unknown type"]


def test_tagged_and_normal():
    assert typed.tagged({"a": [1, None, True, "x", NUMBER]}) == {"type": "map", "value": {"a": {"type": "list", "value": [NUMBER, {"type": "null", "value": None}, {"type": "boolean", "value": True}, {"type": "string", "value": "x"}, NUMBER]}}}
    assert typed.normal([1, 2, 3], longest=2)["value"][-1]["value"] == "<1 more items truncated>"
    value = x = []
    for _ in range(20):
        x.append([])
        x = x[0]
    assert "truncated at depth 12" in json.dumps(typed.normal(value))
    value.append(value)
    with pytest.raises(ValueError):
        typed.normal(value)


def test_side_results_keep_good_rows(spark):
    rows = [{"caseId": "a", "outcome": "return", "returnValue": NUMBER, "more": 1}, {"caseId": " "}, 3, {"caseId": "b", "outcome": "return", "returnValue": {"type": "x"}}, {"caseId": "c", "outcome": "exception", "exceptionType": "E"}, {"caseId": "d", "outcome": "exception"}, {"caseId": "e", "outcome": "?"}]
    results, issues = typed.side_results(json.dumps({"results": rows}))
    assert [r["case_id"] for r in results] == ["a", "c"] and len(issues) == 5
    df = spark.createDataFrame([(json.dumps({"results": rows}),), ("x",), (None,), ("[]",)], "t string")
    assert [(len(r.p.results), len(r.p.issues)) for r in df.select(typed.parse_side("t").alias("p")).collect()] == [(2, 5), (0, 1), (0, 1), (0, 1)]


def test_description_and_report_issues():
    good = {"schemaVersion": "1.0", "target": {"language": "Java", "className": "A", "method": "f", "isStatic": True, "constructorArgs": []}, "cases": [{"id": "1", "inputs": [NUMBER], "expected": {"kind": "return", "value": NUMBER}}, {"id": "2", "inputs": [], "expected": {"kind": "exception", "type": "E"}}]}
    assert typed.description_issues(good) == [] and typed.description_issues([]) == ["no object"]
    bad = {**good, "target": {"language": "Go", "className": " "}, "cases": [{"id": "", "inputs": [1], "expected": {}}]}
    assert len(typed.description_issues(bad)) == 8
    report = {"schemaVersion": "1.0", "applicability": {"level": "adapt", "confidence": 0.5, "reasons": ["r"]}, "behaviorMapping": [{"requirement": "r", "status": "missing", "candidateEvidence": [], "targetAction": "t"}], "contractMapping": [], "dependencyPlan": [{"sourceDependency": "d", "action": "inline"}], "implementationPlan": ["p"], "risks": [], "assumptions": [], "unresolved": []}
    assert typed.report_issues(typed.object_answer("Here:\n```json\n" + json.dumps(report) + "\n```")) == []
    report["applicability"]["confidence"], report["behaviorMapping"][0]["status"], report["implementationPlan"] = 1.5, "covered", []
    assert typed.report_issues(report) == ["applicability.confidence: invalid", "behaviorMapping[0].candidateEvidence: invalid", "implementationPlan: invalid"]
    assert typed.object_answer("no") is None


def test_runs_without_results(spark):
    cases = spark.createDataFrame([(r, c, i) for r in "xyz" for i, c in enumerate("ba")], "run string, case_id string, seq int")
    schema = "run string, case_id string, outcome string, value double, exception string"
    source = spark.createDataFrame([("x", "a", "return", 1.0, None), ("x", "b", "return", 1.0, None), ("x", "extra", "return", 1.0, None), ("y", "a", "return", 1.0, None)], schema)
    target = spark.createDataFrame([("x", "a", "return", 1.0, None), ("x", "b", "return", 2.0, None)], schema)
    got = {(r["run"], r["case_id"]): (r["verdict"], r["detail"], r["place"]) for r in verify.verify_runs(cases, source, target).collect()}
    assert got[("x", "b")] == ("fail", "values differ", 1) and got[("x", "a")] == ("pass", "", 2) and got[("x", "extra")] == ("divergent", "missing in target", 3)
    assert got[("y", "b")] == ("divergent", "no results of the target.", 1) and got[("z", "a")][1] == "no results of the source. no results of the target." and len(got) == 7


def test_class_recall(spark):
    answers = spark.createDataFrame([("t", "A", "1"), ("t", "B", "2"), ("u", "A", "3"), ("u", "B", "4")], "task string, source string, id string")
    ranking = spark.createDataFrame([("t", "1", 1), ("t", "2", 9), ("u", "9", 1)], "task string, id string, place int")
    assert evaluate.class_recall(ranking, answers, 2).first().asDict() == {"tasks": 2, "wide_recall": 50.0, "top_recall": 25.0, "wide_completion": 50.0, "top_completion": 50.0}
    symbols = spark.createDataFrame([("n", "A", "2"), ("n", "A", "1"), ("n", "B", "5"), ("m", "A", "7")], "title string, source string, id string")
    targets = spark.createDataFrame([("t", "n"), ("u", "m")], "task string, title string")
    whole = evaluate.complete_answers(targets, evaluate.answers_by_source(symbols, ["A", "B"]), ["A", "B"])
    assert sorted(map(tuple, whole.collect())) == [("t", "A", "1"), ("t", "B", "5")]


def test_blockers_and_status(spark):
    plan = spark.createDataFrame([("a", "x", None, "unresolved"), ("a", "y", " ", "adapt"), ("a", "z", "t", "adapt"), ("b", "x", "t", "inline")], "id string, dependency string, target string, action string")
    assert [tuple(r) for r in verify.dependency_blockers(plan).collect()] == [("a", ["x", "y"])]
    declared = spark.createDataFrame([("C", "1"), ("C", "2"), ("D", "3")], "class string, test string")
    results = spark.createDataFrame([("1", "pass"), ("3", "pass")], "test string, status string")
    tests = verify.with_status(declared, results)
    assert {r["test"]: r["status"] for r in tests.collect()} == {"1": "pass", "2": "unverified", "3": "pass"}
    assert verify.class_rate(tests, 4).first().asDict() == {"classes": 2, "passed": 1, "rate": 0.25}
    assert verify.class_rate(tests.limit(0)).first()["rate"] == 0


def test_union_last(spark):
    a = spark.createDataFrame([("k", "old", 1), ("l", "x", 2)], "id string, v string, n int")
    b = spark.createDataFrame([("k", "new", 1)], "id string, v string, n int")
    assert {r["id"]: (r["v"], r["first"]["root"]) for r in store.union_last([a, b], "id", "n").collect()} == {"k": ("new", 0), "l": ("x", 0)}


def test_fnv1a_counts_utf16_units(spark):
    def plain(t):
        h = 2166136261
        for unit in np.frombuffer(t.encode("utf-16-le"), np.uint16).tolist():
            h = (h ^ unit) * 16777619 & 0xFFFFFFFF
        return h

    words = ["w:a", "𝛴🛰x", "日本", "é"]
    got = spark.createDataFrame([(w,) for w in words], "t string").select("t", T.fnv1a(F.col("t")).alias("h")).collect()
    assert {r["t"]: r["h"] for r in got} == {w: plain(w) for w in words}


def test_embed_checks_answers(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(5)] + [(9, None)], "id long, t string")
    assert search.embed(df, "id", "t", lambda texts: [(i, [float(len(t)), 0.0]) for i, t in reversed(list(enumerate(texts)))], 2, size=2).count() == 6
    for wrong in (lambda texts: [(0, [1.0, 2.0])] * len(texts), lambda texts: [(i, [1.0]) for i in range(len(texts))], lambda texts: [(i, [1.0, float("nan")]) for i in range(len(texts))]):
        with pytest.raises(ValueError):
            search._answered(wrong, ["a", "b"], 2, 1, 0)
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return [(0, [1.0])]

    assert search._answered(flaky, ["a"], 1, 3, 0) == [[1.0]] and len(calls) == 3


JAVA = """package a.b;
import java.util.List;

public class Tank {
    private final List<String> parts;
    // REQ: parts stay in order

    public Tank(List<String> parts) {
        this.parts = parts;
    }

    /** Adds. */
    @Override
    public int add(int x) {
        throw new UnsupportedOperationException();
    }

    int size() { return parts.size(); }
}
"""


def test_context_and_patch():
    c = context.context(JAVA, 12, "Java")
    assert (c["name"], c["holder"], c["space"], c["status"]) == ("add", "Tank", "a.b", "unimplemented")
    assert c["imports"] == ["import java.util.List;"] and c["fields"] == ["private final List<String> parts;"] and c["constraints"] == ["parts stay in order"]
    assert c["constructor"].startswith("public Tank(") and c["members"] == ["int size() { return parts.size(); }"]
    assert context.context(JAVA, 5, "Java") is None and context.context(None, 1, "Java") is None and context.context(JAVA, None, "Java") is None
    from codeweir.functions import values as V

    done = V.apply_hunks(JAVA, context.replacement(JAVA, 12, "int add(int x) {\n    return x;\n}", "Java", "function"))
    assert "    int add(int x) {\n        return x;\n    }\n\n    int size()" in done and "@Override" in done
    with pytest.raises(ValueError):
        context.replacement(JAVA, 12, "x", "Java", "class")
    assert context.selection(JAVA, 15, "java").name == "add" and context.selection(JAVA, 15, "cobol") is None
    python = "class A:\n    def __init__(self):\n        self.x = 1\n\n    def f(self):\n        pass\n"
    assert context.context(python, 5, "Python")["constructor"] == "def __init__(self):"


def test_nodes():
    got = [(n["name"], n["parent"], n["depth"], n["status"]) for n in context.nodes(JAVA, "Java")]
    assert got == [("Tank", None, 0, "implemented"), ("add", "Tank", 1, "unimplemented"), ("size", "Tank", 1, "implemented")] and context.nodes(None, "Java") == []


def test_fold_and_tagged_compare(spark):
    e = spark.createDataFrame([(1, "a", 1, "p"), (1, "b", 2, "q"), (2, "b", 3, "r"), (1, "?", 9, "z")], "k int, event_type string, seq int, payload string")
    effects = spark.createDataFrame([("a", "x", "one"), ("a", "y", "$"), ("b", "x", None)], "event_type string, field string, value string")
    assert {(r["k"], r["field"]): r["value"] for r in verify.fold_events(e, effects, "k").collect()} == {(1, "x"): None, (1, "y"): "p", (2, "x"): None}
    side = lambda v: spark.createDataFrame([(str(i), "return", x, None) for i, x in enumerate(v)], "case_id string, outcome string, value string, exception string")
    number = lambda x: json.dumps({"type": "list", "value": [{"type": "number", "value": x}]})
    got = verify.compare(side([number(1.0), number(1.0), "plain"]), side([number(1.01), number(2.0), "plain"]), tolerance=0.1)
    assert {r["case_id"]: r["verdict"] for r in got.collect()} == {"0": "pass", "1": "fail", "2": "pass"}


def test_callers(spark):
    r = spark.createDataFrame([(1, "r", "go", "a.py", 1)], "request_id long, repository string, name string, path string, line int")
    f = spark.createDataFrame([("r", "a.py", "def go():\n  go()\n  went()"), ("r", "b.py", "x\r\ngo(go(1))\ngo (2)\ngo(3)"), ("q", "a.py", "go()"), ("r", "c.py", None)], "repository string, path string, file_text string")
    assert [(x["path"], x["line"]) for x in store.callers(r, f).orderBy("place").collect()] == [("a.py", 2), ("b.py", 2), ("b.py", 3)]


def test_discover_and_tree(spark, tmp_path):
    for folder, name, repo in (("x", "manifest.json", "x"), ("x", "dataset-manifest.json", "no"), ("y", "dataset-manifest.json", "y"), ("z/deep", "manifest.json", "no")):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_text(json.dumps({"repository": repo, "language": "Go", "retrievalClassAliases": {"A": "b"}}))
    assert sorted(r["repository"] for r in readers.discover(spark, str(tmp_path)).collect()) == ["x", "y"]
    (tmp_path / "manifest.json").write_text('{"repository": "root"}')
    assert [r["repository"] for r in readers.discover(spark, str(tmp_path)).collect()] == ["root"]
    (tmp_path / "empty").mkdir()
    assert readers.discover(spark, str(tmp_path / "empty")).count() == 0
    for p in ("src/a.go", "node_modules/b.ts", "src/.git/c.py", "src/d.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    assert [r["path"] for r in readers.source_tree(spark, str(tmp_path)).collect()] == ["src/a.go"]


def test_json_lines_name_the_line(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"id": "1", "kind": "class"}\n\n{"id": "2", "kind": "other"}\nnot json\n{"id": "3", "kind": "function"}\n')
    good, bad = readers.json_lines(spark, str(tmp_path / "d.jsonl"))
    assert sorted(r["id"] for r in good.collect()) == ["1", "3"] and sorted(r["line"] for r in bad.collect()) == [3, 4]


def test_stored_table(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id string, embedding array<float>"
    table.initialise(spark, path, schema)
    batch = spark.createDataFrame([("a", [1.0, 2.0], 1), ("a", [3.0, 4.0], 2), ("b", [5.0, 6.0], 3)], f"{schema}, _seq int")
    table.upsert_into(spark, path, batch, 2)
    table.initialise(spark, path, schema)
    with pytest.raises(ValueError):
        table.upsert_into(spark, path, spark.createDataFrame([("c", [1.0, 2.0], 1), ("d", [1.0], 2)], f"{schema}, _seq int"), 2)
    assert {r["id"]: r["embedding"] for r in spark.read.parquet(path).collect()} == {"a": [3.0, 4.0], "b": [5.0, 6.0]}
    table.clear(spark, path, schema)
    assert spark.read.parquet(path).count() == 0
