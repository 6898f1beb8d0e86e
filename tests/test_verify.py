import json

import pytest
from pyspark.sql import functions as F

from codeweir.functions import values as V
from codeweir.operators import store, verify
from codeweir.sources import extract, readers


def test_compare_and_golden(spark):
    schema = "case_id string, outcome string, value double, exception string"
    s = spark.createDataFrame([("a", "return", 1.0, None), ("b", "return", 1.0, None), ("c", "exception", None, "java.lang.NullPointerException"), ("d", "return", 2.0, None), ("e", "return", float("nan"), None)], schema)
    t = spark.createDataFrame([("a", "return", 1.05, None), ("b", "exception", None, "X"), ("c", "exception", None, "NullReferenceException"), ("f", "return", 1.0, None), ("e", "return", float("nan"), None)], schema)
    report = verify.compare(s, t, tolerance=0.1)
    assert {r["case_id"]: r["verdict"] for r in report.collect()} == {"a": "pass", "b": "divergent", "c": "pass", "d": "divergent", "e": "pass", "f": "divergent"}
    golden = spark.createDataFrame([("a", 5.0), ("e", float("nan"))], "case_id string, expected double")
    g = {r["case_id"]: (r["verdict"], r["requirement_verdict"]) for r in verify.against_golden(report, golden).collect()}
    assert g["a"] == ("fail", "neither") and g["e"] == ("pass", "both-conform") and g["c"] == ("pass", None)
    assert verify.pass_rate(report.limit(0)).first()["pass_rate"] == 0


def test_typed_values():
    n = lambda x: {"type": "number", "value": x}
    assert V.equal_values(n("NaN"), n("NaN")) and not V.equal_values(n(1), {"type": "string", "value": "1"})
    assert V.equal_values({"type": "list", "value": [n(1.0)]}, {"type": "list", "value": [n(1.01)]}, relative=0.02)
    assert not V.equal_values({"type": "map", "value": {"a": n(1)}}, {"type": "map", "value": {"b": n(1)}})
    assert V.equal_values({"type": "string", "value": "A"}, {"type": "string", "value": "a"}, fold_case=True)


def test_patches():
    line = lambda k, c: {"type": k, "content": c}
    h = [{"header": "@@", "lines": [line("context", "b"), line("remove", "c"), line("add", "C")]}]
    assert V.apply_hunks("a\r\nb\r\nc\r\nd", h) == "a\nb\nC\nd"
    with pytest.raises(ValueError):
        V.apply_hunks("a", h)
    with pytest.raises(ValueError):
        V.apply_hunks("a", [{"header": "@@", "lines": [line("add", "x")]}])
    assert V.new_file([{"header": "@@", "lines": [line("add", "x"), line("add", "y")]}]) == "x\ny"


def test_ranking_answers():
    item = '[{"id": "C1", "score": 1.7}, {"id": "", "score": 1}, {"id": "C2", "score": true}]'
    want = [{"id": "C1", "score": 1.0, "reason": "rank 1"}]
    assert V.ranked_answer(item) == want and V.ranked_answer(f"so:\n```json\n{item}\n```") == want and V.ranked_answer(f"x {item} y") == want
    assert V.ranked_answer('[{id: "C1", score: 0.5, reason: "r"}]') == [{"id": "C1", "score": 0.5, "reason": "r"}]
    assert V.ranked_answer("[]") is None and V.ranked_answer(None) is None


def test_vector_codec():
    assert V.vector_hex([1.0]) == "0000803f" and V.hex_vector("0000803f0000c0bf") == [1.0, -1.5]


def test_gate(spark):
    runs = spark.createDataFrame([(1,), (2,), (3,)], "run int")
    rec = spark.createDataFrame([(1, True, "fail"), (2, True, "pass"), (2, False, "fail")], "run int, required boolean, status string")
    assert {r["run"]: r["allowed"] for r in verify.gate(runs, rec).collect()} == {1: False, 2: True, 3: False}


def test_upsert(spark):
    t = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "id string, v int, _seq int").drop("_seq")
    b = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 3)], "id string, v int, _seq int")
    assert {tuple(r) for r in store.upsert(t, b).collect()} == {("a", 1), ("b", 4), ("c", 5)}


def test_extract_nested_types():
    java = "public class A\n{\n    // Adds both numbers up.\n    // @param x one\n\n    int add(int x, int y) {\n        if (x > 1) { call(y); }\n        return x;\n    }\n    class B {\n        B() { }\n        void run() { }\n    }\n    void last() { }\n}\n"
    found = extract.extract(java, "Java")
    assert [(f.kind, f.name, f.line) for f in found] == [("class", "A", 1), ("function", "add", 6), ("class", "B", 10), ("function", "run", 12), ("function", "last", 14)]
    assert found[1].summary == "Adds both numbers up." and found[0].summary.startswith("Type A: ")


@pytest.mark.parametrize(
    "language, code, names",
    [
        ("Python", "class P:\n    def f(self):\n        return 1\n\ndef g():\n    \'\'\'\ndef no(): pass\n\'\'\'\n", ["P", "f", "g"]),
        ("TypeScript", "export abstract class K<T> {\n  constructor(a: T) {}\n  get size(): number { return f(1); }\n  run<U>(u: U) {\n    if (u) {}\n  }\n}\nexport default async function* walk() {}\n", ["K", "size", "run", "walk"]),
        ("C#", "[Serializable]\npublic sealed class C\n{\n  public C(int a) {}\n  public Dictionary<string, int[]>? Map(int a) => null;\n  public delegate bool Test<T>(T x);\n  record struct R(int A);\n}\n", ["C", "Map", "Test", "R"]),
        ("Rust", "pub(crate) struct S {\n}\nimpl S {\n  #[inline]\n  pub async fn go(&self) {}\n}\ntrait T { }\n", ["S", "go", "T"]),
        ("Go", "type A struct {\n}\ntype B = int\nfunc (a *A) Run(x int) {}\nfunc main() {}\n", ["A", "Run", "main"]),
        ("Java", "/* class No { */ class Yes { String s = \"class No {\"; @Override public <T> List<T> all(T t) { return new X(t); } }", ["Yes"]),
        ("Java", "class Y {\n  @A(x = \"(\") public <T> java.util.List<T>[] all(T t) {\n    return go(t);\n  }\n", ["Y", "all"]),
    ],
)
def test_extract_languages(language, code, names):
    assert [f.name for f in extract.extract(code.replace("\n", "\r\n"), language)] == names


def test_documents(spark):
    f = spark.createDataFrame([("fixture/r", "a/X.java", "class X { }"), ("fixture/r", "b.go", "func f() {}"), ("fixture/q", "c.py", None)], "repository string, path string, file_text string")
    m = spark.createDataFrame([("r", "Java", None, None, True, {"X": "the alias"}), ("q", "Python", "MIT", ["d"], None, None)], "repository string, code_language string, license string, dependencies array<string>, synthetic boolean, retrieval_class_aliases map<string,string>")
    got = extract.documents(f, m).collect()
    assert [(r["id"], r["title"], r["license"], r["dependencies"], r["risks"]) for r in got] == [("r:a/X.java:1:X", "the alias", "Unknown", [], ["Synthetic evaluation fixture"])]
    assert extract.documents(f.limit(0), m).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text(json.dumps({"id": "1", "kind": "class"}) + "\n\nnot json\n" + json.dumps({"id": "2", "kind": "other"}) + "\n")
    good, bad = readers.json_lines(spark, str(tmp_path / "d.jsonl"))
    assert [r["id"] for r in good.collect()] == ["1"] and bad.count() == 2
    (tmp_path / "r.xml").write_text('<testsuite><testcase name="a" classname="C"/><testcase name="b" classname="C"><failure>x</failure></testcase></testsuite>')
    assert {(r["name"], r["status"]) for r in readers.junit(spark, str(tmp_path / "r.xml")).collect()} == {("a", "pass"), ("b", "fail")}
    (tmp_path / "s.txt").write_text("Tests run: 4, Failures: 1, Errors: 0, Skipped: 1\n")
    assert readers.surefire_totals(spark, str(tmp_path / "s.txt")).first()["passed"] == 2


def test_paths(spark):
    df = spark.createDataFrame([("src/test/A.java",), ("src/a_test.go",), ("src/contest/A.java",)], "p string")
    assert [r[0] for r in df.select(store.is_test_path(F.col("p"))).collect()] == [True, True, False]


def test_budget():
    s = {"target": "t" * 100, "callers": "c" * 1000, "fields": "f" * 300}
    cut = V.within_budget(s, 600)
    assert sum(map(len, cut.values())) <= 600 and set(cut) == set(s)
    assert set(V.within_budget(s, 300)) == {"target", "fields"} and V.within_budget(s, 50) == {"target": "t" * 100}


def test_batches_do_not_depend_on_partitions(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("t"))
    want = None
    for partitions, advisory in ((4, "64m"), (200, "2k"), (64, "20k")):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        got = sorted(map(tuple, store.batches(df, "k", F.col("t")).collect()))
        want = want or got
        assert got == want and len(got) == 157
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")
