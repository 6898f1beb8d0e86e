import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweir.functions import text as T
from codeweir.operators import evaluate, search


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("parseHTTPServer", ["parse", "http", "server"]),
        ("payments", ["payments", "payment", "pay"]),
        ("gas boss moment comments", ["gas", "boss", "moment", "comments", "comment", "com"]),
        ("shipments are", ["shipments", "shipment", "ship", "are"]),
        ("ｗｉｄｅ Ⅳ", ["wide", "iv"]),
        ("", []),
        (None, []),
    ],
)
def test_search_tokens(spark, text, tokens):
    assert one(spark, text, T.search_tokens) == tokens


def fnv(word):
    h = 0x811C9DC5
    for c in word:
        h = ((h ^ ord(c)) * 0x01000193) % 2**32
    return h


def test_fnv_and_features(spark):
    for w in ("w:a", "g:é한あ", "w:parse"):
        assert one(spark, w, T.fnv1a) == fnv(w)
    assert one(spark, "Ab abcd", T.features) == ["w:ab", "w:abcd", "g:abc", "g:bcd"]


def test_overlap(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c", "d"]), ([], ["a"])], "a array<string>, b array<string>")
    r = [x["o"] for x in df.select(T.overlap(F.col("a"), F.col("b")).alias("o")).collect()]
    assert r == [pytest.approx(1 / math.sqrt(6)), 0.0]


def test_recall_depth_and_scopes(spark):
    df = spark.createDataFrame([(1,), (20,), (50,)], "k int")
    assert [r[0] for r in df.select(search.recall_depth(F.col("k"))).collect()] == [50, 100, 250]
    assert one(spark, "x", lambda c: search.scopes(F.array(F.lit("repo: a/b "), F.lit("a"), F.lit("a/*")))) == ["a/b"]


def test_fusion_counts_repeats_once_and_keeps_one_sided_hits(spark):
    rows = [(1, "semantic", "x", 0.9, None), (1, "semantic", "x", 0.9, None), (1, "semantic", "y", None, None), (1, "text", "y", None, 0.4), (1, "text", "z", None, 0.2)]
    hits = spark.createDataFrame(rows, "request_id long, channel string, id string, semantic_score double, text_score double")
    got = {r["id"]: r["hybrid"] for r in search.fuse(search.channel_ranks(hits)).collect()}
    assert got == {"x": pytest.approx(0.65 / 61), "y": pytest.approx(0.65 / 62 + 0.35 / 61), "z": pytest.approx(0.35 / 62)}


def test_vector_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, [0.0] * 8)], "id long, v array<double>")
    got = search.vector_topk(df.where("id < 5").withColumnRenamed("id", "qid"), df, k=4, block=16).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(np.maximum(0, u[:5] @ u.T), 6)
    for q in range(5):
        want = sorted(range(60), key=lambda i: (-s[q, i], i))[:4]
        assert [r["id"] for r in sorted((r for r in got if r["qid"] == q), key=lambda r: r["place"])] == want


def test_metrics(spark):
    rank = spark.createDataFrame([("a", "x", 1), ("a", "u", 2), ("b", "x", 1)], "task string, id string, place int")
    judged = spark.createDataFrame([("a", "x", 3), ("a", "y", 2), ("c", "z", 3)], "task string, id string, grade int")
    m = {r["task"]: r for r in evaluate.metrics(rank, judged).collect()}
    ideal = 7 + 3 / math.log2(3)
    assert m["a"]["precision"] == 0.5 and m["a"]["recall"] == 0.5 and m["a"]["ndcg"] == pytest.approx(7 / ideal) and m["a"]["mrr"] == 1
    assert m["b"]["precision"] == 0 and m["b"]["ndcg"] == 0 and m["c"]["recall"] == 0 and m["c"]["precision"] == 0


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "'Java' code_language", "'class' kind", "'r' repository").write.parquet(path)
    plan = search.filtered(spark.read.parquet(path), languages=["Java", "Go"], kinds=["class"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(code_language" in plan


def test_fuzzy_judgments(spark):
    r = spark.createDataFrame([("t", "fixture/a", "Big.Reader", 1), ("t", "a", "Writer", 2), ("t", "b", "Reader", 3)], "task string, repository string, symbol string, place int")
    j = spark.createDataFrame([("t", "a", "Reader", 2, 1), ("t", "a", "Big", 3, 2), ("t", "a", "Writer", 1, 3)], "task string, repository string, symbol string, grade int, seq int")
    assert [x["grade"] for x in evaluate.match_judgments(r, j).orderBy("place").collect()] == [2, 1, 0]


def test_incremental_index(spark, tmp_path):
    from codeweir.session import checkpoint_dir
    from codeweir.streaming import index

    checkpoint_dir(spark)
    schema = "id string, v int, indexed_at timestamp, ingest_batch int"
    at = lambda n: f"timestamp'2024-01-0{n} 00:00:00'"
    for n, rows in ((1, f"values ('a', 1, {at(2)}, 1), ('b', 1, {at(2)}, 1)"), (2, f"values ('a', 2, {at(3)}, 2), ('b', 0, {at(1)}, 2), ('c', 5, {at(3)}, 2)")):
        spark.sql(f"select * from {rows} t(id, v, indexed_at, ingest_batch)").write.mode("append").parquet(str(tmp_path / "in"))
        index.start(spark, str(tmp_path / "in"), schema, str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
    assert {r["id"]: r["v"] for r in spark.read.parquet(str(tmp_path / "table")).collect()} == {"a": 2, "b": 1, "c": 5}


def test_text_search_reads_every_field(spark, tmp_path):
    from codeweir.plans import queries as core

    own = "id string, title string, repository string, path string, signature string, summary string, content string, preview string, dependencies array<string>, indexed_at timestamp, ingest_batch int"
    empty = {"title": "t", "repository": "r", "path": "p", "signature": "s", "summary": None, "content": None, "preview": "v", "dependencies": None}
    said = {"repository": "xrepo", "path": "xpath", "content": "xbody", "preview": "xview", "dependencies": ["xlib"], "summary": "xsum"}
    rows = [tuple([k, *{**empty, k: v}.values(), None, 1]) for k, v in said.items()]
    spark.createDataFrame(rows, own).write.parquet(f"{tmp_path}/code_symbols.parquet")
    words = ["xrepo", "xpath", "xbody", "xview", "xlib", "xsum"]
    target = "struct<name:string,signature:string,documentation:string,kind:string,code_language:string,path:string>"
    ask = [(i, tuple(w if j == i else "none" for j in range(6)), "none") for i, w in enumerate(words)]
    spark.createDataFrame(ask, f"request_id long, target_symbol {target}, requirement string").write.parquet(f"{tmp_path}/search_requests.parquet")
    got = {r["qid"]: r["id"] for r in core.text_topk_bm25(spark, str(tmp_path)).collect()}
    assert got == {0: "repository", 1: "path", 2: "content", 3: "preview", 4: "dependencies", 5: "summary"}


@pytest.mark.parametrize("block", [3, 4096])
def test_bm25_in_blocks_against_all_pairs(spark, block):
    rng = np.random.default_rng(3)
    texts = {f"d{i:02}": sorted({f"w{j}" for j in rng.integers(0, 12, 4)}) for i in range(40)} | {"empty": []}
    asked = {i: sorted({f"w{j}" for j in rng.integers(0, 14, 3)}) for i in range(7)}
    n, avg = len(texts), sum(map(len, texts.values())) / len(texts)
    df = {w: sum(w in t for t in texts.values()) for t in texts.values() for w in t}
    want = set()
    for q, ws in asked.items():
        score = {d: round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(t) / avg)) for w in ws if w in t), 6) for d, t in texts.items() if set(ws) & set(t)}
        want |= {(q, d, p + 1) for p, d in enumerate(sorted(score, key=lambda d: (-score[d], d))[:5])}
    frames = spark.createDataFrame(list(asked.items()), "qid long, tokens array<string>"), spark.createDataFrame(list(texts.items()), "id string, tokens array<string>")
    assert {(r["qid"], r["id"], r["place"]) for r in search.bm25(*frames, k=5, block=block).collect()} == want
