"""Registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweir.functions import text as T
from codeweir.functions import values as V
from codeweir.operators import evaluate, search, store, verify
from codeweir.sources import extract

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _symbols(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The current symbols, with these columns: only they are read and shuffled."""
    log = table(spark, sf, "code_symbols")
    return store.current(log.select("id", *columns, "indexed_at", "ingest_batch"))


_TEXT_COLUMNS = ("title", "repository", "path", "signature", "summary", "content", "preview", "dependencies")


# SQL of the token expressions
def _forms(w: str) -> str:
    base = f"(CASE WHEN length({w}) > 4 AND suffix({w}, 's') THEN left({w}, length({w}) - 1) ELSE {w} END)"
    return f"[{w}, {base}, (CASE WHEN length({base}) > 6 AND suffix({base}, 'ment') THEN left({base}, length({base}) - 4) ELSE {base} END)]"


def _words(e: str, split: bool = True) -> str:
    if split:
        e = rf"regexp_replace(regexp_replace({e}, '([\p{{Ll}}\d])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}}+)(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')"
    return rf"regexp_extract_all(lower({e}), '[\p{{L}}\p{{N}}_]+')"


def _tokens(e: str) -> str:
    return f"list_distinct(flatten(list_transform({_words(f'coalesce({e}, {chr(39) * 2})')}, lambda w: {_forms('w')})))"


def _overlap(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) * len({b}) > 0 THEN len(list_intersect({a}, {b})) / sqrt(len({a}) * len({b})) ELSE 0.0 END)"


_ONCE = "(SELECT * FROM code_symbols QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, ingest_batch DESC) = 1)"
_HITS = """(SELECT request_id, channel, id, max(CASE WHEN channel = 'semantic' THEN semantic_score ELSE text_score END) AS score FROM channel_results GROUP BY ALL)"""
_RANKS = f"(SELECT *, row_number() OVER (PARTITION BY request_id, channel ORDER BY score DESC NULLS LAST, id) AS place FROM {_HITS})"
_FUSED = f"""(SELECT request_id, id, max(CASE WHEN channel = 'semantic' THEN score END) AS semantic_score, max(CASE WHEN channel = 'text' THEN score END) AS text_score,
    sum(CASE WHEN channel = 'semantic' THEN 0.65::DOUBLE ELSE 0.35::DOUBLE END / (60 + place)) AS hybrid FROM {_RANKS} GROUP BY ALL)"""


@query(f"SELECT id, array_to_string(list_sort({_tokens("title || chr(10) || signature")}), ' ') AS tokens FROM {_ONCE}")
def search_tokens(spark, sf):
    tokens = T.search_tokens(F.concat_ws("\n", "title", "signature"))
    return _symbols(spark, sf, "title", "signature").select("id", F.array_join(F.array_sort(tokens), " ").alias("tokens"))


@query(f"""SELECT request_id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ' ') AS expanded
    FROM (SELECT request_id, flatten(list_transform({_words("target_symbol.name || chr(10) || coalesce(requirement, '')")}, lambda w: {_forms('w')})) AS t FROM search_requests)""")
def expanded_text(spark, sf):
    raw = F.concat_ws("\n", "target_symbol.name", F.coalesce("requirement", F.lit("")))
    return table(spark, sf, "search_requests").select("request_id", F.array_join(T.search_tokens(raw), " ").alias("expanded"))


@query(f"""WITH q AS (SELECT request_id, {_tokens("target_symbol.name || chr(10) || target_symbol.signature")} AS t FROM search_requests),
    d AS (SELECT id, {_tokens("title || chr(10) || signature")} AS t FROM {_ONCE}),
    s AS (SELECT request_id, id, round({_overlap("q.t", "d.t")}, 6) AS score FROM q, d),
    r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) AS place FROM s WHERE score > 0)
    SELECT request_id, id, score, place FROM r WHERE place <= 10""")
def overlap_topk(spark, sf):
    """Blocks of requests meet blocks of symbols; no row is made for a pair that is not kept."""
    line = lambda *c: T.search_tokens(F.concat_ws("\n", *c))
    q = table(spark, sf, "search_requests").select(F.col("request_id").alias("qid"), line("target_symbol.name", "target_symbol.signature").alias("tokens"))
    d = _symbols(spark, sf, "title", "signature").select("id", line("title", "signature").alias("tokens"))
    return search.overlap_best(q, d).withColumnRenamed("qid", "request_id")


_FEATURES = rf"""(SELECT request_id, unnest(flatten(list_transform({_words("coalesce(requirement, '')", False)},
    lambda w: list_concat(['w:' || w], CASE WHEN length(w) >= 3 THEN list_transform(range(1, length(w) - 1), lambda i: 'g:' || substring(w, CAST(i AS INT), 3)) ELSE [] END)))) AS feature FROM search_requests)"""
_FNV = "list_reduce(list_concat([2166136261::HUGEINT], list_transform(range(1, length(feature) + 1), lambda i: unicode(substring(feature, CAST(i AS INT), 1))::HUGEINT)), lambda h, x: (xor(h, x) * 16777619) % 4294967296)"


@query(f"SELECT request_id, feature, n, CAST({_FNV} AS BIGINT) AS hash FROM (SELECT request_id, feature, count(*) AS n FROM {_FEATURES} GROUP BY ALL)")
def fnv1a_features(spark, sf):
    f = table(spark, sf, "search_requests").select("request_id", F.explode(T.features(T.nfkc(F.coalesce("requirement", F.lit(""))))).alias("feature"))
    return f.groupBy("request_id", "feature").agg(F.count("*").alias("n")).withColumn("hash", T.fnv1a(F.col("feature")))


@query(f"""WITH h AS (SELECT request_id, CAST({_FNV} AS BIGINT) AS hash FROM {_FEATURES}),
    b AS (SELECT request_id, hash % 384 AS bucket, sum(CASE WHEN hash < 2147483648 THEN 1 ELSE -1 END) AS v FROM h GROUP BY ALL)
    SELECT request_id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY request_id)), 6) AS value FROM b WHERE v <> 0""")
def hash_embedding(spark, sf):
    """The sparse form of the hashed vector: its non-zero entries, of length 1 together."""
    f = table(spark, sf, "search_requests").select("request_id", F.explode(T.features(T.nfkc(F.coalesce("requirement", F.lit(""))))).alias("feature"))
    f = f.withColumn("hash", T.fnv1a(F.col("feature")))
    b = f.groupBy("request_id", (F.col("hash") % 384).alias("bucket")).agg(F.sum(F.when(F.col("hash") < 2147483648, 1).otherwise(-1)).alias("v")).where("v <> 0")
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("request_id")).cast("double"))
    return b.select("request_id", "bucket", F.round(F.col("v") / norm, 6).alias("value"))


@query(f"SELECT repository, code_language, kind, count(*) AS n FROM {_ONCE} WHERE code_language IN ('Java', 'Rust') AND kind IN ('class') GROUP BY ALL")
def filtered_scan(spark, sf):
    rows = search.filtered(table(spark, sf, "code_symbols"), languages=["Java", "Rust"], kinds=["class"])
    return rows.groupBy("repository", "code_language", "kind").agg(F.count_distinct("id").alias("n"))


@query(r"""SELECT request_id, array_to_string(list_filter(list_transform(coalesce(repository_scopes, []), lambda x: trim(regexp_replace(x, '^repo:', ''))), lambda x: contains(x, '/') AND NOT contains(x, '*')), ' ') AS scopes,
    coalesce(len(list_distinct(candidate_languages)), 0) AS languages, least(250, greatest(50, top_k * 5)) AS depth FROM search_requests""")
def request_scopes(spark, sf):
    langs = F.coalesce(F.size(F.array_distinct("candidate_languages")), F.lit(0)).cast("long")
    r = table(spark, sf, "search_requests")
    return r.select("request_id", F.array_join(search.scopes(F.col("repository_scopes")), " ").alias("scopes"), F.greatest(langs, F.lit(0)).alias("languages"), search.recall_depth(F.col("top_k")).alias("depth"))


_LANGS = "('TypeScript', 'Python', 'Java', 'C#', 'Rust', 'Go')"


@query(f"""SELECT request_id, top_k BETWEEN 1 AND 50 AND target_symbol.kind IN ('class', 'function') AND target_symbol.code_language IN {_LANGS}
    AND requirement IS NOT NULL AND (candidate_languages IS NULL OR (len(candidate_languages) > 0 AND len(list_filter(candidate_languages, lambda x: x NOT IN {_LANGS})) = 0)) AS valid FROM search_requests""")
def request_validation(spark, sf):
    known = F.array(*map(F.lit, store.LANGUAGES))
    langs = F.col("candidate_languages").isNull() | ((F.size("candidate_languages") > 0) & F.forall("candidate_languages", lambda x: F.array_contains(known, x)))
    valid = F.col("top_k").between(1, 50) & F.col("target_symbol.kind").isin("class", "function") & F.col("target_symbol.code_language").isin(*store.LANGUAGES) & F.col("requirement").isNotNull() & langs
    return table(spark, sf, "search_requests").select("request_id", valid.alias("valid"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    s AS (SELECT q.vec_id AS qid, d.vec_id AS id, round(greatest(0, list_cosine_similarity(q.v, d.v)), 6) AS score FROM e q, e d WHERE q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM s) SELECT qid, id, score, place FROM r WHERE place <= 10""")
def vector_topk(spark, sf):
    """The stated query set, ids divisible by 100, against all rows; one more than asked, as a query finds itself."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    near = search.vector_topk(e.where("id % 100 = 0").withColumnRenamed("id", "qid"), e, k=11).where("qid <> id")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return near.withColumn("place", F.row_number().over(w)).where("place <= 10")


# SQL has no compatibility normal form: the two characters that occur in code are replaced by theirs
_Q = "concat_ws(chr(10), t.name, t.signature, coalesce(t.documentation, ''), t.kind, t.code_language, t.path, coalesce(requirement, ''))"
_D = """concat_ws(chr(10), title, repository, path, signature, coalesce(summary, ''), replace(replace(coalesce(nullif(content, ''), preview), '½', '1⁄2'), '𝛴', 'Σ')) || chr(10) || array_to_string(coalesce(dependencies, []), chr(10))"""
_BM25 = f"""d AS (SELECT id, {_tokens(_D)} AS t FROM {_ONCE}),
    p AS (SELECT id, len(t) AS n, unnest(t) AS w FROM d), a AS (SELECT count(*) AS n, avg(len(t)) AS avg FROM d), f AS (SELECT w, count(*) AS df FROM p GROUP BY w),
    q AS (SELECT request_id AS qid, unnest({_tokens(_Q)}) AS w FROM (SELECT request_id, target_symbol AS t, requirement FROM search_requests)),
    s AS (SELECT qid, id, round(sum(ln(1 + (a.n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * p.n / a.avg))), 6) AS score FROM q JOIN f USING (w) JOIN p USING (w), a GROUP BY qid, id),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM s)"""


def _bm25(spark, sf):
    """The whole search text on both sides, as the surveyed index has it."""
    q = table(spark, sf, "search_requests").select(F.col("request_id").alias("qid"), T.search_tokens(search.query_text()).alias("tokens"))
    return search.bm25(q, _symbols(spark, sf, *_TEXT_COLUMNS).select("id", T.search_tokens(search.document_text()).alias("tokens")))


@query(f"WITH {_BM25} SELECT qid, id, score, place FROM r WHERE place <= 10")
def text_topk_bm25(spark, sf):
    return _bm25(spark, sf)


@query(f"WITH {_BM25} SELECT qid, id, round(least(1, score / greatest(1, max(score) OVER (PARTITION BY qid))), 6) AS text_score FROM r WHERE place <= 10")
def text_score_normalized(spark, sf):
    return search.text_normalised(_bm25(spark, sf)).select("qid", "id", F.round("text_score", 6).alias("text_score"))


@query(f"SELECT request_id, id, semantic_score, text_score, round(hybrid, 9) AS hybrid FROM {_FUSED}")
def rrf_fusion(spark, sf):
    return search.fuse(search.channel_ranks(table(spark, sf, "channel_results"))).withColumn("hybrid", F.round("hybrid", 9))


_SCORES = f"""(WITH q AS (SELECT request_id, target_symbol AS t, requirement, top_k, candidate_languages FROM search_requests),
    qt AS (SELECT request_id, t, top_k, candidate_languages, {_tokens(_Q)} AS q, {_tokens("t.name")} AS n, {_tokens("t.signature")} AS g,
        {_tokens("concat_ws(chr(10), t.name, t.signature, coalesce(t.documentation, ''), t.path)")} AS c FROM q),
    dt AS (SELECT id, kind, code_language, coalesce(len(dependencies), 0) AS deps, {_tokens(_D)} AS d, {_tokens("title || chr(10) || signature")} AS s FROM {_ONCE} WHERE id IN (SELECT id FROM channel_results)),
    j AS (SELECT *, {_overlap("q", "d")} AS lexical FROM (SELECT f.request_id, f.id, f.semantic_score, f.text_score, f.hybrid, qt.* EXCLUDE (request_id), dt.* EXCLUDE (id) FROM {_FUSED} f JOIN qt USING (request_id) JOIN dt USING (id))),
    k AS (SELECT *, greatest(0, least(1, coalesce(semantic_score, lexical))) AS semantic, greatest(0, least(1, CASE WHEN text_score IS NULL THEN lexical ELSE 0.7::DOUBLE * text_score + 0.3::DOUBLE * lexical END)) AS text_part,
        greatest(0, least(1, 0.4::DOUBLE * {_overlap("n", "s")} + 0.35::DOUBLE * {_overlap("g", "s")} + 0.25::DOUBLE * {_overlap("c", "d")})) AS symbol,
        greatest(0, least(1, CASE WHEN t.kind = kind THEN 0.55::DOUBLE ELSE 0.2 END + CASE WHEN t.code_language = code_language THEN 0.3::DOUBLE ELSE 0.15 END + CASE WHEN deps = 0 THEN 0.15::DOUBLE ELSE 0.05 END)) AS contract FROM j)
    SELECT *, greatest(0, least(1, 0.5::DOUBLE * semantic + 0.2::DOUBLE * text_part + 0.15::DOUBLE * symbol + 0.15::DOUBLE * contract)) AS overall FROM k)"""


@query(f"SELECT request_id, id, round(semantic, 6) AS semantic, round(text_part, 6) AS text, round(symbol, 6) AS symbol, round(contract, 6) AS contract, round(overall, 6) AS overall FROM {_SCORES}")
def candidate_scores(spark, sf):
    fused = search.fuse(search.channel_ranks(table(spark, sf, "channel_results")))
    pairs = fused.join(table(spark, sf, "search_requests").select("request_id", "target_symbol", "requirement"), "request_id").join(_symbols(spark, sf, *_TEXT_COLUMNS, "kind", "code_language"), "id")
    s = search.candidate_scores(pairs)
    return s.select("request_id", "id", *[F.round(c, 6).alias(c) for c in ("semantic", "text", "symbol", "contract", "overall")])


@query(f"""WITH s AS (SELECT request_id, id, top_k, round(hybrid, 9) AS hybrid, round(overall, 6) AS overall FROM {_SCORES} WHERE t.kind = kind AND (coalesce(len(candidate_languages), 0) = 0 OR list_contains(candidate_languages, code_language))),
    r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY hybrid DESC, overall DESC, id) AS place FROM s) SELECT request_id, id, hybrid, overall, place FROM r WHERE place <= top_k""")
def hybrid_topk_batched(spark, sf):
    return search.hybrid_search(table(spark, sf, "search_requests"), table(spark, sf, "channel_results"), _symbols(spark, sf, *_TEXT_COLUMNS, "kind", "code_language"))


# Judgments: the semantic channel's scores as grades; rankings: the text channel and the fusion
_JUDGED = f"(SELECT request_id AS task, id, CASE WHEN score >= 0.75 THEN 3 WHEN score >= 0.6 THEN 2 WHEN score >= 0.4 THEN 1 ELSE 0 END AS grade FROM {_HITS} WHERE channel = 'semantic' AND score IS NOT NULL)"
_TEXT = f"(SELECT request_id AS task, id, place FROM {_RANKS} WHERE channel = 'text')"
_HYBRID = f"(SELECT request_id AS task, id, row_number() OVER (PARTITION BY request_id ORDER BY round(hybrid, 9) DESC, id) AS place FROM {_FUSED})"


def _metrics_sql(ranking: str) -> str:
    return f"""(WITH rk AS (SELECT * FROM {ranking}), jd AS (SELECT * FROM {_JUDGED}), j AS (SELECT rk.task, rk.place, jd.grade, coalesce(jd.grade, 0) AS g FROM rk LEFT JOIN jd ON rk.task = jd.task AND rk.id = jd.id),
    got AS (SELECT task, count(*) FILTER (place <= 10) AS n, count(*) FILTER (place <= 10 AND g >= 2) AS hits, sum(CASE WHEN place <= 10 THEN (pow(2, g) - 1) / log2(place + 1) ELSE 0 END) AS dcg,
        max(CASE WHEN g = 3 THEN 1.0::DOUBLE / place END) AS mrr, count(*) FILTER (place <= 3 AND grade = 0) AS d3, max(CASE WHEN place <= 3 AND g = 3 THEN 1 ELSE 0 END) AS h3, max(CASE WHEN place <= 10 AND g = 3 THEN 1 ELSE 0 END) AS h10 FROM j GROUP BY task),
    want AS (SELECT task, count(*) FILTER (grade >= 2) AS relevant, list(grade ORDER BY grade DESC) AS grades FROM jd GROUP BY task),
    b AS (SELECT coalesce(got.task, want.task) AS task, coalesce(n, 0) AS n, hits, dcg, mrr, d3, h3, h10, relevant, list_sum(list_transform(list_slice(coalesce(grades, []), 1, coalesce(n, 0)), lambda x, i: (pow(2, x) - 1) / log2(i + 1))) AS ideal FROM got FULL JOIN want ON got.task = want.task)
    SELECT task, coalesce(hits / nullif(n, 0), 0) AS "precision", coalesce(hits / nullif(relevant, 0), 0) AS recall, coalesce(dcg / nullif(ideal, 0), 0) AS ndcg, coalesce(mrr, 0) AS mrr, coalesce(d3 / nullif(least(n, 3), 0), 0) AS distractor3, coalesce(h3, 0) AS high_hit3, coalesce(h10, 0) AS high_hit10 FROM b)"""


_NAMES = ("precision", "recall", "ndcg", "mrr", "distractor3", "high_hit3", "high_hit10")
_MACRO = ", ".join(f'round(avg("{n}"), 6) AS "{n}"' for n in _NAMES)


def _rankings(spark, sf):
    ranks = search.channel_ranks(table(spark, sf, "channel_results"))
    g = F.when(F.col("score") >= 0.75, 3).when(F.col("score") >= 0.6, 2).when(F.col("score") >= 0.4, 1).otherwise(0)
    judged = ranks.where("channel = 'semantic' and score is not null").select(F.col("request_id").alias("task"), "id", g.alias("grade"))
    text = ranks.where("channel = 'text'").select(F.col("request_id").alias("task"), "id", "place")
    w = Window.partitionBy("request_id").orderBy(F.desc(F.round("hybrid", 9)), "id")
    hybrid = search.fuse(ranks).select(F.col("request_id").alias("task"), "id", F.row_number().over(w).alias("place"))
    return judged, text, hybrid


@query(f"SELECT task, {', '.join(f'round(\"{n}\", 6) AS \"{n}\"' for n in _NAMES)} FROM {_metrics_sql(_TEXT)}")
def ranking_metrics(spark, sf):
    judged, text, _ = _rankings(spark, sf)
    return evaluate.metrics(text, judged).select("task", *[F.round(n, 6).alias(n) for n in _NAMES])


@query(f"SELECT count(*) AS tasks, {_MACRO} FROM {_metrics_sql(_HYBRID)}")
def macro_average(spark, sf):
    judged, _, hybrid = _rankings(spark, sf)
    return evaluate.macro(evaluate.metrics(hybrid, judged))


@query(f"""WITH a AS (SELECT {_MACRO} FROM {_metrics_sql(_TEXT)}), b AS (SELECT {_MACRO} FROM {_metrics_sql(_HYBRID)}),
    x AS (UNPIVOT a ON * INTO NAME metric VALUE baseline), y AS (UNPIVOT b ON * INTO NAME metric VALUE candidate)
    SELECT metric, baseline, candidate, round(candidate - baseline, 6) AS delta, CASE WHEN round(candidate - baseline, 6) > 0.001 THEN 'better' WHEN round(candidate - baseline, 6) < -0.001 THEN 'worse' ELSE 'unchanged' END AS direction FROM x JOIN y USING (metric)""")
def system_delta(spark, sf):
    judged, text, hybrid = _rankings(spark, sf)
    return evaluate.deltas(evaluate.macro(evaluate.metrics(text, judged)), evaluate.macro(evaluate.metrics(hybrid, judged)))


# Rerank: the text channel stands for a reranker of the semantic candidates
_CAND, _RERANK = "(SELECT DISTINCT request_id, id FROM channel_results WHERE channel = 'semantic')", "(SELECT request_id, id, text_score AS score FROM channel_results WHERE channel = 'text')"


@query(f"""SELECT request_id, 'missing' AS issue, id FROM (SELECT * FROM {_CAND} EXCEPT SELECT request_id, id FROM {_RERANK}) UNION ALL SELECT request_id, 'unknown', id FROM (SELECT request_id, id FROM {_RERANK} EXCEPT SELECT * FROM {_CAND})
    UNION ALL SELECT request_id, 'repeated', id FROM {_RERANK} GROUP BY ALL HAVING count(*) > 1""")
def rerank_contract(spark, sf):
    c = table(spark, sf, "channel_results")
    return verify.rerank_contract(c.where("channel = 'semantic'"), c.where("channel = 'text'"))


@query(f"""WITH c AS (SELECT request_id, id, max(semantic_score) AS hybrid FROM channel_results WHERE channel = 'semantic' GROUP BY ALL), r AS (SELECT request_id, id, max(score) AS rerank FROM {_RERANK} GROUP BY ALL),
    j AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rerank DESC NULLS LAST, hybrid DESC NULLS LAST, id) AS place FROM c LEFT JOIN r USING (request_id, id)) SELECT request_id, id, rerank, place FROM j WHERE place <= 10""")
def rerank_apply(spark, sf):
    c = table(spark, sf, "channel_results")
    cand = c.where("channel = 'semantic'").groupBy("request_id", "id").agg(F.max("semantic_score").alias("hybrid"))
    return verify.rerank_apply(cand, c.where("channel = 'text'").withColumnRenamed("text_score", "score")).select("request_id", "id", "rerank", "place")


# Differential verification: totals of orders against totals recomputed from their lines
_SRC = "(SELECT o_orderkey AS case_id, o_custkey AS class, o_totalprice AS value FROM orders)"
_TGT = "(SELECT l_orderkey AS case_id, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS value FROM lineitem GROUP BY 1)"
_REPORT = f"""(SELECT coalesce(s.case_id, t.case_id) AS case_id, class, s.value AS s, t.value AS t, CASE WHEN s.case_id IS NULL OR t.case_id IS NULL THEN 'divergent'
    WHEN s.value = t.value OR abs(s.value - t.value) / greatest(abs(s.value), abs(t.value)) <= 0.25 THEN 'pass' ELSE 'fail' END AS verdict FROM {_SRC} s FULL JOIN {_TGT} t ON s.case_id = t.case_id)"""


def _report(spark, sf):
    done = lambda df: df.select("case_id", F.lit("return").alias("outcome"), "value", F.lit(None).cast("string").alias("exception"))
    source = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_totalprice").alias("value"))
    line = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    target = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.sum(line).alias("value"))
    return verify.compare(done(source), done(target), relative=0.25)


@query(f"SELECT case_id, verdict, CASE WHEN s IS NULL THEN 'missing in source' WHEN t IS NULL THEN 'missing in target' WHEN verdict = 'fail' THEN 'values differ' ELSE '' END AS detail FROM {_REPORT}")
def diff_cases(spark, sf):
    return _report(spark, sf).select("case_id", "verdict", "detail")


@query(f"""SELECT case_id, CASE WHEN verdict = 'pass' AND NOT coalesce(s = e, false) AND NOT coalesce(t = e, false) AND e IS NOT NULL THEN 'fail' ELSE verdict END AS verdict,
    CASE WHEN e IS NULL THEN NULL WHEN coalesce(s = e, false) AND coalesce(t = e, false) THEN 'both-conform' WHEN coalesce(s = e, false) THEN 'source-conforms' WHEN coalesce(t = e, false) THEN 'target-conforms' ELSE 'neither' END AS requirement_verdict
    FROM {_REPORT} LEFT JOIN (SELECT o_orderkey AS case_id, o_totalprice AS e FROM orders WHERE o_orderstatus = 'F') USING (case_id)""")
def golden_verdict(spark, sf):
    golden = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("case_id"), F.col("o_totalprice").alias("expected"))
    return verify.against_golden(_report(spark, sf), golden)


@query(f"""SELECT count(*) AS total, count(*) FILTER (verdict = 'pass') AS "pass", count(*) FILTER (verdict = 'fail') AS fail, count(*) FILTER (verdict = 'divergent') AS divergent, round(count(*) FILTER (verdict = 'pass') / count(*), 6) AS pass_rate FROM {_REPORT}""")
def pass_rate(spark, sf):
    return verify.pass_rate(_report(spark, sf))


@query(f"SELECT count(*) AS classes, count(*) FILTER (ok) AS equivalent, round(count(*) FILTER (ok) / count(*), 6) AS rate FROM (SELECT class, bool_and(verdict = 'pass') AS ok FROM {_REPORT} WHERE class IS NOT NULL GROUP BY class)")
def class_equivalence(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("class"))
    return verify.class_equivalence(_report(spark, sf).join(o, "case_id"))


@query("SELECT unnest(['java.lang.NullPointerException', 'System.FormatException', 'IOException', 'x.y.OwnError']) AS name, unnest(['NullReferenceException', 'ArgumentException', 'IOException', 'OwnError']) AS common")
def exception_alias(spark, sf):
    names = spark.createDataFrame([(n,) for n in ("java.lang.NullPointerException", "System.FormatException", "IOException", "x.y.OwnError")], "name string")
    return names.select("name", V.exception_alias(F.col("name")).alias("common"))


@query(f"SELECT id, repository, kind, ingest_batch, CAST(epoch_us(indexed_at) AS BIGINT) AS indexed_us FROM {_ONCE}")
def upsert_latest(spark, sf):
    return _symbols(spark, sf, "repository", "kind").select("id", "repository", "kind", "ingest_batch", F.unix_micros("indexed_at").alias("indexed_us"))


@query("SELECT user_id, event_type, max(event_id) AS last_event, min(event_id) AS first_position FROM events GROUP BY ALL")
def dedupe_last(spark, sf):
    """The last value of each key at the key's first position."""
    e = table(spark, sf, "events").groupBy("user_id", "event_type")
    return e.agg(F.max("event_id").alias("last_event"), F.min("event_id").alias("first_position"))


@query("""SELECT c.c_custkey AS run, coalesce(b.blockers, 0) AS blockers, coalesce(b.n, 0) > 0 AND coalesce(b.blockers, 0) = 0 AS allowed FROM customer c
    LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('O', 'P')) AS blockers, count(*) AS n FROM orders GROUP BY 1) b ON c.c_custkey = b.o_custkey""")
def validation_gate(spark, sf):
    """Orders stand for the records of a customer's run; runs without any are blocked."""
    status = F.create_map(*[F.lit(x) for x in ("O", "unverified", "P", "fail", "F", "pass")])[F.col("o_orderstatus")]
    records = table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("required"), status.alias("status"))
    return verify.gate(table(spark, sf, "customer").select(F.col("c_custkey").alias("run")), records)


@query("SELECT event_id, user_id, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS accepted_so_far FROM events")
def accepted_counter(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("run"), F.struct("ts", "event_id").alias("seq"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("accepted"))
    return verify.running_accepted(e).select("event_id", F.col("run").alias("user_id"), "accepted_so_far")


_EFFECTS = [("signup", "stage", "joined"), ("signup", "last_error", None), ("click", "stage", "active"), ("purchase", "stage", "buyer"), ("purchase", "last_purchase", "$"), ("error", "last_error", "$")]
_EFFECT_ROWS = ", ".join(f"('{t}', '{f}', {'NULL' if v is None else repr(v)})" for t, f, v in _EFFECTS)


@query(f"""SELECT user_id, field, arg_max_null(CASE WHEN x.value = '$' THEN CAST(event_id AS VARCHAR) ELSE x.value END, (ts, event_id)) AS value
    FROM events JOIN (VALUES {_EFFECT_ROWS}) x(event_type, field, value) USING (event_type) GROUP BY ALL""")
def event_fold(spark, sf):
    """The fields that a user's events set, by a table of effects."""
    e = table(spark, sf, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("seq"), F.col("event_id").cast("string").alias("payload"))
    effects = spark.createDataFrame(_EFFECTS, "event_type string, field string, value string")
    return verify.fold_events(e, effects, "user_id")


@query("""SELECT CAST(floor((n - 1) / 32) AS BIGINT) AS batch, count(*) AS n, min(len) AS shortest, max(len) AS longest, CAST(sum(len) AS BIGINT) AS total
    FROM (SELECT row_number() OVER (ORDER BY doc_id) AS n, length(text) AS len FROM documents) GROUP BY 1""")
def text_batches(spark, sf):
    return store.batches(table(spark, sf, "documents"), "doc_id", F.col("text"))


@query(rf"""SELECT repository, unnest(list_filter([CASE WHEN repository IS NULL OR trim(repository) = '' THEN 'no repository' END, CASE WHEN NOT coalesce(code_language IN {_LANGS}, false) THEN 'unknown language' END,
    CASE WHEN license IS NULL OR trim(license) = '' THEN 'no licence' END,
    CASE WHEN len(list_filter(map_entries(retrieval_class_aliases), lambda e: NOT regexp_full_match(e.key, '[A-Za-z_][A-Za-z0-9_]*') OR NOT regexp_full_match(coalesce(e.value, ''), '[A-Za-z_][A-Za-z0-9_]*'))) > 0 THEN 'invalid alias' END,
    CASE WHEN len(list_filter(dependencies, lambda d: d IS NULL OR trim(d) = '')) > 0 THEN 'empty dependency' END, CASE WHEN coalesce(regexp_matches(source_root, '(^|/)\.\.(/|$)|^/'), false) THEN 'source root escapes' END], lambda x: x IS NOT NULL)) AS issue FROM corpus_manifests""")
def manifest_validation(spark, sf):
    return store.manifest_issues(table(spark, sf, "corpus_manifests"))


@query(rf"""WITH a AS (SELECT 'fixture/' || repository AS repository, unnest(map_entries(retrieval_class_aliases)) AS e FROM corpus_manifests),
    s AS (SELECT repository, split_part(id, ':', 4) AS name, count(*) AS n, max(CASE WHEN length(coalesce(summary, '')) > 0 THEN 1 ELSE 0 END) AS documented FROM {_ONCE} WHERE kind = 'class' GROUP BY ALL)
    SELECT a.repository, e.key AS name, e.value AS alias, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' WHEN documented = 0 THEN 'undocumented' ELSE 'ok' END AS finding FROM a LEFT JOIN s ON a.repository = s.repository AND e.key = s.name""")
def alias_audit(spark, sf):
    return store.alias_audit(table(spark, sf, "corpus_manifests"), table(spark, sf, "code_symbols"))


@query(r"""SELECT DISTINCT repository, path, CASE lower(regexp_extract(path, '\.([^./]+)$', 1)) WHEN 'ts' THEN 'TypeScript' WHEN 'tsx' THEN 'TypeScript' WHEN 'py' THEN 'Python' WHEN 'java' THEN 'Java' WHEN 'cs' THEN 'C#' WHEN 'rs' THEN 'Rust' WHEN 'go' THEN 'Go' END AS code_language,
    regexp_matches(lower(path), '(^|/)tests?/|(^|/)test_[^/]*$|(\.test\.ts|\.spec\.ts|_test\.go|_test\.py)$|(^|/)tests?$') AS is_test, regexp_matches(path, '(^|/)(node_modules|target|build|__pycache__|\.[^/]*)/') OR regexp_matches(path, '(^|/)\.[^/]*$') AS skipped FROM source_files""")
def file_scan(spark, sf):
    p = F.col("path")
    f = table(spark, sf, "source_files").select("repository", "path").distinct()
    return f.select("repository", "path", store.language_of(p).alias("code_language"), store.is_test_path(p).alias("is_test"), store.is_skipped(p).alias("skipped"))


@query(f"""SELECT r.repository, CASE WHEN newest IS NULL THEN 'missing' WHEN indexed IS NULL THEN 'unindexed' WHEN newest > indexed THEN 'stale' ELSE 'indexed' END AS status
    FROM (SELECT DISTINCT 'fixture/' || repository AS repository FROM corpus_manifests) r LEFT JOIN (SELECT repository, max(scanned_at) AS newest FROM source_files GROUP BY 1) f USING (repository)
    LEFT JOIN (SELECT repository, max(indexed_at) AS indexed FROM code_symbols GROUP BY 1) s USING (repository)""")
def repository_status(spark, sf):
    return store.repository_status(*(table(spark, sf, n) for n in ("corpus_manifests", "source_files", "code_symbols")))


@query(r"""WITH s AS (SELECT DISTINCT repository, path, id, kind FROM code_symbols),
    n AS (SELECT DISTINCT repository, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS node, 'folder' AS kind FROM s, range(1, 12) t(i) WHERE i < len(string_split(path, '/'))
        UNION ALL SELECT DISTINCT repository, path, 'file' FROM s),
    a AS (SELECT repository, regexp_replace(node, '/?[^/]*$', '') AS parent, node, kind FROM n UNION ALL SELECT repository, path, id, kind FROM s)
    SELECT *, row_number() OVER (PARTITION BY repository, parent ORDER BY CASE kind WHEN 'folder' THEN 0 WHEN 'file' THEN 1 ELSE 2 END, node) AS place FROM a""")
def module_tree(spark, sf):
    return store.module_tree(table(spark, sf, "code_symbols").select("repository", "path", "id", "kind"))


@query("""SELECT request_id, min_by(s.id, (abs(line - target_symbol.line_no), line, s.id)) AS id FROM search_requests r JOIN (SELECT DISTINCT id, path, split_part(id, ':', 1) AS repo, CAST(split_part(id, ':', 3) AS INT) AS line FROM code_symbols) s
    ON split_part(r.target_symbol.id, ':', 1) = s.repo AND r.target_symbol.path = s.path GROUP BY request_id""")
def nearest_symbol(spark, sf):
    return store.nearest_symbol(table(spark, sf, "search_requests"), table(spark, sf, "code_symbols").select("id", "path").distinct())


def _files(spark, sf):
    return table(spark, sf, "source_files").select("repository", "path", "file_text").dropDuplicates(["repository", "path"])


@query()
def symbol_extract(spark, sf):
    return extract.symbols(_files(spark, sf))


@query(f"SELECT id, repository, path, code_language, kind, signature FROM {_ONCE} WHERE (repository, path) IN (SELECT (repository, path) FROM source_files WHERE file_text IS NOT NULL)")
def symbol_extract_indexed(spark, sf):
    """The symbols of the index, found again in the files: every one must come out with its kind, line and signature."""
    return extract.indexed_again(_files(spark, sf), table(spark, sf, "code_symbols")).drop("summary", "preview")


@query(f"""SELECT s.id, s.repository, s.kind, s.signature, m.license, array_to_string(m.dependencies, ',') AS dependencies, array_to_string(m.compatibility, ',') AS compatibility, len(m.risks) AS risks,
        CASE WHEN s.kind = 'class' THEN coalesce(nullif(m.aliases[split_part(s.id, ':', 4)], ''), split_part(s.id, ':', 4)) ELSE split_part(s.id, ':', 4) END AS title
    FROM {_ONCE} s JOIN (SELECT 'fixture/' || repository AS repository, code_language, coalesce(nullif(license, ''), 'Unknown') AS license, coalesce(dependencies, []) AS dependencies,
        ['Extracted from ' || code_language || ' source'] AS compatibility, CASE WHEN synthetic THEN ['Synthetic evaluation fixture'] ELSE [] END AS risks, retrieval_class_aliases AS aliases FROM corpus_manifests) m
    ON s.repository = m.repository AND s.code_language = m.code_language WHERE (s.repository, s.path) IN (SELECT (repository, path) FROM source_files WHERE file_text IS NOT NULL)""")
def symbol_documents(spark, sf):
    """The documents built from files and manifests, for the symbols the index holds."""
    made = extract.documents(_files(spark, sf), table(spark, sf, "corpus_manifests"))
    made = made.join(table(spark, sf, "code_symbols").select("id").distinct(), "id", "left_semi")
    return made.select("id", "repository", "kind", "signature", "license", F.array_join("dependencies", ",").alias("dependencies"), F.array_join("compatibility", ",").alias("compatibility"), F.size("risks").cast("long").alias("risks"), "title")


@query()
def typed_value_equal(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.lit("number").alias("type"), "value")).alias("a"), F.to_json(F.struct(F.lit("number").alias("type"), F.round("value", 1).alias("value"))).alias("b"))
    return e.select("event_id", V.typed_equal(F.col("a"), F.col("b"), tolerance=0.05).alias("equal"))


@query()
def apply_patches(spark, sf):
    """The first line of each document replaced by a patch whose precondition is that line."""
    d = table(spark, sf, "documents").where("text is not null")
    first = F.element_at(F.split("text", r"\r?\n"), 1)
    hunks = F.array(F.struct(F.lit("@@").alias("header"), F.array(F.struct(F.lit("remove").alias("type"), first.alias("content")), F.struct(F.lit("add").alias("type"), F.lit("patched").alias("content"))).alias("lines")))
    p = d.select("doc_id", V.patched(F.col("text"), hunks).alias("p"))
    return p.select("doc_id", F.length("p.text").alias("length"), "p.error")


@query()
def parse_rankings(spark, sf):
    """Answers of a reranker, as a model would write them, read back."""
    one = F.to_json(F.struct("id", F.coalesce("text_score", F.lit(0.5)).alias("score")))
    r = table(spark, sf, "channel_results").where("channel = 'text'").groupBy("request_id").agg(F.concat(F.lit("Here:\n```json\n["), F.array_join(F.sort_array(F.collect_list(one)), ","), F.lit("]\n```")).alias("answer"))
    return r.select("request_id", F.explode(V.parse_ranking(F.col("answer"))).alias("r")).select("request_id", "r.id", "r.score", "r.reason")
