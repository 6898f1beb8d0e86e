"""Hybrid search for a batch of requests: channels, fusion, scores, cut."""

from __future__ import annotations

import re
import time
import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweir.functions.text import overlap, search_tokens
from codeweir.session import write_shared

K1, B = 1.2, 0.75
WEIGHTS = {"semantic": 0.65, "text": 0.35}


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def filtered(docs: DataFrame, repositories: list[str] = (), languages: list[str] = (), kinds: list[str] = ()) -> DataFrame:
    """Conjunction of memberships; an empty list asks nothing. The predicates reach the Parquet scan."""
    asked = [F.col(c).isin(list(v)) for c, v in (("repository", repositories), ("code_language", languages), ("kind", kinds)) if v]
    return docs.where(reduce(lambda a, b: a & b, asked)) if asked else docs


def scopes(c: Column) -> Column:
    """Repository scopes without the repo: mark and blanks; only names with a slash and no wildcard count."""
    cleaned = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(x, "^repo:", "")))
    return F.filter(cleaned, lambda x: x.contains("/") & ~x.contains("*"))


def recall_depth(top_k: Column, with_reranker: bool = False) -> Column:
    return F.lit(20) if with_reranker else F.least(F.lit(250), F.greatest(F.lit(50), top_k * 5))


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row a key, the first in the given order (ties by the caller's columns)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def block_topk(queries: DataFrame, docs: DataFrame, k: int, block: int = 2048, query_block: int = 65_536) -> DataFrame:
    """queries(qid, e: array<struct<t, x>>), docs(id, tokens, w) -> (qid, id, score, place): the best k documents of each
    query by w times the sum of x over shared tokens, to six digits; documents that share none are not given.

    Blocks of documents meet blocks of queries in one task a pair, which inverts the block's tokens, sums a query's lists
    and keeps k; a window merges the blocks. A document is moved once for each block of queries, and no row is made for a
    pair of query and document that is not kept, so a token of most documents costs no more than others."""
    nq, nd = max(1, -(-queries.count() // query_block)), max(1, -(-docs.count() // block))
    q = queries.select(F.pmod(F.hash("qid"), F.lit(nq)).alias("qb"), "qid", F.col("e.t").alias("t"), F.col("e.x").alias("x")).withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(nd - 1))))
    d = docs.select(F.pmod(F.hash("id"), F.lit(nd)).alias("db"), "id", "tokens", "w").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        frame = lambda q, i, s: pd.DataFrame({"qid": pd.Series(q, dtype=object), "id": pd.Series(i, dtype=object), "score": pd.Series(s, dtype=float)})
        if not len(a) or not len(b):
            return frame([], [], [])
        b = b.sort_values("id")
        ids, weights = b["id"].to_numpy(), b["w"].to_numpy(float)
        size = b["tokens"].map(len).to_numpy()
        term, names = pd.factorize(np.concatenate(b["tokens"].to_numpy()))
        order = np.argsort(term, kind="stable")
        members = np.repeat(np.arange(len(b)), size)[order]
        edges = np.searchsorted(term[order], np.arange(len(names) + 1))
        lists = {t: members[i:j] for t, i, j in zip(names, edges[:-1], edges[1:])}
        qids, near_ids, scores = [], [], []
        for qid, ts, xs in zip(a["qid"], a["t"], a["x"]):
            met = [(lists[t], x) for t, x in zip(ts, xs) if t in lists]
            if not met:
                continue
            parts = np.repeat([x for _, x in met], [len(m) for m, _ in met])
            total = np.bincount(np.concatenate([m for m, _ in met]), parts, len(b)) * weights
            hit = np.flatnonzero(total > 0)
            score = np.round(total[hit], 6)
            if len(hit) > k:  # all that tie with the last one stay until ids decide
                near = score >= np.partition(score, len(score) - k)[len(score) - k]
                hit, score = hit[near], score[near]
            first = np.lexsort((hit, -score))[:k]
            qids += [qid] * len(first)
            near_ids += ids[hit[first]].tolist()
            scores += score[first].tolist()
        return frame(qids, near_ids, scores)

    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, id {docs.schema['id'].dataType.simpleString()}, score double"
    found = q.groupBy("qb", "db").cogroup(d.groupBy("qb", "db")).applyInPandas(best, kinds)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def bm25(queries: DataFrame, docs: DataFrame, k: int = 10, block: int = 2048) -> DataFrame:
    """queries(qid, tokens), docs(id, tokens) -> (qid, id, score, place): BM25, the best k a query. The tokens are made once,
    in a written table that statistics and search share."""
    docs = write_shared(docs.select("id", "tokens"))
    n = docs.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avg"))  # one row
    df = docs.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = queries.select("qid", F.explode("tokens").alias("t")).join(df, "t").crossJoin(F.broadcast(n)).select("qid", "t", idf.alias("x"))
    q = terms.groupBy("qid").agg(F.collect_list(F.struct("t", "x")).alias("e"))
    weight = (K1 + 1) / (1 + K1 * (1 - B + B * F.size("tokens") / F.col("avg")))
    return block_topk(q, docs.crossJoin(F.broadcast(n)).select("id", "tokens", weight.alias("w")), k, block, 32 * block)


def overlap_best(queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """queries(qid, tokens), docs(id, tokens) -> (qid, id, score, place): the best k by shared tokens over the geometric
    mean of both sizes; documents that share none are not given."""
    share = 1 / F.sqrt(F.size("tokens").cast("double"))
    q = queries.where(F.size("tokens") > 0).select("qid", F.transform("tokens", lambda t: F.struct(t.alias("t"), share.alias("x"))).alias("e"))
    return block_topk(q, write_shared(docs.where(F.size("tokens") > 0).select("id", "tokens", share.alias("w"))), k)


def text_normalised(scored: DataFrame) -> DataFrame:
    """Scores over the best of the query, but never over less than 1, so that weak hits are not inflated."""
    top = F.greatest(F.max("score").over(Window.partitionBy("qid")), F.lit(1.0))
    return scored.withColumn("text_score", F.least(F.lit(1.0), F.col("score") / top))


def vector_topk(queries: DataFrame, docs: DataFrame, k: int = 10, block: int = 4096) -> DataFrame:
    """queries(qid, v), docs(id, v) -> (qid, id, score, place): exact cosine search, score = max(0, 1 - distance).

    The query set meets all rows in blocks: rows and queries are numbered into blocks, each pair of blocks is one matrix
    product that keeps k a query, and a window merges the blocks. Nothing is broadcast."""
    queries = queries.where(F.exists("v", lambda x: x != 0))
    docs = docs.where(F.exists("v", lambda x: x != 0))
    nq, nd = (max(1, -(-x.count() // block)) for x in (queries, docs))
    q = queries.select(F.pmod(F.hash("qid"), F.lit(nq)).alias("qb"), "qid", "v").withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(nd - 1))))
    d = docs.select(F.pmod(F.hash("id"), F.lit(nd)).alias("db"), "id", "v").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"qid": [], "id": [], "score": []})
        x, y = (np.stack(t["v"].to_numpy()).astype(float) for t in (a, b))
        x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
        s = np.round(np.maximum(0, x @ y.T), 6)
        ids = b["id"].to_numpy()
        near = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
        rows = np.arange(len(a))[:, None]
        return pd.DataFrame({"qid": np.repeat(a["qid"].to_numpy(), near.shape[1]), "id": ids[near].ravel(), "score": s[rows, near].ravel()})

    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, id {docs.schema['id'].dataType.simpleString()}, score double"
    found = q.groupBy("qb", "db").cogroup(d.groupBy("qb", "db")).applyInPandas(best, kinds)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def channel_ranks(hits: DataFrame) -> DataFrame:
    """(request_id, channel, id, score, place): repeated hits once, ranked by the channel's score, unscored ones last."""
    score = F.when(F.col("channel") == "semantic", F.col("semantic_score")).otherwise(F.col("text_score"))
    once = hits.groupBy("request_id", "channel", "id").agg(F.max(score).alias("score"))
    w = Window.partitionBy("request_id", "channel").orderBy(F.desc_nulls_last("score"), "id")
    return once.withColumn("place", F.row_number().over(w))


def fuse(ranks: DataFrame) -> DataFrame:
    """(request_id, id, semantic_score, text_score, hybrid): weighted reciprocal ranks of both channels, full outer.
    One aggregation on (request, id) does the outer join; it combines before the shuffle."""
    weight = F.when(F.col("channel") == "semantic", F.lit(WEIGHTS["semantic"])).otherwise(F.lit(WEIGHTS["text"]))
    own = lambda name: F.max(F.when(F.col("channel") == name, F.col("score"))).alias(f"{name}_score")
    return ranks.groupBy("request_id", "id").agg(own("semantic"), own("text"), F.sum(weight / (60 + F.col("place"))).alias("hybrid"))


def _lines(*columns: Column) -> Column:
    return F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in columns])


def query_text(t: str = "target_symbol") -> Column:
    part = [F.col(f"{t}.{c}") for c in ("name", "signature", "documentation", "kind", "code_language", "path")]
    return _lines(*part, F.col("requirement"))


def document_text() -> Column:
    body = F.coalesce(F.nullif(F.col("content"), F.lit("")), F.col("preview"))
    return F.concat_ws("\n", _lines(*map(F.col, ("title", "repository", "path", "signature", "summary")), body), F.array_join(F.coalesce("dependencies", F.array().cast("array<string>")), "\n"))


def stored_text(expand: bool = True) -> Column:
    """The text a full-text index holds of a document, with the forms of its tokens after it."""
    body = F.coalesce(F.nullif(F.col("content"), F.lit("")), F.col("preview"))
    own = F.concat_ws("\n", _lines(*map(F.col, ("title", "repository", "path", "signature", "summary")), body), F.array_join(F.coalesce("dependencies", F.array().cast("array<string>")), " "))
    return F.concat_ws("\n", own, F.array_join(search_tokens(own), " ")) if expand else own


def embedding_text() -> Column:
    """The text a document is embedded by: neither repository nor path."""
    body = F.coalesce(F.nullif(F.col("content"), F.lit("")), F.col("preview"))
    return F.concat_ws("\n", _lines(*map(F.col, ("title", "signature", "summary")), body), "dependencies")


def embed(df: DataFrame, key: str, text: str, provider, dimension: int, size: int = 32, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """(key, embedding) by a provider: a picklable function of a list of texts to (index, vector) pairs in any order.

    Texts go in batches of size. An answer must have one vector of finite numbers and the right size for each text; a
    failed call (ConnectionError, TimeoutError) is repeated after wait, twice that, and so on."""

    def run(batches):
        for b in batches:
            for at in range(0, len(b), size):
                part = b.iloc[at : at + size]
                yield pd.DataFrame({"k": part["k"], "embedding": _answered(provider, part["t"].tolist(), dimension, tries, wait)})

    source = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return source.mapInPandas(run, f"k {df.schema[key].dataType.simpleString()}, embedding array<double>").withColumnRenamed("k", key)


def _answered(provider, texts: list[str], dimension: int, tries: int, wait: float) -> list[list[float]]:
    for attempt in range(tries):
        try:
            answer = dict(provider(texts))
            break
        except (ConnectionError, TimeoutError):
            if attempt + 1 == tries:
                raise
            time.sleep(wait * 2**attempt)
    if sorted(answer) != list(range(len(texts))):
        raise ValueError("not one vector for each text")
    if any(len(v) != dimension or not np.isfinite(v).all() for v in answer.values()):
        raise ValueError(f"not {dimension} finite numbers in each vector")
    return [list(map(float, answer[i])) for i in range(len(texts))]


def hash_provider(dimension: int = 384):
    """The provider that needs no service: hashed words and trigrams, of length 1."""

    def answer(texts: list[str]) -> list[tuple[int, list[float]]]:
        out = []
        for i, t in enumerate(texts):
            v = np.zeros(dimension)
            for w in re.findall(r"\w+", unicodedata.normalize("NFKC", t).lower()):
                for f in (f"w:{w}", *(f"g:{w[j : j + 3]}" for j in range(len(w) - 2))):
                    h = 2166136261
                    for unit in np.frombuffer(f.encode("utf-16-le"), np.uint16).tolist():
                        h = (h ^ unit) * 16777619 & 0xFFFFFFFF
                    v[h % dimension] += 1 if h < 1 << 31 else -1
            n = np.linalg.norm(v)
            out.append((i, (v / n if n else v).tolist()))
        return out

    return answer


def candidate_scores(pairs: DataFrame) -> DataFrame:
    """pairs of a request (target_symbol, requirement) and a document, with the channels' scores -> the parts and the
    overall score. Token sets of both texts are made once a row and shared by all parts."""
    t = F.col("target_symbol")
    asked = _lines(t["name"], t["signature"], t["documentation"], t["path"])
    p = pairs.withColumns({"_q": search_tokens(query_text()), "_d": search_tokens(document_text()), "_s": search_tokens(_lines(F.col("title"), F.col("signature"))),
                           "_n": search_tokens(t["name"]), "_g": search_tokens(t["signature"]), "_c": search_tokens(asked)})
    lexical = overlap(F.col("_q"), F.col("_d"))
    empty = F.coalesce(F.size("dependencies"), F.lit(0)) == 0
    p = p.withColumns(
        {
            "semantic": clamp(F.coalesce("semantic_score", lexical)),
            "text": clamp(F.when(F.col("text_score").isNull(), lexical).otherwise(0.7 * F.col("text_score") + 0.3 * lexical)),
            "symbol": clamp(0.4 * overlap(F.col("_n"), F.col("_s")) + 0.35 * overlap(F.col("_g"), F.col("_s")) + 0.25 * overlap(F.col("_c"), F.col("_d"))),
            "contract": clamp(
                F.when(t["kind"] == F.col("kind"), 0.55).otherwise(0.2) + F.when(t["code_language"] == F.col("code_language"), 0.3).otherwise(0.15) + F.when(empty, 0.15).otherwise(0.05)
            ),
        }
    )
    overall = clamp(0.5 * F.col("semantic") + 0.2 * F.col("text") + 0.15 * F.col("symbol") + 0.15 * F.col("contract"))
    return p.withColumn("overall", overall).drop("_q", "_d", "_s", "_n", "_g", "_c")


def hybrid_search(requests: DataFrame, hits: DataFrame, docs: DataFrame) -> DataFrame:
    """(request_id, id, place, hybrid, overall): the top_k candidates of each request, of its kind and languages;
    the channels have applied the repository scopes."""
    fused = fuse(channel_ranks(hits))
    r = requests.select("request_id", "target_symbol", "requirement", "top_k", F.array_distinct("candidate_languages").alias("_langs"))
    pairs = fused.join(r, "request_id").join(docs, "id").where(F.col("target_symbol.kind") == F.col("kind"))
    pairs = pairs.where((F.coalesce(F.size("_langs"), F.lit(0)) <= 0) | F.array_contains("_langs", F.col("code_language")))
    scored = candidate_scores(pairs).select("request_id", "id", "top_k", F.round("hybrid", 9).alias("hybrid"), F.round("overall", 6).alias("overall"))
    w = Window.partitionBy("request_id").orderBy(F.desc("hybrid"), F.desc("overall"), "id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.col("top_k")).drop("top_k")
