"""The queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweir.llm import bpe, docpairs, forest, licenses, neardup, packing, prose, residue, split

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_oversized(_table(spark, sf, "code_symbols"), "id", ("content", "search_text"), limit=6000, overlap=200)


def p1_covered(spark: SparkSession, sf: str) -> DataFrame:
    """Of each oversized text: its pieces stay within the limit, repeat at least half of the overlap, and cover it."""
    p = p1_pieces(spark, sf)
    before = F.lag("end").over(Window.partitionBy("id", "field").orderBy("piece"))
    p = p.withColumn("repeated", before - F.col("start"))
    fine = (F.col("end") - F.col("start") <= 6000) & (F.length("text") == F.col("end") - F.col("start")) & (F.when(F.col("piece") == 0, F.col("start") == 0).otherwise(F.col("repeated").between(100, 200)))
    return p.groupBy("id", "field").agg(F.max("end").cast("long").alias("length"), F.bool_and(fine).alias("fine"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_pieces(spark, sf).where("piece = 0").select("id", "field")


def p2_licences(spark: SparkSession, sf: str) -> DataFrame:
    names = ("code_symbols", "source_files", "corpus_manifests", "license_files", "license_catalog")
    return licenses.license_findings(*(_table(spark, sf, n) for n in names))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_licences(spark, sf).where("finding in ('conflict', 'unknown')").select("repository", "path", "finding")


def p3_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return forest.nearest(_table(spark, sf, "symbol_vectors"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return forest.close_pairs(forest.nearest(_table(spark, sf, "symbol_vectors"), floor=0.95 - 1e-6), least=0.95)


def p4_prose(spark: SparkSession, sf: str) -> DataFrame:
    return prose.hidden_prose(_table(spark, sf, "code_symbols"), _table(spark, sf, "documents"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_prose(spark, sf).where("lang <> 'en'").select("id", "lang")


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    code = _table(spark, sf, "code_symbols").select("id", F.coalesce("content", "preview").alias("code"))
    return neardup.near_duplicates(code)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.pairs_in_groups(p5_groups(spark, sf))


def p5_members(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with features, the number of its classes, and whether its group holds it."""
    g = p5_groups(spark, sf)
    return g.groupBy("id").agg(F.count_distinct("class").alias("classes"), F.count_distinct("group").alias("groups"))


def p6_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return docpairs.pair(_table(spark, sf, "code_symbols"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_pairs(spark, sf).select("id", "name").distinct()


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_corpus(_table(spark, sf, "documents"))


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(bpe.count_tokens(_table(spark, sf, "documents")))


def p8_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Of all containers: documents assigned, containers over their capacity, pieces of documents that fit whole, and
    documents whose pieces leave a gap."""
    pieces = p8_containers(spark, sf)
    over = pieces.groupBy("container").agg(F.sum("n").alias("fill")).agg(F.count_if(F.col("fill") > 2048).alias("over"))
    docs = pieces.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n").alias("n"), F.max(F.col("start") + F.col("n")).alias("end"))
    cut = (F.col("pieces") > 1) & (F.col("n") <= 2048)
    return docs.agg(F.count("*").alias("documents"), F.count_if(cut).alias("cut"), F.count_if(F.col("n") != F.col("end")).alias("gaps")).crossJoin(over)  # two single rows


def p9_residue(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(_table(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_residue(spark, sf).select("doc_id")


def queries() -> dict[str, Query]:
    own = (
        p1_found, p1_pieces, p1_covered, p2_found, p2_licences, p3_found, p3_neighbors, p4_found, p4_prose, p5_found, p5_groups, p5_members, p6_found, p6_pairs, p7_ids, p8_containers, p8_filled, p9_found, p9_residue,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": "SELECT DISTINCT id, field FROM (SELECT id, 'content' AS field, content AS t FROM code_symbols UNION ALL SELECT id, 'search_text', search_text FROM code_symbols) WHERE length(t) > 6000",
        "p1_covered": "SELECT DISTINCT id, field, length(t) AS length, true AS fine FROM (SELECT id, 'content' AS field, content AS t FROM code_symbols UNION ALL SELECT id, 'search_text', search_text FROM code_symbols) WHERE length(t) > 6000",
        "p5_members": r"SELECT DISTINCT id, 1 AS classes, 1 AS groups FROM code_symbols WHERE len(regexp_extract_all(coalesce(content, preview), '[\p{L}\p{N}\p{M}_]+')) >= 3",
        "p8_filled": "SELECT count(*) AS documents, 0 AS cut, 0 AS gaps, 0 AS over FROM documents",
        "p3_found": """
            WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM symbol_vectors WHERE len(embedding) = 64),
                 f AS (SELECT * FROM u WHERE len(list_filter(v, lambda x: isfinite(x))) = 64 AND len(list_filter(v, lambda x: x <> 0)) > 0),
                 s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS s FROM f a JOIN f b ON a.vec_id <> b.vec_id),
                 r AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM s)
            SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM r WHERE n <= 10 AND s >= 0.95""",
    }
