"""Further queries of the core and their SQL: text and vectors of the index, verification of runs, recall, context."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeweir.functions import typed
from codeweir.functions import values as V
from codeweir.operators import evaluate, search, store, verify
from codeweir.plans.queries import _D, _HITS, _ONCE, _RANKS, _REPORT, _TEXT_COLUMNS, _files, _report, _symbols, _tokens, query, table
from codeweir.sources import context

_STORED = "concat_ws(chr(10), coalesce(title, ''), coalesce(repository, ''), coalesce(path, ''), coalesce(signature, ''), coalesce(summary, ''), coalesce(nullif(content, ''), preview), array_to_string(coalesce(dependencies, []), ' '))"


@query(f"SELECT id, sha256({_STORED}) AS digest, length({_STORED}) AS length, len({_tokens(_D)}) AS tokens FROM {_ONCE}")
def stored_text(spark, sf):
    s = _symbols(spark, sf, *_TEXT_COLUMNS)
    own = search.stored_text(expand=False)
    # what the forms add is as long as the tokens are many: a blank between two, a line end before the first
    forms = F.size(F.split(F.substring(search.stored_text(), F.length(own) + 2, F.lit(2**31 - 1)), " ")).cast("long")
    return s.select("id", F.sha2(own, 256).alias("digest"), F.length(own).cast("long").alias("length"), forms.alias("tokens"))


@query("SELECT id, sha256(array_to_string(list_concat([coalesce(title, ''), coalesce(signature, ''), coalesce(summary, ''), coalesce(nullif(content, ''), preview)], coalesce(dependencies, [])), chr(10))) AS digest FROM " + _ONCE)
def embedding_text(spark, sf):
    return _symbols(spark, sf, *_TEXT_COLUMNS).select("id", F.sha2(search.embedding_text(), 256).alias("digest"))


def _hash_sql() -> str:
    from codeweir.plans.queries import SQL

    return SQL["hash_embedding"]


@query(_hash_sql())
def provider_embedding(spark, sf):
    """Vectors by a provider, here the one that hashes: their entries equal those of the columns of hash_embedding."""
    v = search.embed(table(spark, sf, "search_requests"), "request_id", "requirement", search.hash_provider(384), 384)
    e = v.select("request_id", F.posexplode("embedding").alias("bucket", "value")).where("value <> 0")
    return e.select("request_id", F.col("bucket").cast("long").alias("bucket"), F.round("value", 6).alias("value"))


# Runs: a customer's orders are the described cases, those not open the source's results, those not urgent the target's
_RUN_CASES = "(SELECT o_custkey AS run, o_orderkey AS case_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq FROM orders)"


@query(f"""WITH c AS (SELECT * FROM {_RUN_CASES}), s AS (SELECT o_custkey AS run, o_orderkey AS case_id, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'O'),
    t AS (SELECT o_custkey AS run, o_orderkey AS case_id, round(o_totalprice, 0) AS v FROM orders WHERE o_orderpriority <> '1-URGENT'),
    u AS (SELECT run, run IN (SELECT run FROM s) AS source, run IN (SELECT run FROM t) AS target FROM (SELECT DISTINCT run FROM c)),
    d AS (SELECT coalesce(s.run, t.run) AS run, coalesce(s.case_id, t.case_id) AS case_id, CASE WHEN s.case_id IS NULL OR t.case_id IS NULL THEN 'divergent' WHEN abs(s.v - t.v) <= 0.25 THEN 'pass' ELSE 'fail' END AS verdict,
            CASE WHEN s.case_id IS NULL THEN 'missing in source' WHEN t.case_id IS NULL THEN 'missing in target' WHEN abs(s.v - t.v) <= 0.25 THEN '' ELSE 'values differ' END AS detail
          FROM s FULL JOIN t ON s.run = t.run AND s.case_id = t.case_id WHERE coalesce(s.run, t.run) IN (SELECT run FROM u WHERE source AND target)
          UNION ALL SELECT c.run, case_id, 'divergent', concat_ws(' ', CASE WHEN NOT source THEN 'no results of the source.' END, CASE WHEN NOT target THEN 'no results of the target.' END) FROM c JOIN u ON c.run = u.run WHERE NOT (source AND target))
    SELECT d.run, d.case_id, verdict, detail, row_number() OVER (PARTITION BY d.run ORDER BY seq NULLS LAST, d.case_id) AS place FROM d LEFT JOIN c ON d.run = c.run AND d.case_id = c.case_id""")
def verified_runs(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("case_id"), "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority")
    cases = o.select("run", "case_id", F.row_number().over(Window.partitionBy("run").orderBy("o_orderdate", "case_id")).alias("seq"))
    side = lambda df, value: df.select("run", "case_id", F.lit("return").alias("outcome"), value.alias("value"), F.lit(None).cast("string").alias("exception"))
    source = side(o.where("o_orderstatus <> 'O'"), F.col("o_totalprice"))
    target = side(o.where("o_orderpriority <> '1-URGENT'"), F.round("o_totalprice", 0))
    return verify.verify_runs(cases, source, target, tolerance=0.25)


@query(f"""SELECT case_id, verdict, coalesce(inputs, '') AS inputs FROM {_REPORT} LEFT JOIN (SELECT l_orderkey AS case_id, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS inputs FROM lineitem GROUP BY 1) USING (case_id) WHERE verdict <> 'pass'""")
def diagnosis(spark, sf):
    lines = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string"))
    inputs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(lines.alias("inputs"))
    return verify.diagnosis(_report(spark, sf), inputs).select("case_id", "verdict", F.array_join("inputs", ",").alias("inputs"))


# Declared tests: parts by brand; a part that was never returned passes, one that was not sold is unverified
@query("""SELECT p_brand AS class, p_partkey AS test, coalesce(status, 'unverified') AS status FROM part LEFT JOIN (SELECT l_partkey, CASE WHEN bool_or(l_returnflag = 'R' AND l_discount > 0.09) THEN 'fail' ELSE 'pass' END AS status FROM lineitem WHERE l_quantity > 40 GROUP BY 1) ON p_partkey = l_partkey""")
def declared_tests(spark, sf):
    return _declared(spark, sf).select("class", "test", "status")


def _declared(spark, sf):
    failed = F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.09))
    results = table(spark, sf, "lineitem").where("l_quantity > 40").groupBy(F.col("l_partkey").alias("test")).agg(F.when(failed, "fail").otherwise("pass").alias("status"))
    return verify.with_status(table(spark, sf, "part").select(F.col("p_brand").alias("class"), F.col("p_partkey").alias("test")), results)


@query("""WITH t AS (SELECT p_size AS class, coalesce(status, 'unverified') AS status FROM part LEFT JOIN (SELECT l_partkey, CASE WHEN bool_or(l_returnflag = 'R' AND l_discount > 0.09) THEN 'fail' ELSE 'pass' END AS status FROM lineitem WHERE l_quantity > 40 GROUP BY 1) ON p_partkey = l_partkey)
    SELECT count(*) AS classes, count(*) FILTER (ok) AS passed, round(count(*) FILTER (ok) / 31, 6) AS rate FROM (SELECT class, bool_and(status <> 'fail') AS ok FROM t GROUP BY class)""")
def class_rate(spark, sf):
    """Over a declared number of compiling classes; here a class passes if none of its tests fails."""
    sizes = table(spark, sf, "part").select(F.col("p_partkey").alias("test"), F.col("p_size").alias("size"))
    tests = _declared(spark, sf).drop("class").join(sizes, "test").select(F.col("size").alias("class"), F.when(F.col("status") == "fail", "fail").otherwise("pass").alias("status"))
    return verify.class_rate(tests, compiled=31)


_SOURCES = ("Java", "C#", "Go")


@query(f"""WITH a AS (SELECT request_id AS task, code_language AS source, min(h.id) AS id FROM {_HITS} h JOIN (SELECT DISTINCT id, code_language FROM code_symbols) s ON h.id = s.id WHERE channel = 'text' AND code_language IN {_SOURCES} GROUP BY ALL),
    b AS (SELECT a.* FROM a WHERE task IN (SELECT task FROM a GROUP BY task HAVING count(*) = 3)), r AS (SELECT request_id AS task, id, place FROM {_RANKS} WHERE channel = 'semantic'),
    p AS (SELECT b.task, count(*) FILTER (place <= 20) AS wide, count(*) FILTER (place <= 4) AS top FROM b LEFT JOIN r ON b.task = r.task AND b.id = r.id GROUP BY 1)
    SELECT count(*) AS tasks, round(100 * coalesce(sum(wide) / (count(*) * 3), 0), 2) AS wide_recall, round(100 * coalesce(sum(top) / (count(*) * 3), 0), 2) AS top_recall,
        round(100 * coalesce(count(*) FILTER (wide > 0) / count(*), 0), 2) AS wide_completion, round(100 * coalesce(count(*) FILTER (top > 0) / count(*), 0), 2) AS top_completion FROM p""")
def class_recall(spark, sf):
    """The text channel's hits are the answers of three sources (languages), the semantic channel is the ranking."""
    ranks = search.channel_ranks(table(spark, sf, "channel_results"))
    langs = table(spark, sf, "code_symbols").select("id", F.col("code_language").alias("source")).distinct()
    symbols = ranks.where("channel = 'text'").join(langs, "id").select(F.col("request_id").alias("title"), "source", "id")
    targets = symbols.select(F.col("title").alias("task"), "title").distinct()
    answers = evaluate.complete_answers(targets, evaluate.answers_by_source(symbols, list(_SOURCES)), list(_SOURCES))
    ranking = ranks.where("channel = 'semantic'").select(F.col("request_id").alias("task"), "id", "place")
    return evaluate.class_recall(ranking, answers, len(_SOURCES))


@query(f"""SELECT id, array_to_string(list_sort(list_distinct(list(d))), ',') AS blockers FROM (SELECT s.id, s.repository, unnest(s.dependencies) AS d FROM {_ONCE} s)
    WHERE (repository, d) NOT IN (SELECT ('fixture/' || repository, unnest(dependencies)) FROM corpus_manifests WHERE dependencies IS NOT NULL AND coalesce(trim(license), '') <> '') GROUP BY id""")
def dependency_blockers(spark, sf):
    """Dependencies of a symbol that no manifest of its repository with a licence declares are unresolved."""
    s = _symbols(spark, sf, "repository", "dependencies").select("id", "repository", F.explode("dependencies").alias("dependency"))
    m = table(spark, sf, "corpus_manifests").where("trim(license) <> ''").select(F.concat(F.lit("fixture/"), "repository").alias("repository"), F.explode("dependencies").alias("dependency")).distinct()
    plan = s.join(m.withColumn("target", F.col("dependency")), ["repository", "dependency"], "left").withColumn("action", F.when(F.col("target").isNull(), "unresolved").otherwise("reuse-existing"))
    return verify.dependency_blockers(plan).select("id", F.array_join("blockers", ",").alias("blockers"))


@query("SELECT user_id, event_type, min_by(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM events GROUP BY ALL")
def first_records(spark, sf):
    return verify.first_records(table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], "ts", "event_id")


@query("SELECT repository, path, count(*) AS n FROM source_files GROUP BY ALL HAVING count(*) > 1")
def repeated_paths(spark, sf):
    return verify.repeated(table(spark, sf, "source_files"), ["repository", "path"])


@query("""WITH r AS (SELECT request_id, id, max(semantic_score) AS score, row_number() OVER (PARTITION BY request_id ORDER BY id) AS seq FROM channel_results WHERE channel = 'semantic' GROUP BY request_id, id)
    SELECT request_id, id, CAST(floor((seq - 1) / 20) AS BIGINT) AS batch, row_number() OVER (PARTITION BY request_id ORDER BY score DESC NULLS LAST, seq) AS place FROM r""")
def merged_batches(spark, sf):
    s = table(spark, sf, "channel_results").where("channel = 'semantic'").groupBy("request_id", "id").agg(F.max("semantic_score").alias("score"))
    s = s.withColumn("seq", F.row_number().over(Window.partitionBy("request_id").orderBy("id")))
    return verify.merge_batches(s).select("request_id", "id", "batch", "place")


@query(f"""SELECT request_id, id, place, 'first' AS page FROM {_RANKS} WHERE channel = 'semantic' AND place <= 10 UNION ALL
    SELECT request_id, id, place, 'second' FROM {_RANKS} WHERE channel = 'semantic' AND place BETWEEN 11 AND 20""")
def two_pages(spark, sf):
    ranks = search.channel_ranks(table(spark, sf, "channel_results")).where("channel = 'semantic'")
    page = lambda low, high, name: ranks.where(F.col("place").between(low, high)).select("request_id", "id", "place", F.lit(name).alias("page"))
    return page(1, 10, "first").unionByName(page(11, 20, "second"))


@query("""WITH u AS (SELECT 0 AS root, doc_id AS n, repository AS k, doc_kind AS v FROM documents WHERE ingest_batch % 2 = 0 UNION ALL SELECT 1, doc_id, repository, doc_kind FROM documents WHERE ingest_batch % 2 = 1)
    SELECT k AS repository, max_by(v, (root, n)) AS doc_kind, arg_min(n, (root, n)) AS first FROM u WHERE k IS NOT NULL GROUP BY k""")
def union_roots(spark, sf):
    """Two roots, the even and the odd deliveries: of each repository the last kind, at the place of its first document."""
    d = table(spark, sf, "documents").where("repository is not null").select("repository", "doc_id", "doc_kind", "ingest_batch")
    roots = [d.where(F.col("ingest_batch") % 2 == r).drop("ingest_batch") for r in (0, 1)]
    return store.union_last(roots, "repository", "doc_id").select("repository", "doc_kind", F.col("first.n").alias("first"))


@query("""WITH f AS (SELECT DISTINCT repository, path, file_text FROM source_files WHERE file_text IS NOT NULL),
    l AS (SELECT repository, path, unnest(string_split(replace(replace(file_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS t, generate_subscripts(string_split(replace(replace(file_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) AS line FROM f),
    c AS (SELECT DISTINCT repository, path, line, unnest(regexp_extract_all(t, '([A-Za-z_$][\\w$]*)\\s*\\(', 1)) AS name FROM l),
    r AS (SELECT request_id, 'fixture/' || split_part(target_symbol.id, ':', 1) AS repository, CASE target_symbol.code_language WHEN 'Java' THEN 'IllegalStateException' WHEN 'C#' THEN 'InvalidOperationException' WHEN 'TypeScript' THEN 'Error' WHEN 'Rust' THEN 'Err' ELSE 'append' END AS name, target_symbol.path AS own, target_symbol.line_no AS own_line FROM search_requests),
    m AS (SELECT request_id, path, line, row_number() OVER (PARTITION BY request_id ORDER BY path, line) AS place FROM c JOIN r USING (repository, name) WHERE path <> own OR line <> own_line)
    SELECT * FROM m WHERE place <= 3""")
def target_callers(spark, sf):
    """The first lines of each target's repository that call what raises or appends in its language."""
    t = F.col("target_symbol")
    names = F.create_map(*[F.lit(x) for x in ("Java", "IllegalStateException", "C#", "InvalidOperationException", "TypeScript", "Error", "Rust", "Err", "Python", "append", "Go", "append")])
    r = table(spark, sf, "search_requests").select("request_id", F.concat(F.lit("fixture/"), F.element_at(F.split(t["id"], ":"), 1)).alias("repository"), names[t["code_language"]].alias("name"), t["path"].alias("path"), t["line_no"].alias("line"))
    return store.callers(r, _files(spark, sf))


def _declared_symbols(spark, sf):
    """Symbols with their files and lines."""
    part = lambda i: F.element_at(F.split("id", ":"), i)
    s = _symbols(spark, sf, "repository", "path", "kind", "code_language").withColumn("line", part(3).cast("int")).withColumn("name", part(4))
    return s.join(_files(spark, sf).where("file_text is not null"), ["repository", "path"])


_FILED = f"(SELECT * FROM {_ONCE} WHERE (repository, path) IN (SELECT (repository, path) FROM source_files WHERE file_text IS NOT NULL))"


@query(f"SELECT id, split_part(id, ':', 4) AS name, kind = 'function' OR true AS located FROM {_FILED}")
def symbol_context(spark, sf):
    """The context of every symbol of the index whose file is there: each must be found at its line under its name."""
    c = _declared_symbols(spark, sf).select("id", context.collect(F.col("file_text"), F.col("line"), F.col("code_language")).alias("c"))
    return c.select("id", F.col("c.name").alias("name"), (F.length("c.source") > 0).alias("located"))


@query(f"SELECT id, kind FROM {_FILED} WHERE code_language = 'TypeScript'")
def module_nodes(spark, sf):
    """The nodes of TypeScript files that the index holds."""
    f = _files(spark, sf).withColumn("code_language", store.language_of(F.col("path"))).where("code_language = 'TypeScript' and file_text is not null")
    n = f.select("repository", "path", F.explode(context.module_nodes("file_text", "code_language")).alias("n"))
    n = n.select(F.concat_ws(":", F.regexp_replace("repository", "^fixture/", ""), "path", "n.line", "n.name").alias("id"), F.col("n.kind").alias("kind"))
    return n.join(table(spark, sf, "code_symbols").select("id").distinct(), "id", "left_semi")


@query(f"SELECT id, CAST(1 AS INT) AS added, true AS holds FROM {_FILED}")
def symbol_patches(spark, sf):
    """Every symbol replaced by one line: the patch applies to its file, which then holds the line and has as many lines
    fewer as the patch says."""
    mark = F.concat(F.lit("replaced "), F.col("id"))
    s = _declared_symbols(spark, sf).withColumn("p", context.patch(F.col("file_text"), F.col("line"), mark, F.col("code_language"), F.col("kind")))
    done = s.withColumn("d", V.patched(F.col("file_text"), F.col("p.hunks")))
    lines = lambda c: F.size(F.split(c, r"\r?\n"))
    holds = F.col("d.text").contains(mark) & (lines(F.col("file_text")) - lines(F.col("d.text")) == F.col("p.removed") - F.col("p.added"))
    return done.select("id", F.col("p.added").alias("added"), F.coalesce(holds, F.lit(False)).alias("holds"))


@query("SELECT event_id, true AS valid, '{\"type\":\"map\",\"value\":{\"kind\":{\"type\":\"string\",\"value\":\"' || event_type || '\"},\"user\":{\"type\":\"number\",\"value\":' || user_id || '}}}' AS tagged FROM events")
def tagged_values(spark, sf):
    """Raw JSON of every event, read as a tagged value in canonical form, which is then checked."""
    raw = F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind")))
    e = table(spark, sf, "events").select("event_id", typed.tag_json(raw).alias("tagged"))
    return e.select("event_id", (F.size(typed.check_typed(F.col("tagged"))) == 0).alias("valid"), "tagged")


@query("""SELECT o_custkey AS run, count(*) FILTER (o_orderstatus <> 'P') AS results, count(*) FILTER (o_orderstatus = 'P') AS issues FROM orders GROUP BY 1""")
def side_results(spark, sf):
    """A customer's orders as the output of a side, those in progress without a value: their rows are issues, the others
    results."""
    value = F.struct(F.lit("number").alias("type"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("value"))
    row = F.struct(F.col("o_orderkey").cast("string").alias("caseId"), F.lit("return").alias("outcome"), value.alias("returnValue"))
    text = F.to_json(F.struct(F.collect_list(row).alias("results")), {"ignoreNullFields": "false"})
    side = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run")).agg(text.alias("t")).select("run", typed.parse_side(F.col("t")).alias("p"))
    return side.select("run", F.size("p.results").cast("long").alias("results"), F.size("p.issues").cast("long").alias("issues"))
