"""The symbol table: upsert log to current rows, deduplication, batches, manifests, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweir.session import write_shared

EXTENSIONS = {"ts": "TypeScript", "tsx": "TypeScript", "py": "Python", "java": "Java", "cs": "C#", "rs": "Rust", "go": "Go"}
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*$"
LANGUAGES = ("TypeScript", "Python", "Java", "C#", "Rust", "Go")


def current(log: DataFrame, key: str = "id", *order: str) -> DataFrame:
    """The latest delivery of each key. One max_by a key: it combines before the shuffle, so a hot key is no hot task."""
    order = order or ("indexed_at", "ingest_batch")
    row = F.struct(*[c for c in log.columns if c != key])
    return log.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("_r")).select(key, "_r.*")


def upsert(table: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the batch replace those of the table; repeated keys in the batch: the last ordinal (column _seq) wins."""
    last = current(batch, key, "_seq").drop("_seq")
    return table.join(last.select(key), key, "left_anti").unionByName(last)


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in EXTENSIONS.items() for x in p])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def is_test_path(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/"))).rlike(r"(^|/)tests?/|(^|/)test_[^/]*$|(\.test\.ts|\.spec\.ts|_test\.go|_test\.py)$|(^|/)tests?$")


def is_skipped(path: Column) -> Column:
    """Paths below folders that are never indexed."""
    return path.rlike(r"(^|/)(node_modules|target|build|__pycache__|\.[^/]*)/") | path.rlike(r"(^|/)\.[^/]*$")


def union_last(frames: list[DataFrame], key: str, order: str) -> DataFrame:
    """The rows of several roots, in their order: of each key the last value, at the place of its first (column first)."""
    both = None
    for n, df in enumerate(frames):
        own = df.withColumn("_at", F.struct(F.lit(n).alias("root"), F.col(order).alias("n")))
        both = own if both is None else both.unionByName(own)
    rest = [c for c in frames[0].columns if c != key]
    one = both.groupBy(key).agg(F.max_by(F.struct(*rest), "_at").alias("_r"), F.min("_at").alias("first"))
    return one.select(key, "_r.*", "first")


def numbered(df: DataFrame, order: str, *ties: str) -> DataFrame:
    """df with a column n, the place (from 1) of each row in that order; nulls first.

    Rows are laid out by range once, in a written table that holds their partition: whatever the partitions become when
    they are merged or recomputed later, the numbers follow from the written ones. The counts of the partitions are
    summed first, so no task sees all rows."""
    laid = write_shared(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    counts = laid.groupBy("_p").count()
    before = counts.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    own = laid.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(order, *ties)))
    return own.join(before, "_p").withColumn("n", F.col("_n") + F.col("_b")).drop("_p", "_n", "_b")


def batches(df: DataFrame, order: str, text: Column, size: int = 32) -> DataFrame:
    """(batch, n, shortest, longest, total) of text lengths, in batches of size rows in order."""
    rows = numbered(df.select(F.col(order).alias("o"), F.length(text).cast("long").alias("len")), "o", "len")
    batch = F.floor((F.col("n") - 1) / size)
    return rows.groupBy(batch.alias("batch")).agg(F.count("*").alias("n"), F.min("len").alias("shortest"), F.max("len").alias("longest"), F.sum("len").alias("total"))


def manifest_issues(manifests: DataFrame) -> DataFrame:
    """(repository, issue): what makes a manifest unusable or doubtful."""
    checks = {
        "no repository": F.col("repository").isNull() | (F.trim("repository") == ""),
        "unknown language": ~F.coalesce(F.col("code_language").isin(*LANGUAGES), F.lit(False)),
        "no licence": F.col("license").isNull() | (F.trim("license") == ""),
        # an alias is an identifier for an identifier
        "invalid alias": F.coalesce(F.exists(F.map_entries("retrieval_class_aliases"), lambda e: ~(e["key"].rlike(IDENTIFIER) & F.coalesce(e["value"], F.lit("")).rlike(IDENTIFIER))), F.lit(False)),
        "empty dependency": F.coalesce(F.exists("dependencies", lambda d: d.isNull() | (F.trim(d) == "")), F.lit(False)),
        "source root escapes": F.coalesce(F.col("source_root").rlike(r"(^|/)\.\.(/|$)|^/"), F.lit(False)),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return manifests.select("repository", F.explode(found).alias("issue"))


def alias_audit(manifests: DataFrame, symbols: DataFrame, prefix: str = "fixture/") -> DataFrame:
    """(repository, name, alias, finding): aliases of classes with no, one or several symbols, documented or not."""
    a = manifests.select(F.concat(F.lit(prefix), "repository").alias("repository"), F.explode("retrieval_class_aliases").alias("name", "alias"))
    own = symbols.where("kind = 'class'").select("repository", F.element_at(F.split("id", ":"), -1).alias("name"), "id", "summary").dropDuplicates(["id"])
    per = own.groupBy("repository", "name").agg(F.count("*").alias("n"), F.max(F.when(F.length(F.coalesce("summary", F.lit(""))) > 0, 1).otherwise(0)).alias("documented"))
    finding = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(F.col("documented") == 0, "undocumented").otherwise("ok")
    return a.join(per, ["repository", "name"], "left").select("repository", "name", "alias", finding.alias("finding"))


def repository_status(manifests: DataFrame, files: DataFrame, symbols: DataFrame, prefix: str = "fixture/") -> DataFrame:
    """(repository, status): missing without files, unindexed without symbols, stale if a file is newer than the index."""
    r = manifests.select(F.concat(F.lit(prefix), "repository").alias("repository")).distinct()
    newest = files.groupBy("repository").agg(F.max("scanned_at").alias("newest"))
    indexed = symbols.groupBy("repository").agg(F.max("indexed_at").alias("indexed"))
    status = F.when(F.col("newest").isNull(), "missing").when(F.col("indexed").isNull(), "unindexed").when(F.col("newest") > F.col("indexed"), "stale").otherwise("indexed")
    return r.join(newest, "repository", "left").join(indexed, "repository", "left").select("repository", status.alias("status"))


def module_tree(symbols: DataFrame) -> DataFrame:
    """(repository, parent, node, kind, place): the flattened tree; in a parent folders come first, then files, then
    symbols, each by name."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = F.regexp_replace("node", r"/?[^/]*$", "")
    f = symbols.where(F.size(parts) > 1).select("repository", F.explode(folders).alias("node")).distinct().select("repository", up.alias("parent"), "node", F.lit("folder").alias("kind"))
    p = symbols.select("repository", F.col("path").alias("node")).distinct().select("repository", up.alias("parent"), "node", F.lit("file").alias("kind"))
    s = symbols.select("repository", F.col("path").alias("parent"), F.col("id").alias("node"), "kind").distinct()
    rank = F.when(F.col("kind") == "folder", 0).when(F.col("kind") == "file", 1).otherwise(2)
    w = Window.partitionBy("repository", "parent").orderBy(rank, "node")
    return f.unionByName(p).unionByName(s).withColumn("place", F.row_number().over(w))


def nearest_symbol(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """(request_id, id): of the symbols of the request's file, the one whose line is nearest; the earlier on a tie."""
    part = lambda c, i: F.element_at(F.split(c, ":"), i)
    own = symbols.select("id", part(F.col("id"), 1).alias("r"), "path", part(F.col("id"), 3).cast("int").alias("line"))
    t = F.col("target_symbol")
    r = requests.select("request_id", part(t["id"], 1).alias("r"), t["path"].alias("path"), t["line_no"].alias("at"))
    return r.join(own, ["r", "path"]).groupBy("request_id").agg(F.min_by("id", F.struct(F.abs(F.col("line") - F.col("at")), "line", "id")).alias("id"))


def callers(requests: DataFrame, files: DataFrame, most: int = 3) -> DataFrame:
    """requests(request_id, repository, name, path, line), files(repository, path, file_text) -> (request_id, path, line,
    place): the first lines that call the name, in other places of the repository. Lines meet names by an equi-join on the
    called word, so no pair of request and file is made; a request keeps its first calls only, before the shuffle."""
    lines = files.select("repository", "path", F.posexplode(F.split("file_text", r"\r\n|\r|\n")).alias("n", "text"))
    called = lines.select("repository", "path", (F.col("n") + 1).alias("at"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_$][\w$]*)\s*\("), F.lit(1)))).alias("name"))
    r = requests.select("request_id", "repository", "name", F.col("path").alias("own"), F.col("line").alias("own_line"))
    met = called.join(r, ["repository", "name"]).where((F.col("path") != F.col("own")) | (F.col("at") != F.col("own_line")))
    w = Window.partitionBy("request_id").orderBy("path", "at")
    return met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("request_id", "path", F.col("at").alias("line"), "place")
