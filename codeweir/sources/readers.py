"""Readers and sinks: checked JSON lines, test reports, source trees."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweir.operators.store import is_skipped

DOCUMENT = (
    "id string, title string, repository string, license string, code_language string, kind string, path string, signature string, "
    "summary string, preview string, dependencies array<string>, compatibility array<string>, risks array<string>, content string"
)


def json_lines(spark: SparkSession, path: str, schema: str = DOCUMENT) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with file, line and text; blank lines are skipped. Good rows stream from the JSON reader; the
    files with bad ones are read again, whole, as only so a line has a number."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("_file", F.input_file_name())
    required = F.coalesce(F.col("id").isNotNull() & F.col("kind").isin("class", "function"), F.lit(False))
    bad = F.col("_bad").isNotNull() | ~required
    files = rows.where(bad).select("_file").distinct()
    whole = spark.read.text(path, wholetext=True).withColumn("_file", F.input_file_name()).join(files, "_file", "left_semi")
    lines = whole.select("_file", F.posexplode(F.split("value", r"\r?\n")).alias("_n", "_bad")).where(F.trim("_bad") != "")
    read = lines.withColumn("_r", F.from_json("_bad", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    kind = F.coalesce(F.col("_r.id").isNotNull() & F.col("_r.kind").isin("class", "function") & F.col("_r._corrupt").isNull(), F.lit(False))
    return rows.where(~bad).drop("_bad", "_file"), read.where(~kind).select("_file", (F.col("_n") + 1).alias("line"), "_bad", "_r.id")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, file_text) of the source files below a folder, read whole and in parallel, without the folders that are
    never indexed; paths are relative to the folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{ts,tsx,py,java,cs,rs,go}").text(root, wholetext=True)
    base = "^.*?" + re.escape(root.split("://")[-1].rstrip("/")) + "/"
    path = F.regexp_replace(F.url_decode(F.input_file_name()), base, "")
    return files.select(path.alias("path"), F.col("value").alias("file_text")).where(~is_skipped(F.col("path")))


MANIFEST = "repository string, language string, license string, dependencies array<string>, synthetic boolean, sourceRoot string, retrievalClassAliases map<string,string>"
#: Names of manifests, the preferred one first.
MANIFEST_NAMES = ("manifest.json", "dataset-manifest.json")


def discover(spark: SparkSession, root: str, schema: str = MANIFEST) -> DataFrame:
    """(folder, manifest...) of the repositories below a folder: the folder itself if it has a manifest, else each direct
    child that has one."""
    base = root.rstrip("/")
    glob = "{" + ",".join(MANIFEST_NAMES) + "}"
    read = lambda place: spark.read.text(place, wholetext=True).withColumn("_file", F.url_decode(F.input_file_name()))

    def there(place: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(place)
        found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
        return found is not None and len(found) > 0

    place = next((x for x in (f"{base}/{glob}", f"{base}/*/{glob}") if there(x)), None)
    if place is None:
        return spark.createDataFrame([], f"folder string, {schema}")
    named = read(place).select(F.regexp_extract("_file", r"^(.*)/([^/]+)$", 1).alias("folder"), F.regexp_extract("_file", r"([^/]+)$", 1).alias("name"), F.from_json("value", schema).alias("m"))
    first = named.groupBy("folder").agg(F.min_by("m", F.array_position(F.array(*map(F.lit, MANIFEST_NAMES)), F.col("name"))).alias("m"))
    return first.select("folder", "m.*")


def junit(spark: SparkSession, path: str) -> DataFrame:
    """(name, status) of the test cases of JUnit reports."""
    schema = "_name string, _classname string, failure string, error string, skipped string"
    x = spark.read.format("xml").option("rowTag", "testcase").schema(schema).load(path)
    status = F.when(F.col("failure").isNotNull() | F.col("error").isNotNull(), "fail").when(F.col("skipped").isNotNull(), "skipped").otherwise("pass")
    return x.select(F.col("_classname").alias("class"), F.col("_name").alias("name"), status.alias("status"))


def surefire_totals(spark: SparkSession, path: str) -> DataFrame:
    """Sums of run, failed, broken and skipped tests over text reports; the rate is null without tests."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"Tests run: *\d+"))
    part = lambda name: F.sum(F.regexp_extract("value", rf"{name}: *(\d+)", 1).cast("long"))
    t = lines.agg(part("Tests run").alias("run"), part("Failures").alias("failures"), part("Errors").alias("errors"), part("Skipped").alias("skipped"))
    passed = F.col("run") - F.col("failures") - F.col("errors") - F.col("skipped")
    return t.withColumns({"passed": passed, "rate": F.try_divide(passed, "run")})
