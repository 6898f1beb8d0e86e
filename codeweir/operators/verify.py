"""Differential verification: two result tables, golden expectations, verdicts, gates and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweir.functions.values import exception_alias, typed_equal


def numbers_equal(a: Column, b: Column, tolerance: float | None = None, relative: float | None = None) -> Column:
    gap = F.abs(a - b)
    equal = (a == b) | (F.isnan(a) & F.isnan(b))
    if tolerance is not None:
        equal = equal | (gap <= tolerance)
    if relative is not None:
        equal = equal | (gap / F.greatest(F.abs(a), F.abs(b), F.lit(2.0**-52)) <= relative)
    return F.coalesce(equal, F.lit(False))


def values_equal(a: Column, b: Column, tagged: bool, tolerance: float | None, relative: float | None, fold_case: bool) -> Column:
    """Numbers by the tolerances; JSON of tagged values by the recursive comparison, text that is no JSON by itself."""
    if not tagged:
        return numbers_equal(a, b, tolerance, relative)
    return F.coalesce(a == b, F.lit(False)) | typed_equal(a, b, tolerance, relative, fold_case)


def compare(source: DataFrame, target: DataFrame, tolerance: float | None = None, relative: float | None = None, fold_case: bool = False) -> DataFrame:
    """(case_id, outcome, value, exception) of two sides -> (case_id, verdict, detail): a case of one side only is
    divergent, as are different outcomes; exceptions are compared by their common names, values with the tolerances.
    Values are numbers, or strings of tagged JSON."""
    s = source.select("case_id", F.struct("outcome", "value", "exception").alias("s"))
    t = target.select("case_id", F.struct("outcome", "value", "exception").alias("t"))
    both = s.join(t, "case_id", "full_outer")
    same_error = exception_alias(F.col("s.exception")).eqNullSafe(exception_alias(F.col("t.exception")))
    tagged = source.schema["value"].dataType.simpleString() == "string"
    alike = values_equal(F.col("s.value"), F.col("t.value"), tagged, tolerance, relative, fold_case)
    detail = (
        F.when(F.col("s").isNull(), "missing in source")
        .when(F.col("t").isNull(), "missing in target")
        .when(F.col("s.outcome") != F.col("t.outcome"), "outcomes differ")
        .when((F.col("s.outcome") == "exception") & ~same_error, "exceptions differ")
        .when((F.col("s.outcome") == "return") & ~alike, "values differ")
        .otherwise("")
    )
    verdict = F.when(detail.isin("missing in source", "missing in target", "outcomes differ"), "divergent").when(detail == "", "pass").otherwise("fail")
    return both.select("case_id", verdict.alias("verdict"), detail.alias("detail"), F.col("s.value").alias("source_value"), F.col("t.value").alias("target_value"))


def against_golden(report: DataFrame, golden: DataFrame) -> DataFrame:
    """golden(case_id, expected): which side conforms, exactly; agreement on a wrong value is downgraded to fail."""
    j = report.join(golden, "case_id", "left")
    s, t = (numbers_equal(F.col(c), F.col("expected")) for c in ("source_value", "target_value"))
    requirement = F.when(F.col("expected").isNull(), None).when(s & t, "both-conform").when(s, "source-conforms").when(t, "target-conforms").otherwise("neither")
    verdict = F.when((F.col("verdict") == "pass") & (requirement == "neither"), "fail").otherwise(F.col("verdict"))
    return j.select("case_id", verdict.alias("verdict"), requirement.alias("requirement_verdict"))


def pass_rate(report: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in ("pass", "fail", "divergent")]
    rate = F.coalesce(F.try_divide(F.count_if(F.col("verdict") == "pass"), F.count("*")), F.lit(0.0))
    return report.agg(F.count("*").alias("total"), *counts, F.round(rate, 6).alias("pass_rate"))


def class_equivalence(cases: DataFrame) -> DataFrame:
    """cases(class, verdict) -> a row: classes of which every case passes, of all."""
    per = cases.groupBy("class").agg(F.bool_and(F.col("verdict") == "pass").alias("equivalent"))
    return per.agg(F.count("*").alias("classes"), F.count_if("equivalent").alias("equivalent"), F.round(F.coalesce(F.avg(F.col("equivalent").cast("double")), F.lit(0.0)), 6).alias("rate"))


def rerank_contract(candidates: DataFrame, reranked: DataFrame) -> DataFrame:
    """(request_id, issue, id): candidates left out, ids invented and ids repeated by a reranker; none means valid."""
    c, r = candidates.select("request_id", "id").distinct(), reranked.select("request_id", "id")
    missing = c.join(r, ["request_id", "id"], "left_anti").withColumn("issue", F.lit("missing"))
    unknown = r.distinct().join(c, ["request_id", "id"], "left_anti").withColumn("issue", F.lit("unknown"))
    repeated = r.groupBy("request_id", "id").count().where("count > 1").select("request_id", "id", F.lit("repeated").alias("issue"))
    return missing.unionByName(unknown).unionByName(repeated).select("request_id", "issue", "id")


def rerank_apply(candidates: DataFrame, reranked: DataFrame, k: int = 10) -> DataFrame:
    """candidates(request_id, id, hybrid) with the reranker's scores, best first; unscored ones follow by hybrid."""
    j = candidates.join(reranked.groupBy("request_id", "id").agg(F.max("score").alias("rerank")), ["request_id", "id"], "left")
    w = Window.partitionBy("request_id").orderBy(F.desc_nulls_last("rerank"), F.desc("hybrid"), "id")
    return j.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def gate(runs: DataFrame, records: DataFrame) -> DataFrame:
    """(run, blockers, allowed): required records that fail or are unverified block; a run without records is blocked."""
    per = records.groupBy("run").agg(F.count_if(F.col("required") & F.col("status").isin("fail", "unverified")).alias("blockers"), F.count("*").alias("n"))
    j = runs.join(per, "run", "left")
    blockers = F.coalesce("blockers", F.lit(0))
    return j.select("run", blockers.alias("blockers"), ((F.coalesce("n", F.lit(0)) > 0) & (blockers == 0)).alias("allowed"))


def running_accepted(steps: DataFrame) -> DataFrame:
    """steps(run, seq, accepted) -> the number accepted so far, in order."""
    w = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("accepted_so_far", F.sum(F.col("accepted").cast("int")).over(w))


def verify_runs(cases: DataFrame, source: DataFrame, target: DataFrame, tolerance: float | None = None, relative: float | None = None) -> DataFrame:
    """cases(run, case_id, seq) and both sides' results (run, case_id, outcome, value, exception) -> (run, case_id,
    verdict, detail, place). A run of which a side gave no results at all is divergent in every described case; else its
    results are compared, also of cases that were not described. Rows are in the described order, others last."""
    keys = ["run", "case_id"]
    sides = {"source": source, "target": target}
    usable = cases.select("run").distinct()
    for name, rows in sides.items():
        usable = usable.join(rows.select("run").distinct().withColumn(name, F.lit(True)), "run", "left")
    usable = usable.select("run", *[F.coalesce(n, F.lit(False)).alias(n) for n in sides])
    both = F.col("source") & F.col("target")
    whole = lambda df: df.join(usable.where(both), "run", "left_semi").withColumn("case_id", F.struct(*keys)).drop("run")
    done = compare(whole(source), whole(target), tolerance, relative).select("case_id.run", "case_id.case_id", "verdict", "detail")
    silent = F.concat_ws(" ", *[F.when(~F.col(n), f"no results of the {n}.") for n in sides])
    lost = cases.join(usable.where(~both), "run").select(*keys, F.lit("divergent").alias("verdict"), silent.alias("detail"))
    order = Window.partitionBy("run").orderBy(F.asc_nulls_last("seq"), "case_id")
    return done.unionByName(lost).join(cases.select(*keys, "seq"), keys, "left").withColumn("place", F.row_number().over(order)).drop("seq")


def diagnosis(report: DataFrame, inputs: DataFrame) -> DataFrame:
    """The cases of a report that did not pass, with their inputs; those without inputs have an empty list."""
    failed = report.where(F.col("verdict") != "pass")
    j = failed.join(inputs, "case_id", "left")
    return j.withColumn("inputs", F.coalesce("inputs", F.array().cast(inputs.schema["inputs"].dataType)))


def first_records(records: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The first record of each key in the given order; one aggregate, which combines before the shuffle."""
    rest = [c for c in records.columns if c not in key]
    return records.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def with_status(declared: DataFrame, results: DataFrame) -> DataFrame:
    """declared(class, test) with the status of its result, unverified where there is none."""
    return declared.join(results, "test", "left").withColumn("status", F.coalesce("status", F.lit("unverified")))


def class_rate(tests: DataFrame, compiled: int | None = None) -> DataFrame:
    """tests(class, status) -> a row: classes of which every test passes, over those that compile."""
    per = tests.groupBy("class").agg(F.bool_and(F.col("status") == "pass").alias("ok"))
    total = F.count("*") if compiled is None else F.lit(compiled)
    return per.agg(F.count("*").alias("classes"), F.count_if("ok").alias("passed"), F.round(F.coalesce(F.try_divide(F.count_if("ok"), total), F.lit(0.0)), 6).alias("rate"))


def dependency_blockers(plan: DataFrame) -> DataFrame:
    """plan(id, dependency, target, action) -> (id, blockers): unresolved dependencies, and those to be reused or adapted
    that name no target; an item without any is not listed."""
    nameless = F.col("action").isin("reuse-existing", "adapt") & (F.trim(F.coalesce("target", F.lit(""))) == "")
    blocked = plan.where((F.col("action") == "unresolved") | nameless)
    return blocked.groupBy("id").agg(F.sort_array(F.collect_set("dependency")).alias("blockers"))


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """The keys that occur more than once, and how often."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def merge_batches(scored: DataFrame, size: int = 20) -> DataFrame:
    """scored(request_id, id, seq, score): candidates are scored in batches of size in order of seq; the batches are merged
    by score, the earlier first on a tie -> with batch and place."""
    own = Window.partitionBy("request_id")
    batched = scored.withColumn("batch", F.floor((F.row_number().over(own.orderBy("seq")) - 1) / size))
    return batched.withColumn("place", F.row_number().over(own.orderBy(F.desc_nulls_last("score"), "seq")))


def fold_events(events: DataFrame, effects: DataFrame, key: str) -> DataFrame:
    """events(key, event_type, seq, payload), effects(event_type, field, value) -> (key, field, value): each field as the last
    event that has an effect on it leaves it. A value of $ is the event's payload, null clears the field. The effects are
    a small table; one aggregate a key and field, which combines before the shuffle, does the fold."""
    value = F.when(F.col("value") == "$", F.col("payload")).otherwise(F.col("value"))
    met = events.join(effects, "event_type").select(key, "field", F.struct(value.alias("v")).alias("v"), "seq")
    return met.groupBy(key, "field").agg(F.max_by("v", "seq").alias("v")).select(key, "field", F.col("v.v").alias("value"))
