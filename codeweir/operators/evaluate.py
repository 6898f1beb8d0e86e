"""Ranking quality against graded judgments, per task and macro-averaged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRADES = {"high": 3, "medium": 2, "low": 1, "distractor": 0}


def grade(label) -> F.Column:
    return F.create_map(*[F.lit(x) for p in GRADES.items() for x in p])[label]


def metrics(ranking: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """ranking(task, id, place), judgments(task, id, grade) -> a row for each task of either table.

    precision over the actual length, recall over the task's relevant ids (grade 2 and up), ndcg with gain 2^grade - 1,
    mrr on grade 3 over the whole ranking, high_hit3 / high_hit10, distractor3 over labelled zeros only. Unjudged ids
    count as grade 0; an empty ranking or a task without relevant ids gives 0."""
    judged = ranking.join(judgments, ["task", "id"], "left").withColumn("g", F.coalesce("grade", F.lit(0)))
    gain = lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + 1.0)
    top = F.col("place") <= k
    got = judged.groupBy("task").agg(
        F.count_if(top).alias("n"),
        F.count_if(top & (F.col("g") >= 2)).alias("hits"),
        F.sum(F.when(top, gain(F.col("g"), F.col("place"))).otherwise(0.0)).alias("dcg"),
        F.max(F.when(F.col("g") == 3, 1 / F.col("place"))).alias("mrr"),
        F.count_if((F.col("place") <= 3) & (F.col("grade") == 0)).alias("d3"),
        F.max(F.when((F.col("place") <= 3) & (F.col("g") == 3), 1).otherwise(0)).alias("high_hit3"),
        F.max(F.when((F.col("place") <= 10) & (F.col("g") == 3), 1).otherwise(0)).alias("high_hit10"),
    )
    wanted = judgments.groupBy("task").agg(F.count_if(F.col("grade") >= 2).alias("relevant"), F.sort_array(F.collect_list("grade"), asc=False).alias("grades"))
    both = wanted.join(got, "task", "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))
    best = F.slice(F.coalesce("grades", F.array().cast("array<int>")), 1, F.greatest(F.col("n").cast("int"), F.lit(0)))
    ideal = F.aggregate(F.transform(best, lambda g, i: gain(g, i + 1)), F.lit(0.0), lambda a, x: a + x)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(
        "task",
        zero(F.try_divide("hits", "n")).alias("precision"),
        zero(F.try_divide("hits", "relevant")).alias("recall"),
        zero(F.try_divide(F.col("dcg"), ideal)).alias("ndcg"),
        zero("mrr").alias("mrr"),
        zero(F.try_divide(F.col("d3"), F.least("n", F.lit(3)))).alias("distractor3"),
        F.coalesce("high_hit3", F.lit(0)).alias("high_hit3"),
        F.coalesce("high_hit10", F.lit(0)).alias("high_hit10"),
    )


def macro(per_task: DataFrame) -> DataFrame:
    names = [c for c in per_task.columns if c != "task"]
    return per_task.agg(F.count("*").alias("tasks"), *[F.round(F.avg(c), 6).alias(c) for c in names])


def deltas(base: DataFrame, other: DataFrame, band: float = 0.001) -> DataFrame:
    """(metric, baseline, candidate, delta, direction): differences inside the band are unchanged."""

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.drop("tasks").unpivot([], [c for c in df.columns if c != "tasks"], "metric", name)

    joined = long(base, "baseline").join(long(other, "candidate"), "metric")
    delta = F.round(F.col("candidate") - F.col("baseline"), 6)
    way = F.when(delta > band, "better").when(delta < -band, "worse").otherwise("unchanged")
    return joined.select("metric", "baseline", "candidate", delta.alias("delta"), way.alias("direction"))


def match_judgments(ranking: DataFrame, judgments: DataFrame) -> DataFrame:
    """ranking(task, repository, symbol, place), judgments(task, repository, symbol, grade, seq) -> the ranking with grades:
    the equal symbol, else the first judgment (by seq) of the repository whose symbol ends with, contains or is
    contained in the candidate's. Repositories are compared without their prefix."""
    bare = F.regexp_replace("repository", "^.*/", "")
    r = ranking.withColumn("repository", bare)
    j = judgments.withColumn("repository", bare)
    exact = j.select("task", "repository", "symbol", F.col("grade").alias("equal"))
    loose = r.join(j.withColumnRenamed("symbol", "other"), ["task", "repository"])
    loose = loose.where(F.col("symbol").contains(F.col("other")) | F.col("other").contains(F.col("symbol")))
    first = loose.groupBy("task", "repository", "symbol").agg(F.min_by("grade", "seq").alias("near"))
    keys = ["task", "repository", "symbol"]
    return r.join(exact, keys, "left").join(first, keys, "left").select(*keys, "place", F.coalesce("equal", "near", F.lit(0)).alias("grade"))


def answers_by_source(symbols: DataFrame, sources: list[str]) -> DataFrame:
    """symbols(title, source, id) -> (title, source, ids): the answers of each source for a title, sorted."""
    return symbols.where(F.col("source").isin(sources)).groupBy("title", "source").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def complete_answers(targets: DataFrame, answers: DataFrame, sources: list[str]) -> DataFrame:
    """targets(task, title), answers(title, source, ids) -> (task, source, id), one answer a source, the first; only tasks
    that every source answers."""
    found = targets.join(answers, "title").select("task", "source", F.element_at("ids", 1).alias("id"))
    whole = found.groupBy("task").agg(F.count_distinct("source").alias("n")).where(F.col("n") == len(sources))
    return found.join(whole.select("task"), "task", "left_semi")


def class_recall(ranking: DataFrame, answers: DataFrame, sources: int, wide: int = 20, top: int = 4) -> DataFrame:
    """ranking(task, id, place), answers(task, source, id) -> a row: of the answers expected (tasks times sources) the
    share found among the first wide and top places, and of the tasks the share with any, in percent."""
    hits = answers.select("task", "id").distinct().join(ranking.groupBy("task", "id").agg(F.min("place").alias("place")), ["task", "id"], "left")
    per = hits.groupBy("task").agg(F.count_if(F.col("place") <= wide).alias("wide"), F.count_if(F.col("place") <= top).alias("top"))
    percent = lambda x, of: F.round(100 * F.coalesce(F.try_divide(x, of), F.lit(0.0)), 2)
    tasks = F.count("*")
    return per.agg(
        tasks.alias("tasks"),
        *[percent(F.sum(c), tasks * sources).alias(f"{c}_recall") for c in ("wide", "top")],
        *[percent(F.count_if(F.col(c) > 0), tasks).alias(f"{c}_completion") for c in ("wide", "top")],
    )
