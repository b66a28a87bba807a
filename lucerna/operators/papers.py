"""Questions of annotated papers, flattened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def answer_type(a: Column) -> Column:
    """unanswerable, extractive, free_form, yes_no or unknown, in this order. a: an answer struct."""
    return (
        F.when(F.coalesce(a["unanswerable"], F.lit(False)), "unanswerable")
        .when(F.size(F.coalesce(a["extractive_spans"], F.array().cast("array<string>"))) > 0, "extractive")
        .when(strip(F.coalesce(a["free_form_answer"], F.lit(""))) != "", "free_form")
        .when(a["yes_no"].isNotNull(), "yes_no")
        .otherwise("unknown")
    )


def answer_text(a: Column, kind: Column) -> Column:
    return (
        F.when(kind == "extractive", F.array_join(a["extractive_spans"], " | "))
        .when(kind == "free_form", a["free_form_answer"])
        .when(kind == "yes_no", F.when(a["yes_no"], "Yes").otherwise("No"))
        .when(kind == "unanswerable", "[unanswerable]")
        .otherwise("")
    )


def questions(papers: DataFrame) -> DataFrame:
    """A row per question of (split, paper_id, paper): the first annotator's answer, all annotators' types and whether they mix.
    Questions without an annotator are left out."""
    q = papers.select("split", "paper_id", F.col("paper.title").alias("paper_title"), F.explode("paper.qas").alias("q"))
    q = q.where(F.size("q.answers") > 0).withColumn("_a", F.get("q.answers", F.lit(0))["answer"])
    kind = answer_type(F.col("_a"))
    q = q.withColumn("answer_type", kind).withColumn("all_types", F.transform("q.answers", lambda x: answer_type(x["answer"])))
    return q.select(
        "paper_id", "paper_title", F.col("q.question_id").alias("question_id"), F.col("q.question").alias("question"), "answer_type",
        answer_text(F.col("_a"), F.col("answer_type")).alias("answer_text"), F.coalesce("_a.evidence", F.array().cast("array<string>")).alias("evidence"),
        F.size("q.answers").alias("num_annotators"), "all_types", (F.size(F.array_distinct("all_types")) > 1).alias("mixed"), "split",
    )


def mixed_share(q: DataFrame) -> DataFrame:
    """(n, mixed, pct)."""
    return q.agg(F.count("*").alias("n"), F.count_if("mixed").alias("mixed")).withColumn("pct", F.when(F.col("n") > 0, 100 * F.col("mixed") / F.col("n")).otherwise(0.0))


def totals(papers: DataFrame) -> DataFrame:
    """(split, papers, questions) of every split, all questions counted."""
    return papers.groupBy("split").agg(F.count("*").alias("papers"), F.coalesce(F.sum(F.coalesce(F.size("paper.qas"), F.lit(0))), F.lit(0)).alias("questions"))
