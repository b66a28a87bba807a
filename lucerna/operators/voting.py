"""Majority votes over repeated samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalise
from ..functions import vocabulary as V
from ..functions.text import blank_to_null

RESULT = ("final_answer", "final_answer_normalized", "vote_counts", "total_samples", "valid_samples", "votes", "sc_success", "agreement_ratio", "tie_broken")


def votes(samples: DataFrame, kind: str = "type", choices: str = "choices", fuzzy: bool = True, ascii_words: bool = False) -> DataFrame:
    """Adds `valid` (parsed and no refusal) and `vote`, null for samples that don't count."""
    valid = F.col("parse_success") & ~F.col("refusal")
    text = F.when(valid, F.coalesce(blank_to_null(F.col("answer_normalized")), F.col("answer")))
    return normalise.with_normal(samples.withColumn("valid", valid).withColumn("_counted", text), "_counted", kind, choices, "vote", fuzzy, voting=True, ascii_words=ascii_words).drop("_counted")


def majority(voted: DataFrame, keys: list[str], min_valid: int = V.QUORUM) -> DataFrame:
    """A row per question with the columns of RESULT. voted: keys, sample_ix, valid, vote.

    Votes are first counted per question and answer, with partial sums, so only distinct answers meet per question.
    Order: most votes, then the earlier first sample. Below the quorum the best answer is named without success.
    """
    counts = voted.groupBy(*keys, "vote").agg(F.count("*").alias("n"), F.count_if("valid").alias("v"), F.min("sample_ix").alias("first"))
    one = F.when(F.col("vote").isNotNull(), F.struct((-F.col("n")).alias("less"), F.col("first"), F.col("vote")))
    grouped = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("o"), F.sum("n").alias("total_samples"), F.sum("v").alias("valid_samples"))
    top, count = F.get("o", F.lit(0)), F.coalesce(F.aggregate("o", F.lit(0).cast("long"), lambda a, x: a - x["less"]), F.lit(0))
    quorum = F.col("votes") >= min_valid
    return grouped.withColumn("votes", count).withColumn("top", top).select(
        *keys,
        F.coalesce("top.vote", F.lit("")).alias("final_answer"),
        F.coalesce("top.vote", F.lit("")).alias("final_answer_normalized"),
        F.transform("o", lambda x: F.struct(x["vote"].alias("answer"), (-x["less"]).alias("n"))).alias("vote_counts"),
        "total_samples", "valid_samples", "votes", quorum.alias("sc_success"),
        F.when(F.col("votes") > 0, -F.col("top.less") / F.col("votes")).otherwise(0.0).alias("agreement_ratio"),
        (quorum & (F.size(F.filter("o", lambda x: x["less"] == F.col("top")["less"])) > 1)).alias("tie_broken"),
    )
