"""Cells of models and strategies: matrix, status, resumption, rates."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..sources import commit_log, json_files, settings, stores
from . import inference, prompts

#: Assumptions of the time estimate: tokens a second, output tokens a question.
TOKENS_A_SECOND, TOKENS_A_QUESTION = 750, 200


def matrix(spark: SparkSession, models: list[str] | DataFrame, strategies: list[str]) -> DataFrame:
    """(cell_no, model, strategy), by model and then strategy: models of a list of settings in its order, or of a table (its first column;
    distinct, without null) by name; strategies in the given order."""
    kinds = F.posexplode(F.lit(strategies)).alias("_s", "strategy")
    if not isinstance(models, DataFrame):
        models = spark.createDataFrame(list(enumerate(models)), "_m int, model string").select("_m", "model")
    else:
        names = models.select(F.col(models.columns[0]).cast("string").alias("model")).where("model is not null").distinct()
        models = names.select((F.row_number().over(Window.orderBy("model")) - 1).alias("_m"), "model")  # a row for each model
    return models.select("_m", "model", kinds).select((F.col("_m") * len(strategies) + F.col("_s") + 1).cast("int").alias("cell_no"), "model", "strategy")


def status(cells: DataFrame, done: DataFrame, expected: int) -> DataFrame:
    """Adds n_done and status: COMPLETE, PARTIAL (n/m) or PENDING. done: records with model and strategy."""
    counts = done.groupBy("model", "strategy").agg(F.count("*").alias("n_done"))
    out = cells.join(counts, ["model", "strategy"], "left").na.fill(0, ["n_done"])
    n = F.col("n_done")
    return out.withColumn("status", F.when(n >= expected, "COMPLETE").when(n > 0, F.concat(F.lit("PARTIAL ("), n.cast("string"), F.lit(f"/{expected})"))).otherwise("PENDING"))


def missing(questions: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What isn't done yet, by key, whatever the order of the records."""
    return questions.join(done.select(*keys).distinct(), keys, "left_anti")


def parse_rates(records: DataFrame) -> DataFrame:
    """(model, strategy, n, parse_rate in percent): success of the vote for repeated samples, of the parse for others."""
    good = F.when(F.col("strategy") == "sc", F.col("sc_success")).otherwise(F.col("parse_success"))
    return records.groupBy("model", "strategy").agg(F.count("*").alias("n"), (100 * F.avg(F.coalesce(good, F.lit(False)).cast("double"))).alias("parse_rate"))


def totals(summaries: DataFrame) -> DataFrame:
    """(processed, parse_rate weighted by processed, duration_s) of cell summaries."""
    one = summaries.agg(F.sum("processed").alias("processed"), F.sum(F.col("parse_rate") * F.col("processed")).alias("w"), F.sum("duration_s").alias("duration_s"))
    return one.select("processed", F.when(F.col("processed") > 0, F.col("w") / F.col("processed")).otherwise(0.0).alias("parse_rate"), "duration_s")


def estimate(cells: DataFrame, expected: int, samples: int = V.SAMPLES) -> DataFrame:
    """(pending, partial, complete, total, hours) of cells with status; hours for all that aren't complete."""
    seconds = F.when(F.col("status") == "COMPLETE", 0.0).otherwise(F.when(F.col("strategy") == "sc", float(samples)).otherwise(1.0) * expected * TOKENS_A_QUESTION / TOKENS_A_SECOND)
    return cells.agg(
        F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if(F.col("status").startswith("PARTIAL")).alias("partial"),
        F.count_if(F.col("status") == "COMPLETE").alias("complete"), F.count("*").alias("total"), (F.coalesce(F.sum(seconds), F.lit(0.0)) / 3600).alias("hours"),
    )


def read_done(spark: SparkSession, path: str) -> DataFrame:
    """Keys and successes of the valid records that are committed under a path; none where there are none."""
    schema = "question_id string, parsed struct<parse_success:boolean>, sc_result struct<sc_success:boolean>, model string, strategy string"
    committed = commit_log.read(spark, path)
    if committed is None:
        return spark.createDataFrame([], "model string, strategy string, question_id string, parse_success boolean, sc_success boolean")
    lines = json_files.valid_lines(committed)
    rows = lines.select("model", "strategy", F.from_json("value", schema).alias("r"))
    return rows.select("model", "strategy", "r.question_id", "r.parsed.parse_success", "r.sc_result.sc_success")


def run_cell(questions: DataFrame, config: dict, model: str, strategy: str, out: str, limit: int | None = None, factory=None, folder: str | None = None) -> dict:
    """Answers what is missing of a cell, commits the records chunk by chunk and tells how it went. Without a factory the model is mocked.

    limit: None for all questions, else the first so many by id, none for 0. A record that an earlier run committed is never
    written again: resumption goes by key. A run that is killed leaves whole chunks; files hold `checkpoint_every` records at most, a chunk
    about that many for each core, or a sixteenth of the run if that is more. Records repeat their question in the prompt, so files are
    compressed (`compression` of the settings, gzip without one), and what is left goes from the work folder with each chunk.
    """
    spark = questions.sparkSession
    name = strategy.lower()
    settings.template(name, folder)
    began = time.time()
    chosen = questions if limit is None else questions.orderBy("question_id").limit(limit)
    total = chosen.count()
    done = read_done(spark, out).where((F.col("model") == model) & (F.col("strategy") == name))
    every = config.get("inference", {}).get("checkpoint_every", V.CHECKPOINT_EVERY)
    left = chosen if done.isEmpty() else missing(chosen, done, ["question_id"])
    left, chunks = commit_log.chunks(left, ["question_id"], every)
    spooled = json_files.work_folder(spark, "left")
    if chunks:
        with stores.brief_shuffles(spark):
            left.write.option("compression", "zstd").partitionBy("_chunk").parquet(spooled)
        left = spark.read.schema(left.schema).parquet(spooled)
    n = left.count() if chunks else 0
    summary = {"model": model, "strategy": name, "total": total, "processed": n, "skipped": total - n, "parse_rate": 0.0, "duration_s": 0.0, "status": "skipped" if total and not n else "complete"}
    params = inference.sampling(name, config.get("inference", {}))
    run = uuid.uuid4().hex
    prompt = prompts.prompt(F.col("question"), name, prompts.choices_or_null(), folder=folder)
    try:
        for k in range(chunks):
            asked = left.where(F.col("_chunk") == k).drop("_chunk")
            answered = inference.mocked(asked.withColumn("prompt", prompt), name, params) if factory is None else inference.generated(asked, factory, params, config.get("inference", {}).get("batch_size"), prompt=prompt)
            made = inference.records(answered, model, name, config.get("inference", {}).get("sc_min_valid", V.QUORUM))
            commit_log.append(made, out, f"{run}-{k}", every, compression=config.get("inference", {}).get("compression", "gzip"))
            stores.remove(spark, f"{spooled}/_chunk={k}")
    finally:
        stores.remove(spark, spooled)
    now = read_done(spark, out).where((F.col("model") == model) & (F.col("strategy") == name)).dropDuplicates(["question_id"])
    rate = parse_rates(now).first()
    return summary | {"parse_rate": rate.parse_rate if rate else 0.0, "duration_s": round(time.time() - began, 3)}


def run_matrix(questions: DataFrame, config: dict, out: str, models: list[str] | None = None, strategies: list[str] | None = None, limit: int | None = None, factories: dict | None = None) -> list[dict]:
    """Every cell, model by model, so that a worker loads a backend once for all of a model's strategies."""
    names = settings.subset(models, list(config["models"]))
    kinds = settings.subset(strategies, list(config["strategies"]))
    return [run_cell(questions, config, m, s, out, limit, (factories or {}).get(m)) for m in names for s in kinds]


def validation(parsed: DataFrame) -> DataFrame:
    """Tallies of mock responses (column good): parse rate of the good, and share of the bad that weren't refused or failed."""
    ok = F.col("parsed.parse_success")
    caught = ~ok | F.col("parsed.refusal")
    one = parsed.agg(F.count_if("good").alias("good_total"), F.count_if(F.col("good") & ok).alias("good_parsed"), F.count_if(~F.col("good")).alias("bad_total"), F.count_if(~F.col("good") & caught).alias("bad_failed"))
    share = lambda a, b: F.when(b > 0, 100 * a / b).otherwise(0.0)
    return one.withColumn("parse_rate", share(F.col("good_parsed"), F.col("good_total"))).withColumn("false_positive_rate", share(F.col("bad_total") - F.col("bad_failed"), F.col("bad_total")))
