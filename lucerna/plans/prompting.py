"""Queries of the prompt and mock operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inference, prompts
from ..sources import settings
from .derived import QUESTIONS, _quoted, questions
from .registry import query, table

OPTIONS = "coalesce(array_to_string(list_transform(list_zip(choice_label, choice_text), lambda x: x[1] || ') ' || x[2]), chr(10)), '')"


def prompt_sql(strategy: str) -> str:
    return f"WITH {QUESTIONS} SELECT question_id, replace(replace({_quoted(settings.template(strategy))}, '{{question}}', question), '{{options_block}}', {OPTIONS}) AS prompt FROM q"


@query(f"WITH {QUESTIONS} SELECT question_id, {OPTIONS} AS options_block FROM q")
def options_block(spark, sf_dir):
    return questions(spark, sf_dir).select("question_id", prompts.options_block(prompts.choices_or_null()).alias("options_block"))


@query(f"SELECT item_id, replace({_quoted(settings.PASSAGES)}, '{{passages_block}}', '[1] ' || text || chr(10) || '[2] item ' || item_id) AS block FROM benchmark")
def rag_block(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    return rows.select("item_id", prompts.passages_block(F.array("text", F.concat(F.lit("item "), F.col("item_id").cast("string")))).alias("block"))


def _prompt(spark, sf_dir, strategy):
    return questions(spark, sf_dir).select("question_id", prompts.prompt(F.col("question"), strategy, prompts.choices_or_null()).alias("prompt"))


@query(prompt_sql("da"))
def prompt_da(spark, sf_dir):
    return _prompt(spark, sf_dir, "da")


@query(prompt_sql("ras"))
def prompt_ras(spark, sf_dir):
    return _prompt(spark, sf_dir, "ras")


@query(prompt_sql("ctl"))
def prompt_ctl(spark, sf_dir):
    return _prompt(spark, sf_dir, "ctl")


@query(prompt_sql("da"))
def prompt_sc(spark, sf_dir):
    return _prompt(spark, sf_dir, "SC")


@query(f"WITH {QUESTIONS} SELECT question_id, replace({_quoted(settings.PASSAGES)}, '{{passages_block}}', '[1] ' || task) || chr(10) || chr(10) || prompt AS prompt FROM q JOIN ({prompt_sql('ctl').partition(QUESTIONS)[2].replace('FROM q', 'FROM q')}) USING (question_id)")
def prompt_rag(spark, sf_dir):
    return questions(spark, sf_dir).select("question_id", prompts.prompt(F.col("question"), "ctl", prompts.choices_or_null(), F.array("details.task")).alias("prompt"))


@query("SELECT question_id, prompt FROM (" + prompt_sql("da") + ") WHERE contains(prompt, '{question}') OR contains(prompt, '{options_block}') OR contains(prompt, '{passages_block}')")
def unfilled_slots(spark, sf_dir):
    return prompts.unfilled(_prompt(spark, sf_dir, "da"))


@query(f"WITH {QUESTIONS} SELECT question_id, CASE WHEN type LIKE 'mcq%' THEN answerKey ELSE answer END AS gold, CASE WHEN type LIKE 'mcq%' THEN 'mc' WHEN type = 'true_or_false' THEN 'tf' ELSE 'open' END AS category, len(choice_text) > 0 AS has_choices FROM q")
def gold(spark, sf_dir):
    return questions(spark, sf_dir).select("question_id", prompts.gold().alias("gold"), prompts.category().alias("category"), prompts.choices_or_null().isNotNull().alias("has_choices"))


def mock_sql(s: str) -> str:
    m = inference.MOCK[s]
    return f"CASE WHEN type LIKE 'mcq%' THEN replace({_quoted(m['mc'])}, '{{letter}}', CASE WHEN answerKey = '' THEN 'A' ELSE answerKey END) WHEN type = 'true_or_false' THEN {_quoted(m['tf'])} ELSE {_quoted(m['open'])} END"


@query(f"WITH {QUESTIONS} " + " UNION ALL ".join(f"SELECT question_id, '{s}' AS strategy, raw, len(string_split_regex(raw, '\\s+')) AS tokens FROM (SELECT question_id, {mock_sql(s)} AS raw FROM q)" for s in ("da", "ras", "ctl", "sc")))
def mock_responses(spark, sf_dir):
    parts = [inference.mocked(questions(spark, sf_dir), s, {"n": 1}).select("question_id", F.lit(s).alias("strategy"), F.get("samples", F.lit(0))["text"].alias("raw"), F.get("samples", F.lit(0))["tokens"].alias("tokens")) for s in ("da", "ras", "ctl", "sc")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])
