"""Question records, responses and samples derived from the tables by id arithmetic, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

TYPES = ["mcq-4-choices", "mcq-2-choices", "true_or_false", "open-ended-qa", "relation_extraction", "filling"]


def pick(values: list[str], index: Column) -> Column:
    return F.get(F.lit(values), index.cast("int"))


def pick_sql(values: list[str], index: str) -> str:
    return f"([{', '.join(_quoted(v) for v in values)}])[{index} + 1]"


def _quoted(v: str) -> str:
    if not any(c in v for c in "\n\t"):
        return "'" + v.replace("'", "''") + "'"
    return "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's whole text as a question; type, level and choices by its id."""
    i = F.col("doc_id")
    n = i.cast("string")
    mod = F.pmod(i, F.lit(6))
    none = F.array().cast("array<string>")
    text = F.when(mod == 0, F.array(*[F.concat(F.lit(x), n) for x in ("alpha ", "beta ", "gamma ", "delta ")])).when(mod == 1, F.array(F.concat(F.lit("likely "), n), F.concat(F.lit("unlikely "), n))).otherwise(none)
    label = F.when(F.pmod(i, F.lit(12)) == 0, F.lit(["A", "B", "C", "D"])).when(mod == 1, F.lit(["A", "B"])).otherwise(none)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.format_string("ske-docs-%05d", i).alias("question_id"), F.coalesce("text", F.lit("")).alias("question"), pick(TYPES, mod).alias("type"), F.col("lang").alias("domain"),
        F.struct(F.concat(F.lit("L"), (F.pmod(i, F.lit(5)) + 1).cast("string")).alias("level"), F.col("source").alias("task"), F.lit("").alias("subtask"), F.col("source")).alias("details"),
        F.when(mod == 0, pick(["A", "B", "C", "D"], F.pmod(i, F.lit(4)))).when(mod == 1, pick(["A", "B"], F.pmod(i, F.lit(2)))).otherwise("").alias("answerKey"),
        F.struct(text.alias("text"), label.alias("label")).alias("choices"),
        F.when(mod < 2, "").when(mod == 2, pick(["Yes", "No"], F.pmod(i, F.lit(2)))).otherwise(F.concat("lang", F.lit(" "), "source")).alias("answer"),
    )


QUESTIONS = f"""q AS (SELECT doc_id, 'ske-docs-' || printf('%05d', doc_id) AS question_id, coalesce(text, '') AS question, {pick_sql(TYPES, '(doc_id % 6)')} AS type, lang AS domain,
  'L' || (doc_id % 5 + 1) AS level, source AS task,
  CASE doc_id % 6 WHEN 0 THEN {pick_sql(list('ABCD'), '(doc_id % 4)')} WHEN 1 THEN {pick_sql(list('AB'), '(doc_id % 2)')} ELSE '' END AS answerKey,
  CASE doc_id % 6 WHEN 0 THEN ['alpha ' || doc_id, 'beta ' || doc_id, 'gamma ' || doc_id, 'delta ' || doc_id] WHEN 1 THEN ['likely ' || doc_id, 'unlikely ' || doc_id] ELSE CAST([] AS VARCHAR[]) END AS choice_text,
  CASE doc_id % 6 WHEN 0 THEN ['A', 'B', 'C', 'D'] WHEN 1 THEN ['A', 'B'] ELSE CAST([] AS VARCHAR[]) END AS choice_label,
  CASE WHEN doc_id % 6 < 2 THEN '' WHEN doc_id % 6 = 2 THEN {pick_sql(['Yes', 'No'], '(doc_id % 2)')} ELSE lang || ' ' || source END AS answer
FROM documents)"""

#: Frames of responses around a text, by id; {} is the text.
FRAMES = [
    "ANSWER: B\nJUSTIFICATION: {}",
    "<think>{}</think>\nANSWER: Yes, it is\nRATIONALE: see [1, 3] and Passage 2",
    "Sure, here it is.\n**ANSWER:** c) third\n**JUSTIFICATION:** as Source 4 says (7) [12]\n{}",
    "I cannot answer this. {}",
    "```text\nanswer: The answer is D\nConfidence: HIGH\n``` {}",
    "答案：正确\n理由：因为有足够的证据支持这个说法\n{}",
    "{}",
    "   ",
    "# Key Reasoning: {}\nUNCERTAINTY: none\nANSWER: first\nANSWER: Incorrect END",
]


def framed(text: Column, index: Column, frames: list[str]) -> Column:
    out = None
    for k, frame in enumerate(frames):
        before, hole, after = frame.partition("{}")
        value = F.concat(F.lit(before), text, F.lit(after)) if hole else F.lit(before)
        out = F.when(index == k, value) if out is None else out.when(index == k, value)
    return out


def framed_sql(text: str, index: str, frames: list[str]) -> str:
    parts = []
    for k, frame in enumerate(frames):
        before, hole, after = frame.partition("{}")
        parts.append(f"WHEN {k} THEN " + (f"{_quoted(before)} || {text} || {_quoted(after)}" if hole else _quoted(before)))
    return f"CASE {index} {' '.join(parts)} END"


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with a raw response in one of the frames and a strategy."""
    i = F.col("doc_id")
    return questions(spark, sf_dir).withColumn("raw_response", framed(F.col("question"), F.pmod(i, F.lit(len(FRAMES))), FRAMES)).withColumn("strategy", pick(["da", "ras", "ctl", "sc"], F.pmod(i, F.lit(4))))


RESPONSES = f"{QUESTIONS}, r AS (SELECT *, {framed_sql('question', f'(doc_id % {len(FRAMES)})', FRAMES)} AS raw_response, {pick_sql(['da', 'ras', 'ctl', 'sc'], '(doc_id % 4)')} AS strategy FROM q)"
