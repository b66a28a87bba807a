"""Queries of the audit, split and paper operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import shortened
from ..operators import audit, papers, profiles, ranking
from ..sources import json_files
from .derived import QUESTIONS, questions
from .registry import query, table

COLUMNS = ["text", "lang", "source"]
LANGS = ["de", "en", "es", "fr"]
SIZES = {"dev": 100, "holdout": 50}


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def value_counts(spark, sf_dir):
    return audit.value_counts(docs(spark, sf_dir), "lang")


@query("SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def value_counts_ascending(spark, sf_dir):
    return audit.value_counts(docs(spark, sf_dir), "source", ascending=True)


@query("SELECT lang, n, round(100.0 * n / sum(n) OVER (), 6) AS pct FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang)")
def value_share(spark, sf_dir):
    return audit.value_shares(docs(spark, sf_dir), "lang").withColumn("pct", F.round("pct", 6))


@query("SELECT source, " + ", ".join(f"count(*) FILTER (lang = '{x}') AS {x}" for x in LANGS) + " FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source")
def crosstab(spark, sf_dir):
    return audit.crosstab(docs(spark, sf_dir), "source", "lang", LANGS)


@query("""WITH c AS (SELECT coalesce(source, 'All') AS source, coalesce(lang, 'All') AS lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY CUBE (source, lang))
SELECT a.source, b.lang, coalesce(n, 0) AS n FROM (SELECT DISTINCT source FROM c) a CROSS JOIN (SELECT DISTINCT lang FROM c) b LEFT JOIN c USING (source, lang)""")
def crosstab_margins(spark, sf_dir):
    return audit.crosstab_margins(docs(spark, sf_dir), "source", "lang")


GRID = "g AS (SELECT a.source, b.lang, coalesce(n, 0) AS n FROM (SELECT DISTINCT source FROM documents) a CROSS JOIN (SELECT DISTINCT lang FROM documents) b LEFT JOIN (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) USING (source, lang))"


@query(f"WITH {GRID} SELECT * FROM g ORDER BY n, source, lang LIMIT 1")
def min_cell(spark, sf_dir):
    return audit.least_cell(docs(spark, sf_dir), "source", "lang")


STRATA = f"WITH {QUESTIONS}, s AS (SELECT domain || '_' || level AS stratum, count(*) AS n FROM q GROUP BY 1)"


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).withColumn("level", audit.nested("details.level")).withColumn("stratum", audit.stratum("domain", "level"))


@query(f"{STRATA} SELECT stratum, n FROM s ORDER BY n, stratum LIMIT 1")
def smallest_stratum(spark, sf_dir):
    return audit.least_stratum(strata(spark, sf_dir), "stratum")


@query(f"{STRATA} SELECT stratum, n FROM s WHERE n < 30")
def small_strata(spark, sf_dir):
    return audit.small_strata(strata(spark, sf_dir), "stratum", 30)


@query("SELECT unnest(['text', 'lang', 'source']) AS column_name, unnest([count(*) FILTER (text IS NULL OR text = ''), count(*) FILTER (lang IS NULL OR lang = ''), count(*) FILTER (source IS NULL OR source = '')]) AS n FROM documents")
def null_or_empty(spark, sf_dir):
    return audit.null_or_empty(docs(spark, sf_dir), COLUMNS)


@query("SELECT unnest(['text', 'lang', 'source']) AS column_name, unnest([count(DISTINCT text), count(DISTINCT lang), count(DISTINCT source)]) AS n FROM documents")
def distinct_counts(spark, sf_dir):
    return audit.distinct_counts(docs(spark, sf_dir), COLUMNS)


@query("SELECT lang, count(text) AS n, min(length(text)) AS min_len, max(length(text)) AS max_len, round(avg(length(text)), 6) AS mean_len, median(length(text)) AS median_len, round(stddev_samp(length(text)), 6) AS std_len FROM documents GROUP BY lang")
def length_stats(spark, sf_dir):
    return audit.length_stats(docs(spark, sf_dir), "text", "lang").withColumn("mean_len", F.round("mean_len", 6)).withColumn("std_len", F.round("std_len", 6))


@query("SELECT count(*) AS groups, min(n) AS min_n, max(n) AS max_n, round(avg(n), 6) AS mean_n, median(n) AS median_n FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)")
def two_level_stats(spark, sf_dir):
    return audit.per_group_stats(table(spark, sf_dir, "conversations"), "conv_id").withColumn("mean_n", F.round("mean_n", 6))


@query(f"""WITH {QUESTIONS}, a AS (SELECT domain, doc_id, level, question_id FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY list_position(['L1', 'L3', 'L5', 'L2', 'L4'], level), doc_id) AS k FROM q WHERE domain IN ('de', 'en', 'es', 'fr')) WHERE k = 1)
SELECT * FROM a UNION ALL (SELECT domain, doc_id, level, question_id FROM q WHERE domain = 'fr' AND level IN ('L5', 'L4', 'L3') AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY list_position(['L5', 'L4', 'L3'], level), doc_id LIMIT 1)""")
def first_per_group(spark, sf_dir):
    rows = strata(spark, sf_dir)
    return audit.examples_by_domain(rows, "domain", "level", "doc_id", ["question_id"], LANGS, ["L1", "L3", "L5", "L2", "L4"], "fr", ["L5", "L4", "L3"])


@query(f"WITH {QUESTIONS} SELECT type, min(doc_id) AS doc_id FROM q WHERE type <> 'filling' GROUP BY type ORDER BY 2 LIMIT 3")
def first_of_types(spark, sf_dir):
    return audit.first_of_types(questions(spark, sf_dir), "type", "doc_id", [], 3, "filling")


@query("SELECT 'text' AS column_name, doc_id, text AS value FROM documents WHERE text <> '' ORDER BY doc_id LIMIT 3")
def top_examples(spark, sf_dir):
    return audit.first_examples(docs(spark, sf_dir), "text", "doc_id")


@query(
    "SELECT column_name, 'string' AS dtype, n_distinct, n_empty, examples FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, count(*) FILTER ({c} IS NULL OR {c} = '') AS n_empty, (SELECT list({c} ORDER BY doc_id) FROM (SELECT doc_id, {c} FROM documents WHERE {c} <> '' ORDER BY doc_id LIMIT 3)) AS examples FROM documents" for c in COLUMNS)
    + ")"
)
def column_profile(spark, sf_dir):
    return audit.profile(docs(spark, sf_dir), COLUMNS, "doc_id")


@query(f"WITH {QUESTIONS} SELECT question_id, domain, level FROM q WHERE domain = 'en' AND level = 'L3'")
def two_predicates(spark, sf_dir):
    return strata(spark, sf_dir).where((F.col("domain") == "en") & (F.col("level") == "L3")).select("question_id", "domain", "level")


@query("SELECT doc_id, CASE WHEN length(text) > 150 THEN substring(text, 1, 150) || '...' ELSE text END AS shown FROM documents")
def display_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", shortened(F.col("text"), 150).alias("shown"))


# ---- splits ----


def _pass(name: str, source: str, size: int) -> str:
    """A sample of exact size in SQL: quotas by largest remainder, then rows by md5."""
    return f"""{name}_c AS (SELECT lang, count(*) AS n FROM {source} GROUP BY lang),
{name}_f AS (SELECT lang, n, CAST(floor(n * {size} / sum(n) OVER ()) AS BIGINT) AS base, n * {size} - CAST(floor(n * {size} / sum(n) OVER ()) AS BIGINT) * sum(n) OVER () AS part FROM {name}_c),
{name}_q AS (SELECT lang, base + CASE WHEN row_number() OVER (ORDER BY part DESC, lang) <= {size} - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM {name}_f),
{name} AS (SELECT doc_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS k FROM {source}) JOIN {name}_q USING (lang) WHERE k <= quota)"""


SPLIT = f"WITH {_pass('dev', 'documents', 100)}, left_over AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dev)), {_pass('hold', 'left_over', 50)}"


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.split(docs(spark, sf_dir).select("doc_id", "lang"), "doc_id", "lang", SIZES, "main_test")


@query(f"{SPLIT} SELECT doc_id, lang, CASE WHEN doc_id IN (SELECT doc_id FROM dev) THEN 'dev' WHEN doc_id IN (SELECT doc_id FROM hold) THEN 'holdout' ELSE 'main_test' END AS split FROM documents")
def split_exact(spark, sf_dir):
    return split_rows(spark, sf_dir)


@query(f"""{SPLIT}, rest AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dev) AND doc_id NOT IN (SELECT doc_id FROM hold)),
n AS (SELECT (SELECT count(*) FROM dev) AS dev, (SELECT count(*) FROM hold) AS holdout, (SELECT count(*) FROM rest) AS rest, (SELECT count(*) FROM documents) AS total)
SELECT unnest(['size_dev', 'size_holdout', 'size_main_test', 'disjoint_dev_holdout', 'disjoint_dev_main_test', 'disjoint_holdout_main_test', 'sum']) AS check_name,
  unnest([dev = 100, holdout = 50, rest = total - 150, (SELECT count(*) FROM dev JOIN hold USING (doc_id)) = 0, (SELECT count(*) FROM dev JOIN rest USING (doc_id)) = 0, (SELECT count(*) FROM hold JOIN rest USING (doc_id)) = 0, dev + holdout + rest = total]) AS ok FROM n""")
def split_checks(spark, sf_dir):
    parts = split_rows(spark, sf_dir)
    total = docs(spark, sf_dir).count()
    return ranking.checks(parts, "doc_id", SIZES | {"main_test": total - sum(SIZES.values())})


@query(f"""WITH {_pass('dev', 'documents', 100)}, p AS (SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM dev) GROUP BY lang),
x AS (SELECT lang, 100.0 * n / sum(n) OVER () AS pct FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)), y AS (SELECT lang, 100.0 * n / sum(n) OVER () AS pct FROM p)
SELECT lang, round(x.pct, 6) AS full_pct, round(coalesce(y.pct, 0), 6) AS part_pct, round(abs(x.pct - coalesce(y.pct, 0)), 6) AS diff, abs(x.pct - coalesce(y.pct, 0)) <= 2 AS ok FROM x LEFT JOIN y USING (lang)""")
def sample_drift(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "lang")
    out = audit.drift(rows, ranking.sample(rows, "doc_id", "lang", 100, 42), "lang")
    return out.select("lang", *[F.round(c, 6).alias(c) for c in ("full_pct", "part_pct", "diff")], "ok")


@query(f"""WITH {_pass('dev', 'documents', 100)}, d AS (SELECT lang, 100.0 * count(*) / (SELECT count(*) FROM documents) AS f, 100.0 * count(*) FILTER (doc_id IN (SELECT doc_id FROM dev)) / 100 AS p FROM documents GROUP BY lang)
SELECT round(max(abs(f - p)), 6) AS max_diff, max(abs(f - p)) <= 2 AS passed FROM d""")
def drift_gate(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "lang")
    return audit.drift_gate(audit.drift(rows, ranking.sample(rows, "doc_id", "lang", 100, 42), "lang")).withColumn("max_diff", F.round("max_diff", 6))


@query(f"""{STRATA}, f AS (SELECT (SELECT stratum FROM s ORDER BY n, stratum LIMIT 1) AS rarest, (SELECT min(n) FROM s) AS rarest_n, (SELECT sum(n) FROM s)::BIGINT AS total),
o AS (SELECT * FROM (VALUES (1, 0.1::DOUBLE, 0.05::DOUBLE), (2, 0.08, 0.04), (3, 0.12, 0.06)) t(option_no, dev_pct, holdout_pct)),
r AS (SELECT *, CAST(round_even(total * dev_pct, 0) AS BIGINT) AS dev, CAST(round_even(total * holdout_pct, 0) AS BIGINT) AS holdout, CAST(round_even(rarest_n * dev_pct, 0) AS BIGINT) AS rarest_dev, CAST(round_even(rarest_n * holdout_pct, 0) AS BIGINT) AS rarest_holdout FROM o, f)
SELECT *, total - dev - holdout AS main, rarest_n - rarest_dev - rarest_holdout AS rarest_main, least(rarest_dev, rarest_holdout, rarest_n - rarest_dev - rarest_holdout) >= 2 AS feasible FROM r""")
def size_feasibility(spark, sf_dir):
    return audit.split_feasibility(strata(spark, sf_dir), "stratum", [(0.10, 0.05), (0.08, 0.04), (0.12, 0.06)])


@query(f"WITH {QUESTIONS}, c AS (SELECT type, count(*) AS n FROM q GROUP BY type) SELECT sample_size, (SELECT type FROM c ORDER BY n, type LIMIT 1) AS rarest, CAST(round_even((SELECT min(n) FROM c) * sample_size / (SELECT sum(n) FROM c), 0) AS BIGINT) AS expected, round_even((SELECT min(n) FROM c) * sample_size / (SELECT sum(n) FROM c), 0) >= 5 AS feasible FROM (SELECT unnest([50, 75, 100])::BIGINT AS sample_size)")
def sample_feasibility(spark, sf_dir):
    return audit.sample_feasibility(questions(spark, sf_dir), "type", [50, 75, 100])


@query("SELECT n AS total, CAST(round_even(n * 0.1::DOUBLE, 0) AS BIGINT) AS dev, CAST(round_even(n * 0.05::DOUBLE, 0) AS BIGINT) AS holdout, n - CAST(round_even(n * 0.1::DOUBLE, 0) AS BIGINT) - CAST(round_even(n * 0.05::DOUBLE, 0) AS BIGINT) AS main_test FROM (SELECT count(*) AS n FROM documents)")
def recommended_sizes(spark, sf_dir):
    return audit.recommended_sizes(docs(spark, sf_dir))


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark, sf_dir):
    return ranking.seeded(docs(spark, sf_dir), "doc_id", 50, 42).select("doc_id")


# ---- papers ----


def paper_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested papers made of documents: one question each, annotated once or twice."""
    i = F.col("doc_id")
    none = F.array().cast("array<string>")

    def answer(k: int):
        m = F.pmod(i + k, F.lit(5))
        return F.struct(F.struct(
            (m == 0).alias("unanswerable"), F.when(m == 1, F.array("lang", "source")).otherwise(none).alias("extractive_spans"),
            F.when(m == 2, F.col("text")).when(m == 4, F.lit(" ")).otherwise("").alias("free_form_answer"), F.when(m == 3, F.pmod(i, F.lit(2)) == 0).alias("yes_no"), F.array("source").alias("evidence"),
        ).alias("answer"))

    answers = F.when(F.pmod(i, F.lit(3)) == 0, F.array(answer(0), answer(1))).otherwise(F.array(answer(0)))
    qas = F.array(F.struct(F.concat(F.lit("What of "), i.cast("string"), F.lit("?")).alias("question"), F.concat(F.lit("q"), i.cast("string")).alias("question_id"), answers.alias("answers")))
    paper = F.struct(F.concat(F.lit("Title "), i.cast("string")).alias("title"), qas.alias("qas"))
    return docs(spark, sf_dir).select(F.lit("train").alias("split"), F.concat(F.lit("p"), i.cast("string")).alias("paper_id"), paper.alias("paper"))


KINDS = "['unanswerable', 'extractive', 'free_form', 'yes_no', 'unknown']"
PAPER = f"""p AS (SELECT doc_id, lang, source, text, CASE WHEN doc_id % 5 = 2 AND trim(coalesce(text, ''), E' \\t\\n\\r') = '' THEN 'unknown' ELSE {KINDS}[doc_id % 5 + 1] END AS t1,
  CASE WHEN (doc_id + 1) % 5 = 2 AND trim(coalesce(text, ''), E' \\t\\n\\r') = '' THEN 'unknown' ELSE {KINDS}[(doc_id + 1) % 5 + 1] END AS t2, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS m FROM documents)"""


@query(f"""WITH {PAPER} SELECT 'p' || doc_id AS paper_id, 'Title ' || doc_id AS paper_title, 'q' || doc_id AS question_id, 'What of ' || doc_id || '?' AS question, t1 AS answer_type,
  CASE t1 WHEN 'extractive' THEN lang || ' | ' || source WHEN 'free_form' THEN text WHEN 'yes_no' THEN CASE WHEN doc_id % 2 = 0 THEN 'Yes' ELSE 'No' END WHEN 'unanswerable' THEN '[unanswerable]' ELSE '' END AS answer_text,
  [source] AS evidence, m AS num_annotators, CASE WHEN m = 2 THEN [t1, t2] ELSE [t1] END AS all_types, m = 2 AND t1 <> t2 AS mixed, 'train' AS split FROM p""")
def paper_questions(spark, sf_dir):
    return papers.questions(paper_rows(spark, sf_dir))


@query(f"WITH {PAPER} SELECT t1 AS answer_type, count(*) AS n FROM p GROUP BY t1")
def answer_type(spark, sf_dir):
    return audit.value_counts(papers.questions(paper_rows(spark, sf_dir)), "answer_type")


@query(f"WITH {PAPER} SELECT count(*) AS n, count(*) FILTER (m = 2 AND t1 <> t2) AS mixed, round(100.0 * count(*) FILTER (m = 2 AND t1 <> t2) / count(*), 6) AS pct FROM p")
def mixed_types(spark, sf_dir):
    return papers.mixed_share(papers.questions(paper_rows(spark, sf_dir))).withColumn("pct", F.round("pct", 6))


@query("SELECT 'train' AS split, count(*) AS papers, count(*) AS questions FROM documents")
def paper_totals(spark, sf_dir):
    return papers.totals(paper_rows(spark, sf_dir))


@query("""SELECT unnest(['split', 'paper_id', 'paper.title', 'paper.qas', 'paper.qas[].question', 'paper.qas[].question_id', 'paper.qas[].answers', 'paper.qas[].answers[].answer.unanswerable', 'paper.qas[].answers[].answer.extractive_spans',
  'paper.qas[].answers[].answer.extractive_spans[]', 'paper.qas[].answers[].answer.free_form_answer', 'paper.qas[].answers[].answer.yes_no', 'paper.qas[].answers[].answer.evidence', 'paper.qas[].answers[].answer.evidence[]']) AS path,
  unnest(['string', 'string', 'string', 'array', 'string', 'string', 'array', 'boolean', 'array', 'string', 'string', 'boolean', 'array', 'string']) AS dtype""")
def nested_fields(spark, sf_dir):
    """The nested structure of a paper: a description of the schema, which no data decides."""
    return audit.fields(paper_rows(spark, sf_dir))


@query("SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def table_sink(spark, sf_dir):
    """A table written as Parquet, written over, and read back."""
    path = json_files.work_folder(spark, "table")
    for rows in (docs(spark, sf_dir).limit(1), docs(spark, sf_dir)):
        json_files.write_table(rows, path)
    return spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT CAST(ts AS DATE) AS day, column_name, count(*) AS n, count(*) FILTER (v IS NULL) AS n_empty, min(v) AS least, max(v) AS greatest, true AS within, 0::BIGINT AS new_files
FROM (SELECT ts, unnest(['user_id', 'event_type', 'props']) AS column_name, nullif(unnest([CAST(user_id AS VARCHAR), event_type, props]), '') AS v FROM events) GROUP BY ALL""")
def daily_profile(spark, sf_dir):
    """Daily profiles of the events from stored sketches, whether each distinct count is within the bound of the exact one, and how many files a
    second refresh reads."""
    store, columns = json_files.work_folder(spark, "profiles"), ["user_id", "event_type", "props"]
    day = F.col("ts").cast("date")
    profiles.refresh(spark, f"{sf_dir}/events.parquet", store, columns, day)
    new = len(profiles.refresh(spark, f"{sf_dir}/events.parquet", store, columns, day))
    exact = table(spark, sf_dir, "events").select(day.alias("day"), *columns).groupBy("day").agg(*[F.count_distinct(F.nullif(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns])
    exact = exact.unpivot(["day"], columns, "column_name", "exact")
    found = profiles.merged(profiles.stored(spark, store), ["day"]).alias("m").join(exact.alias("e"), F.col("m.day").eqNullSafe(F.col("e.day")) & (F.col("m.column_name") == F.col("e.column_name")))
    within = F.abs(F.col("n_distinct") - F.col("exact")) <= profiles.BOUND * F.col("exact")
    return found.select("m.day", "m.column_name", "n", "n_empty", "least", "greatest", within.alias("within"), F.lit(new).cast("long").alias("new_files"))
