"""Backends that answer prompts, and the assembly of output records."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import Protocol

from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions import vocabulary as V
from ..functions.text import replaced
from . import prompts, voting

OUTPUT = ("question_id", "question", "question_type", "domain", "details", "gold_answer", "choices", "model", "strategy", "prompt", "raw_response", "parsed", "sc_result", "prompt_tokens", "completion_tokens", "timestamp")
MOCK_PROMPT_TOKENS = 50
#: Our wording by strategy and category; the labels and the slot {letter} are fixed.
MOCK = {
    "da": {
        "mc": "ANSWER: {letter}\nJUSTIFICATION: Stand-in reason, drawn from the key.",
        "tf": "ANSWER: No\nJUSTIFICATION: Stand-in reason, the same for all claims.",
        "open": "ANSWER: Sample reply one.\nJUSTIFICATION: No model was asked.",
    },
    "ras": {
        "mc": "ANSWER: {letter}\nKEY REASONING: Made up for a dry run.\nUNCERTAINTY: Total, as nothing was read.\nCONFIDENCE: high",
        "tf": "ANSWER: No\nKEY REASONING: Made up for a dry run.\nUNCERTAINTY: Total, as nothing was read.\nCONFIDENCE: high",
        "open": "ANSWER: Sample reply two.\nKEY REASONING: Filler between two labels.\nUNCERTAINTY: Not measured here.\nCONFIDENCE: medium",
    },
    "ctl": {
        "mc": "ANSWER: {letter}\nRATIONALE: Copied out of the answer key.",
        "tf": "ANSWER: No\nRATIONALE: Fixed text for every claim.",
        "open": "ANSWER: Sample reply three.\nRATIONALE: Fixed text for every open task.",
    },
    "sc": {
        "mc": "ANSWER: {letter}\nJUSTIFICATION: One ballot out of several.",
        "tf": "ANSWER: No\nJUSTIFICATION: One ballot out of several.",
        "open": "ANSWER: Sample reply four.\nJUSTIFICATION: One ballot out of several.",
    },
}


def sampling(strategy: str, inference: dict) -> dict:
    """Settings of a strategy's generation: greedy, or warm with several samples."""
    many = strategy == "sc"
    return {
        "temperature": inference.get("temperature_sc", 0.7) if many else inference.get("temperature_greedy", 0.0),
        "n": inference.get("sc_samples", V.SAMPLES) if many else 1, "max_tokens": inference.get("max_tokens", 1024), "seed": inference.get("seed", 42),
    }


class Backend(Protocol):
    """Made once per Python worker by a picklable factory."""

    def generate(self, prompts: list[str], settings: dict) -> list[tuple[int, list[tuple[str, int]]]]:
        """Per prompt: its tokens, and per sample the text and its tokens."""

    def close(self) -> None:
        """Gives back what the backend holds; called before a worker makes another one. May be left out."""


class Scripted:
    """A backend that needs no model: a prompt's reply is taken by its length; a token is a character."""

    def __init__(self, replies: tuple[str, ...]):
        self.replies = replies

    @staticmethod
    def of(replies: list[str]) -> Callable[[], Scripted]:
        from functools import partial

        return partial(Scripted, tuple(replies))

    def generate(self, prompts: list[str], settings: dict) -> list[tuple[int, list[tuple[str, int]]]]:
        said = [self.replies[len(p) % len(self.replies)] for p in prompts]
        return [(len(p), [(t, len(t))] * settings["n"]) for p, t in zip(prompts, said)]


_held: dict = {}


def held(factory: Callable[[], Backend]) -> Backend:
    """The worker's backend of a factory; it stays for later tasks, and another factory's one is released first."""
    import pickle

    key = pickle.dumps(factory)
    if key not in _held:
        for other in _held.values():
            getattr(other, "close", lambda: None)()
        _held.clear()
        _held[key] = factory()
    return _held[key]


def generated(df: DataFrame, factory: Callable[[], Backend], settings: dict, batch: int | None = None, profile: ResourceProfile | None = None, prompt: Column | None = None) -> DataFrame:
    """Adds `prompt_tokens` and `samples` (array<struct<text, tokens>>) by a backend, batch by batch.

    batch: prompts in a batch at most; prompts are then dealt out by ranges of their length and sorted, so that a batch holds prompts of like
    length and no padding is wasted. profile: what a task of this stage needs (an accelerator, memory), on clusters that give
    resources by stage; the stages around it run on what they had. prompt: the prompts, where the frame doesn't hold them; they
    are then made after the rows are dealt out, so that texts that prompts repeat are shuffled once.
    """
    if batch:
        df = df.withColumn("_length", F.length("prompt" if prompt is None else prompt)).repartitionByRange("_length").sortWithinPartitions("_length").drop("_length")
    if prompt is not None:
        df = df.withColumn("prompt", prompt)
    names = df.columns
    at = names.index("prompt")

    def run(batches: Iterator):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("text", pa.string()), ("tokens", pa.int64())]))
        for whole in batches:
            for k in range(0, whole.num_rows, batch or max(1, whole.num_rows)):
                b = whole.slice(k, batch) if batch else whole
                out = held(factory).generate(b.column(at).to_pylist(), settings)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([n for n, _ in out], pa.int64()), pa.array([[{"text": t, "tokens": n} for t, n in s] for _, s in out], kind)], [*names, "prompt_tokens", "samples"])

    from pyspark.sql import types as T

    sample = T.StructType([T.StructField("text", T.StringType()), T.StructField("tokens", T.LongType())])
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("prompt_tokens", T.LongType()), T.StructField("samples", T.ArrayType(sample))]), profile=profile)


def mock_text(strategy: str, kind: str = "type", key: str = "answerKey"):
    """A formulaic response; a choice question gets its key, or A without one."""
    of = {c: F.lit(t) for c, t in MOCK[strategy].items()}
    letter = F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit("A"))
    category = prompts.category(kind)
    return F.when(category == "mc", replaced(of["mc"], [("{letter}", letter)])).when(category == "tf", of["tf"]).otherwise(of["open"])


def mocked(df: DataFrame, strategy: str, settings: dict) -> DataFrame:
    """Adds `prompt_tokens` and `samples` without a model."""
    text = mock_text(strategy)
    one = F.struct(text.alias("text"), F.size(F.split(text, r"\s+")).cast("long").alias("tokens"))
    return df.withColumn("prompt_tokens", F.lit(MOCK_PROMPT_TOKENS).cast("long")).withColumn("samples", F.array_repeat(one, settings["n"]))


def records(df: DataFrame, model: str, strategy: str, min_valid: int = V.QUORUM, fuzzy: bool = True, now: str | None = None, ascii_words: bool = False) -> DataFrame:
    """Output records from questions with prompt, prompt_tokens and samples; repeated samples are voted on and the first one's
    parse stands for the record."""
    now = now or datetime.now(UTC).isoformat(timespec="seconds")
    base = df.withColumn("type", F.coalesce("type", F.lit("open-ended-qa"))).withColumn("gold_answer", prompts.gold()).withColumn("choices", prompts.choices_or_null())
    base = base.withColumn("strategy", F.lit(strategy)).withColumn("model", F.lit(model)).withColumn("timestamp", F.lit(now))
    first = base.withColumn("raw_response", F.coalesce(F.get("samples", F.lit(0))["text"], F.lit("")))
    first = parsing.parse(first, fuzzy=fuzzy, ascii_words=ascii_words).withColumn("completion_tokens", F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["tokens"], F.lit(0))))
    if strategy == "sc":
        each = base.select("question_id", "type", "choices", "strategy", F.posexplode("samples").alias("sample_ix", "s")).withColumn("raw_response", F.col("s.text"))
        each = parsing.parse(each, fuzzy=fuzzy, ascii_words=ascii_words)
        sample = each.select("question_id", "sample_ix", "parsed")
        voted = voting.votes(each.select("question_id", "type", "choices", "sample_ix", "parsed.answer", "parsed.answer_normalized", "parsed.parse_success", "parsed.refusal"), fuzzy=fuzzy, ascii_words=ascii_words)
        result = voting.majority(voted, ["question_id"], min_valid)
        per = sample.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("sample_ix", "parsed"))).alias("p")).select("question_id", F.transform("p", lambda x: x["parsed"]).alias("per_sample"))
        packed = result.join(per, "question_id").select("question_id", F.struct(*voting.RESULT, "per_sample").alias("sc_result"))
        first = first.join(packed, "question_id", "left")
    else:
        first = first.withColumn("sc_result", F.lit(None).cast("string"))
    return first.withColumnRenamed("type", "question_type").select(*OUTPUT)
