"""Prompts from questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.normalise import choice_labels
from ..functions.text import replaced
from ..sources import settings

SLOTS = ("{question}", "{options_block}", "{passages_block}")


def gold(kind: str = "type", key: str = "answerKey", answer: str = "answer") -> Column:
    return F.coalesce(F.when(F.col(kind).isin(V.CHOICE_TYPES), F.col(key)).otherwise(F.col(answer)), F.lit(""))


def choices_or_null(choices: str = "choices") -> Column:
    return F.when(F.size(F.col(choices)["text"]) > 0, F.col(choices))


def category(kind: str = "type") -> Column:
    return F.when(F.col(kind).isin(V.CHOICE_TYPES), "mc").when(F.col(kind) == V.TRUTH_TYPE, "tf").otherwise("open")


def options_block(choices: Column) -> Column:
    """'A) text' lines; '' without choices. Choices and labels pair up to the shorter list."""
    lines = F.zip_with(choice_labels(choices), choices["text"], lambda label, text: F.concat(label, F.lit(") "), text))
    return F.coalesce(F.when(F.size(choices["text"]) > 0, F.array_join(lines, "\n")), F.lit(""))


def passages_block(passages: Column, folder: str | None = None) -> Column:
    """Numbered passages in their frame; '' without passages."""
    from pathlib import Path

    frame = Path(folder, "rag_context.txt").read_text(encoding="utf-8") if folder else settings.PASSAGES
    lines = F.array_join(F.transform(passages, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")
    return F.when(F.size(passages) > 0, F.replace(F.lit(frame), F.lit("{passages_block}"), lines)).otherwise("")


def prompt(question: Column, strategy: str, choices: Column, passages: Column | None = None, folder: str | None = None) -> Column:
    """The template with the question put in first and then the options, so slots in a question's text are filled too."""
    text = replaced(F.lit(settings.template(strategy, folder)), [("{question}", F.coalesce(question, F.lit(""))), ("{options_block}", options_block(choices))])
    if passages is None:
        return text
    block = passages_block(passages, folder)
    return F.when(block != "", F.concat(block, F.lit("\n\n"), text)).otherwise(text)


def unfilled(df: DataFrame, column: str = "prompt") -> DataFrame:
    """Rows whose prompt still has a slot."""
    found = F.lit(False)
    for s in SLOTS:
        found = found | F.col(column).contains(s)
    return df.where(found)
