"""Answers brought to a common form, and citations, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocabulary as V
from .likeness import likeness
from .text import S, blank_to_null, extract, strip

#: An end of a run of ASCII letters, digits and underscores.
ASCII_EDGE = r"(?-i:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def choice_labels(choices: Column) -> Column:
    """Labels of the choices; A, B, ... where there are fewer labels than texts."""
    n = F.size(choices["text"])
    made = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.char(i + 65))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(choices["label"]) < n, made).otherwise(choices["label"])


def stated_letter(text: Column, labels: Column, ascii_words: bool = False) -> Column:
    """A choice's letter by the first of four patterns that names a valid label, or null. text: stripped."""
    edge = ASCII_EDGE if ascii_words else r"\b"
    patterns = (
        rf"(?Ud)\A{S}*\(?([A-Fa-f])\)?{S}*\z",
        rf"(?Uid)\A{S}*\(?([A-F])\)?[).:\s\x1c-\x1f]+[^\s\x1c-\x1f]",
        rf"(?Uid)(?:answer|option|choice){S}+(?:is{S}+)?[(\[]?([A-F])[)\]]?{edge}",
        rf"(?Ud){edge}([A-Fa-f]){S}*+\.?{S}*+\z",
    )
    letters = F.array(*[F.upper(F.regexp_extract(text, p, 1)) for p in patterns])  # '' where a pattern misses
    valid = F.transform(labels, lambda x: F.upper(x))
    return F.get(F.array_intersect(letters, F.array_remove(valid, "")), F.lit(0))


def sole_letter(text: Column, labels: Column) -> Column:
    """The one valid label among the text's characters, in either case, or null if there are none or several."""
    plain = F.translate(text, "ıſ", "IS")  # the characters whose capitals are another letter's
    valid = F.filter(F.array_distinct(F.transform(labels, lambda x: F.upper(x))), lambda x: F.length(x) == 1)
    found = F.filter(valid, lambda x: F.contains(plain, x) | F.contains(plain, F.lower(x)))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


@F.pandas_udf(T.StringType())
def closest_choice(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The label of the choice whose text is most like the answer, if enough so; null answers are passed by."""

    def one(answer, texts, labels):
        if answer is None or texts is None:
            return None
        found = [(likeness(answer.lower(), (t or "").lower(), V.FUZZY_SHARE), -k) for k, (t, _) in enumerate(zip(texts, labels))]
        best, k = max(found, default=(0.0, 0))
        return labels[-k].upper() if best >= V.FUZZY_SHARE else None

    for answers, texts, labels in parts:
        yield pd.Series([one(*x) for x in zip(answers, texts, labels)], dtype="object")


def truth(answer: Column, ascii_words: bool = False) -> Column:
    """Yes or No, or null."""
    edge = ASCII_EDGE if ascii_words else r"\b"
    text = F.lower(strip(answer))
    words = F.create_map(*[F.lit(x) for pair in V.TRUTH_WORDS.items() for x in pair])
    word = extract(text, rf"(?Uid){edge}({'|'.join(V.TRUTH_WORDS)}){edge}")
    return F.coalesce(F.try_element_at(words, text), F.when(text.startswith("yes"), "Yes").when(text.startswith("no"), "No"), F.try_element_at(words, F.lower(word)))


def open_answer(answer: Column) -> Column:
    text = strip(answer)
    return F.when(text.endswith("END"), strip(F.substring(text, F.lit(1), F.length(text) - 3))).otherwise(text)


def vote_text(raw: Column) -> Column:
    """An open answer as it is counted: lower case, no punctuation at the end, single spaces; null if nothing is left."""
    return blank_to_null(F.regexp_replace(F.rtrim(F.lower(strip(raw)), F.lit(".!?,;:")), rf"(?U){S}+", " "))


def with_normal(df: DataFrame, raw: str, kind: str, choices: str, out: str, fuzzy: bool = True, voting: bool = False, ascii_words: bool = False) -> DataFrame:
    """Adds the normal form of an answer by question type, null for blank answers; with `voting`, open answers as they are counted.
    ascii_words: a word ends before any letter beyond ASCII, as in the queries' SQL; else at the ends of Unicode's words.

    Steps are columns of their own, so that no pattern is evaluated twice. The likeness step runs in Python; rows that need it
    not reach it as nulls.
    """
    is_choice = F.col(kind).isin(V.CHOICE_TYPES) & F.col(choices).isNotNull()
    df = df.withColumn("_n_text", F.nullif(strip(F.col(raw)), F.lit("")))
    df = df.withColumn("_n_is", F.coalesce(is_choice, F.lit(False))).withColumn("_n_labels", F.when(F.col("_n_is"), choice_labels(F.col(choices))))
    text, labels = F.when(F.col("_n_is"), F.col("_n_text")), F.col("_n_labels")
    df = df.withColumn("_n_letter", stated_letter(text, labels, ascii_words))
    letter = F.col("_n_letter")
    steps = [letter]
    if fuzzy:
        rest = letter.isNull() & text.isNotNull()
        df = df.withColumn("_n_close", closest_choice(F.when(rest, text), F.when(rest, F.col(choices)["text"]), F.when(rest, labels)))
        steps.append(F.col("_n_close"))
    steps.append(F.when(letter.isNull(), sole_letter(text, labels)))
    open_form = vote_text(F.col("_n_text")) if voting else open_answer(F.col("_n_text"))
    normal = F.when(F.col("_n_is"), F.coalesce(*steps)).when(F.col(kind) == V.TRUTH_TYPE, truth(F.col("_n_text"), ascii_words)).otherwise(open_form)
    return df.withColumn(out, normal).drop("_n_text", "_n_is", "_n_labels", "_n_letter", "_n_close")


def citations(text: Column, last: int = V.LAST_PASSAGE) -> Column:
    """Sorted distinct passage numbers from 1 to `last`: numbers in brackets (lists of them too) and parentheses, and after
    the words of V.CITED. A bracket counts only if it is a list of numbers from end to end."""
    every = lambda p: F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?Ud){p}"), F.lit(1)))
    lists = F.transform(every(rf"\[(\d(?:[\d\s\x1c-\x1f,]*+(?<=\d))?)\]"), lambda x: F.transform(F.array_distinct(F.split(x, ",")), strip))
    listed = F.flatten(F.filter(lists, lambda x: F.forall(x, lambda y: y.rlike(r"(?U)\A\d++\z"))))
    found = F.concat(listed, every(r"\((\d++)\)"), *[every(rf"{word}{S}++(\d++)") for word in V.CITED])
    numbers = F.transform(F.array_distinct(found), lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.between(1, last))))
