"""Free-text responses read into fields, as column expressions; the order of the steps is part of the meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import normalise
from . import vocabulary as V
from .text import SPACES, S, any_of, blank_to_null, extract, strip

EVERY = any_of(V.LABELS)
THINK = r"(?s)<\|?think\|?>.*?<\|?/?think\|?>"


def without_thinking(raw: Column) -> Column:
    """The response without its closed think blocks, stripped. Texts without the word are not searched."""
    return strip(F.when(F.contains(raw, F.lit("think")), F.regexp_replace(raw, THINK, "")).otherwise(raw))


def thinking_removed(raw: Column) -> Column:
    return F.contains(raw, F.lit("think")) & (F.regexp_replace(raw, THINK, "") != raw)


def refuses(text: Column) -> Column:
    return text.rlike("(?Uid)" + "|".join(V.REFUSALS).replace(r"\s", S))


def without_preamble(text: Column) -> Column:
    """The text from the first label that starts a line on; all of it where there is none. White space before the label
    counts from the first line end in its run, which is found by going through each run once."""
    found = extract(text, rf"(?Uids)(?:\A|(?<!{S})[{S}&&[^\n]]*+(?=\n))({S}*+\*{{0,3}}(?:{EVERY})\*{{0,3}}{S}*+:.*+)\z")
    return F.coalesce(F.ltrim(found, F.lit("\n")), text)


def without_markup(text: Column) -> Column:
    """Code fences, emphasis and code marks around labels, and header marks removed, in this order; texts without any such mark stay as they are."""
    clean = text
    for pattern, by in ((r"(?Ud)```\w*\n?|```", ""), (rf"(?Uid)\*{{1,3}}({EVERY})\*{{1,3}}", "$1"), (rf"(?Uid)`({EVERY})`", "$1"), (rf"(?Umd)^#{{1,4}}{S}*", "")):
        clean = F.regexp_replace(clean, pattern, by)
    return F.when(text.rlike("[`*#]"), clean).otherwise(text)


def labelled(text: Column, labels: list[str]) -> Column:
    """array<struct<k, v>> of label and value, in text order; a value ends at the next of these labels."""
    one = any_of(labels)
    keys = F.regexp_extract_all(text, F.lit(rf"(?Uid)({one}){S}*+:"), F.lit(1))
    values = F.split(text, rf"(?Uid)(?:{one}){S}*+:{S}*+", -1)  # the first part comes before any label
    pairs = F.zip_with(F.concat(F.array(F.lit("")), keys), values, lambda k, v: F.struct(F.upper(k).alias("k"), strip(v).alias("v")))
    return F.slice(pairs, 2, 2**31 - 1)


def last_value(pairs: Column, label: str) -> Column:
    """The value of the label's last occurrence, null without one."""
    return F.try_element_at(F.filter(pairs, lambda x: x["k"] == label), F.lit(-1))["v"]


def chinese(raw: Column) -> Column:
    """Whether over three tenths of the characters that aren't white space are Chinese."""
    dense = F.translate(raw, SPACES, "")
    return F.length(F.regexp_replace(raw, "[^一-鿿]++", "")) > V.CHINESE_SHARE * F.length(dense)


def chinese_value(text: Column, label: str) -> Column:
    line = rf"(?Ud)(?:%s){S}*[:：]{S}*(.+?)(?:\n|\z)"
    if label == "ANSWER":
        return strip(extract(text, line % "|".join(V.CHINESE_ANSWER)))
    if label == "CONFIDENCE":
        return strip(extract(text, line % "|".join(V.CHINESE_CONFIDENCE)))
    if label == "JUSTIFICATION":
        stop = "|".join([*V.CHINESE_ANSWER, *V.CHINESE_REASON, *V.CHINESE_CONFIDENCE, *V.CHINESE_OTHER])
        return strip(extract(text, rf"(?Uds)(?:{'|'.join(V.CHINESE_REASON)}){S}*[:：]{S}*(.+?)(?=(?:{stop}){S}*[:：]|\z)"))
    return F.lit(None).cast("string")


def first_line(text: Column) -> Column:
    """The first line that isn't blank, stripped, or null. A stripped text begins with it."""
    return blank_to_null(strip(F.substring_index(strip(text), "\n", 1)))


def parse(df: DataFrame, raw: str = "raw_response", strategy: str = "strategy", kind: str = "type", choices: str = "choices", mode: str = "closed_book", fuzzy: bool = True, ascii_words: bool = False) -> DataFrame:
    """Adds `parsed`, a struct of answer, answer_normalized, justification, rationale, key_reasoning, uncertainty,
    confidence, citations, parse_success, parse_errors, raw_response, refusal and think_block_removed.

    Each step's text is a column of its own, so that no pattern is evaluated twice.
    """
    given = F.coalesce(F.col(raw), F.lit(""))
    df = df.withColumn("_there", strip(given) != "").withColumn("_open", F.when(F.col("_there"), without_thinking(given)))
    df = df.withColumn("_refusal", F.coalesce(refuses(F.col("_open")), F.lit(False))).withColumn("_cut", without_preamble(F.col("_open")))
    df = df.withColumn("_text", without_markup(F.col("_cut")))
    pairs = None
    for name in dict.fromkeys(V.STRATEGIES):
        here = labelled(F.col("_text"), V.STRATEGY_LABELS[name])
        pairs = F.when(F.col(strategy) == name, here) if pairs is None else pairs.when(F.col(strategy) == name, here)
    df = df.withColumn("_pairs", pairs.otherwise(labelled(F.col("_text"), V.STRATEGY_LABELS["da"])))
    df = df.withColumn("_zh", ~F.exists("_pairs", lambda x: x["k"] == "ANSWER") & chinese(given))
    for k, label in enumerate(V.LABELS):
        df = df.withColumn(f"_f{k}", F.when(F.col("_zh"), chinese_value(F.col("_text"), label)).otherwise(last_value(F.col("_pairs"), label)))
    field = {label: F.col(f"_f{k}") for k, label in enumerate(V.LABELS)}
    df = df.withColumn("_found", blank_to_null(field["ANSWER"]))
    df = df.withColumn("_fallback", F.when(F.col("_there") & F.col("_found").isNull() & ~F.col("_refusal"), first_line(F.col("_text"))))
    df = df.withColumn("_answer", F.coalesce("_found", "_fallback"))
    df = normalise.with_normal(df, "_answer", kind, choices, "_normal", fuzzy, ascii_words=ascii_words)
    found, refusal, normal, reply = F.col("_found"), F.col("_refusal"), F.col("_normal"), F.col("_answer")
    error = (
        F.when(~F.col("_there"), "empty_response")
        .when(found.isNotNull() & normal.isNull() & F.col(kind).isin(V.CHOICE_TYPES), "mc_normalization_failed")
        .when(found.isNull() & F.col("_fallback").isNotNull(), "answer_field_missing_used_fallback")
        .when(found.isNull() & ~refusal, "answer_field_missing")
    )
    open_kind = F.col(kind).isin(V.OPEN_TYPES)
    fields_text = F.array_join(F.filter(F.array(*field.values()), lambda x: x != ""), " ")
    cited = F.when(F.col("_there"), normalise.citations(fields_text)) if mode == "rag" else None
    parsed = F.struct(
        F.when(refusal, F.coalesce(reply, F.lit("REFUSED"))).otherwise(reply).alias("answer"),
        F.when(refusal, F.coalesce(blank_to_null(normal), F.lit("REFUSED"))).when(normal.isNull() & open_kind, reply).otherwise(normal).alias("answer_normalized"),
        field["JUSTIFICATION"].alias("justification"), field["RATIONALE"].alias("rationale"), field["KEY REASONING"].alias("key_reasoning"), field["UNCERTAINTY"].alias("uncertainty"),
        blank_to_null(F.lower(strip(field["CONFIDENCE"]))).alias("confidence"),
        (F.coalesce(cited, F.array().cast("array<int>")) if cited is not None else F.array().cast("array<int>")).alias("citations"),
        (F.col("_there") & (refusal | normal.isNotNull() | (reply.isNotNull() & open_kind))).alias("parse_success"),
        F.when(error.isNotNull(), F.array(error)).otherwise(F.array().cast("array<string>")).alias("parse_errors"),
        given.alias("raw_response"), refusal.alias("refusal"), F.coalesce(F.when(F.col("_there"), thinking_removed(given)), F.lit(False)).alias("think_block_removed"),
    )
    return df.withColumn("parsed", parsed).drop(*[c for c in ("_there", "_open", "_refusal", "_cut", "_text", "_pairs", "_zh", "_found", "_fallback", "_answer", "_normal", *(f"_f{k}" for k in range(len(V.LABELS))))])
