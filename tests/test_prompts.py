import pytest
from pyspark.sql import functions as F

from lucerna.operators import prompts
from lucerna.sources import settings

CHOICES = "struct<text:array<string>,label:array<string>>"


def one(spark, column, **values):
    kinds = {"c": CHOICES, "p": "array<string>", "q": "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[k]}" for k in values))
    return df.select(column).first()[0]


@pytest.mark.parametrize("choices,want", [
    ({"text": ["x", "y"], "label": ["A", "B"]}, "A) x\nB) y"), ({"text": ["x", "y", "z"], "label": ["A"]}, "A) x\nB) y\nC) z"), ({"text": [], "label": []}, ""), (None, ""), ({"text": ["x"], "label": ["P", "Q"]}, "P) x"),
])
def test_options(spark, choices, want):
    assert one(spark, prompts.options_block(F.col("c")), c=choices) == want


def test_prompt(spark):
    made = one(spark, prompts.prompt(F.col("q"), "RAS", F.col("c")), q="Is $x^2$ \\frac{a}{b} {options_block}?", c={"text": ["t"], "label": ["A"]})
    assert "Is $x^2$ \\frac{a}{b} A) t?\nA) t" in made and all(x in made for x in ("KEY REASONING:", "UNCERTAINTY:", "CONFIDENCE:")) and "{" not in made.replace("\\frac{a}{b}", "")
    assert one(spark, prompts.prompt(F.col("q"), "sc", F.lit(None).cast(CHOICES)), q="Q").startswith(settings.TEMPLATES["da"].split("{")[0])
    with pytest.raises(ValueError):
        settings.template("other")


def test_passages(spark):
    got = one(spark, prompts.prompt(F.col("q"), "da", F.lit(None).cast(CHOICES), F.col("p")), q="Q", p=["one", "two"])
    assert "[1] one\n[2] two\n\n" in got
    assert one(spark, prompts.passages_block(F.col("p")), p=[]) == ""


def test_own_templates(spark, tmp_path):
    (tmp_path / "da.txt").write_text("Q={question}|{options_block}")
    assert one(spark, prompts.prompt(F.col("q"), "sc", F.lit(None).cast(CHOICES), folder=str(tmp_path)), q="x") == "Q=x|"
    df = spark.createDataFrame([("a {question}",), ("b",)], "prompt string")
    assert prompts.unfilled(df).count() == 1
