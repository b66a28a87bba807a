"""Words beside letters beyond ASCII: the queries read them as their SQL does, the operators as Unicode's words."""

import duckdb
import pytest

import __spark_entry__ as entry
from lucerna.functions import normalise

#: Texts by the letter or word that only an ASCII reading finds; the end of a line, of a text, and inside.
TEXTS = ["noñcobomente ción\nlas queja", "mi iedo noñcobo", "ción es éa", "bojación aé true", "Option bé es", "la quejañ d.", "éyes", "nö no", "siño right", "la falseé", "ñ b", "ó wrong ó"]
QUERIES = ["parse_full", "parse_full_native", "mc_native", "mc_fuzzy", "sampled_records", "validation", "parse_rate"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Each text under 36 ids in a row, so in every frame, type and strategy."""
    path = str(tmp_path_factory.mktemp("words"))
    rows = [(k * 36 + i, t, "es", f"s{k}", len(t)) for k, t in enumerate(TEXTS) for i in range(36)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", QUERIES)
def test_as_in_sql(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    df, want = entry.queries()[name](spark, folder), con.sql(entry.oracle_sql()[name])
    place = [want.columns.index(c) for c in df.columns]
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(tuple(r[i] for i in place)) for r in want.fetchall())


@pytest.mark.parametrize("text,unicode,ascii", [("iedo noñcobo", None, "No"), ("ñ true", "Yes", "Yes"), ("éright", None, "Yes"), ("unknown", None, None)])
def test_both_readings(spark, text, unicode, ascii):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(normalise.truth(df.t), normalise.truth(df.t, True)).first()[:] == (unicode, ascii)
