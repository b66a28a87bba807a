"""Question files, paper files, resumable outputs and manifests."""

from __future__ import annotations

from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .json_arrays import read_array, write_array
from .stores import exists, work_folder

__all__ = ["append_lines", "checksums", "count_lines", "exists", "mismatches", "read_lines", "read_papers", "read_questions", "stage_archive", "valid_lines", "work_folder", "write_array", "write_table"]

CHOICES = T.StructType([T.StructField("text", T.ArrayType(T.StringType())), T.StructField("label", T.ArrayType(T.StringType()))])
QUESTION = T.StructType([
    T.StructField("question", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("type", T.StringType()), T.StructField("domain", T.StringType()),
    T.StructField("details", T.StructType([T.StructField(x, T.StringType()) for x in ("level", "task", "subtask", "source")])),
    T.StructField("answerKey", T.StringType()), T.StructField("choices", CHOICES),
])
ANSWER = "struct<unanswerable:boolean,extractive_spans:array<string>,free_form_answer:string,yes_no:boolean,evidence:array<string>>"
PAPERS = f"map<string,struct<title:string,qas:array<struct<question:string,question_id:string,answers:array<struct<answer:{ANSWER}>>>>>>"


def read_questions(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A JSON array of questions with ids by their place in the file; the split is the file's stem with '-' for '_'."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    name = (split or PurePosixPath(path).stem.replace("_", "-")).replace("%", "%%")
    rows = read_array(spark, path, QUESTION)
    return rows.withColumn("question_id", F.format_string(f"ske-{name}-%05d", "_at")).drop("_file", "_at")


def read_papers(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """(split, paper_id, paper) from files that hold one object of papers each; the split is named in the file name."""
    text = spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(folder).select("value", F.col("_metadata.file_name").alias("file"))
    split = F.regexp_extract(F.regexp_replace("file", r"-v[0-9.]*\.json$|\.json$", ""), "([^-]+)$", 1)
    return text.select(split.alias("split"), F.explode(F.from_json("value", PAPERS)).alias("paper_id", "paper"))


def stage_archive(archive: str, folder: str, word: str) -> list[str]:
    """Unpacks the JSON files of a tar archive whose names hold `word` into a folder, flat; the names, sorted. A step before
    Spark reads the folder."""
    import tarfile
    from pathlib import Path

    Path(folder).mkdir(parents=True, exist_ok=True)
    names = []
    with tarfile.open(archive) as tar:
        for member in tar:
            name = PurePosixPath(member.name).name
            if member.isfile() and name.endswith(".json") and word in name:
                Path(folder, name).write_bytes(tar.extractfile(member).read())
                names.append(name)
    return sorted(names)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet, replacing what is there."""
    df.write.mode("overwrite").parquet(path)


def append_lines(df: DataFrame, path: str, by: tuple[str, ...] = ("model", "strategy")) -> None:
    """JSON lines in folders by cell, without a log; nulls are kept."""
    df.write.mode("append").option("ignoreNullFields", "false").partitionBy(*by).json(path)


#: A key that no line holds: after a whole value it is read, after anything else it isn't.
_MARK = "lucerna-end-of-line"


def valid_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows whose line is JSON as Python's parser has it; blank and corrupt lines go.

    Spark's parser takes trailing junk, so a line is put into an object before a marked key, which is only read if the line is
    one whole value. What doesn't pass so (corrupt lines, but also NaN or very deep values) is tried by Python; lines that
    pass reach Python as nulls.
    """
    line = F.col(column)
    framed = F.try_parse_json(F.concat(F.lit('{"v":'), line, F.lit(f',"{_MARK}":0}}')))
    whole = F.coalesce(~F.contains(line, F.lit(_MARK)) & F.try_variant_get(framed, f"$['{_MARK}']", "int").isNotNull(), F.lit(False))

    @F.pandas_udf(T.BooleanType())
    def good(values: pd.Series) -> pd.Series:
        import json

        def one(x):
            try:
                json.loads(x)
            except (TypeError, ValueError, RecursionError):
                return False
            return True

        return values.map(one)

    checked = lines.withColumn("_whole", whole)
    return checked.where(F.col("_whole") | good(F.when(~F.col("_whole"), line))).drop("_whole")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The valid records of JSON lines."""
    lines = valid_lines(spark.read.text(path))
    parts = [c for c in lines.columns if c != "value"]
    return lines.select(F.from_json("value", schema).alias("r"), *parts).select("r.*", *parts)


def count_lines(spark: SparkSession, path: str) -> int:
    """How many valid records; 0 where there is no file."""
    return valid_lines(spark.read.text(path)).count() if exists(spark, path) else 0


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, md5) of files."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.md5("content").alias("md5"))


def mismatches(spark: SparkSession, path: str, manifest: str) -> DataFrame:
    """Files of a manifest ('md5  name' lines) that are missing or differ."""
    wanted = spark.read.text(manifest).where("value <> ''").select(F.regexp_extract("value", r"^(\S+)", 1).alias("wanted"), F.regexp_extract("value", r"([^/\s]+)\s*$", 1).alias("file"))
    return wanted.join(checksums(spark, path), "file", "left").where("md5 is null or md5 <> wanted")
