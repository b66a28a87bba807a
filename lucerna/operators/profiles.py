"""Column profiles that merge: stored by file and day, so that a growing table is profiled by its new files alone.

A stored row holds, for a file, a day and a column, exact tallies (rows, empty values, least and greatest value) and a sketch of its
distinct values. Tallies add up and sketches unite, so any choice of files and days has its profile without the table. The sketch
(HyperLogLog with 2^LG registers) is off by more than `bound` for one group in some four hundred; few distinct values it counts as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import stores

LG = 12
#: Three standard errors of the sketch, as a share of the count.
BOUND = 3 * 1.04 / 2 ** (LG / 2)
STORED = "file string, day date, column_name string, n bigint, n_empty bigint, least string, greatest string, sketch binary"


def sketched(df: DataFrame, columns: list[str], day: Column) -> DataFrame:
    """The stored rows of a frame read from files; nulls and empty texts are empty values, and a null day is a day of its own."""
    file = F.col("_metadata.file_path").alias("file")
    rows = df.select(file, day.cast("date").alias("day"), *[F.nullif(F.col(c).cast("string"), F.lit("")).alias(f"c{k}") for k, c in enumerate(columns)])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{k}").alias("v")) for k, c in enumerate(columns)]))
    long = rows.select("file", "day", pairs.alias("x")).select("file", "day", "x.*")
    return long.groupBy("file", "day", "column_name").agg(
        F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("n_empty"), F.min("v").alias("least"), F.max("v").alias("greatest"), F.hll_sketch_agg("v", LG).alias("sketch"),
    )


def stored(spark: SparkSession, store: str) -> DataFrame:
    """All rows of a store; those of a file count once, should two writers have profiled it."""
    if not stores.exists(spark, store):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(store).dropDuplicates(["file", "day", "column_name"])


def refresh(spark: SparkSession, folder: str, store: str, columns: list[str], day: Column) -> list[str]:
    """Profiles the Parquet files of a folder that the store doesn't have yet, and tells which. Files are never changed in place."""
    here = [p for p, _ in stores.listed(spark, folder, below=True) if p.endswith(".parquet")]
    have = {stores.plain(r.file) for r in stored(spark, store).select("file").distinct().collect()}  # a row for each file
    new = [p for p in here if stores.plain(p) not in have]
    if new:
        staged = f"{store}/_{uuid.uuid4().hex}"
        sketched(spark.read.parquet(*new), columns, day).write.parquet(staged)
        for k, (part, _) in enumerate(stores.listed(spark, staged)):
            stores.move(spark, part, f"{store}/{staged.rsplit('_', 1)[1]}-{k:05d}.parquet")
        stores.remove(spark, staged)
    return new


def merged(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, column_name, n, n_empty, least, greatest, n_distinct) of stored rows; n_distinct is the sketch's."""
    return rows.groupBy(*by, "column_name").agg(
        F.sum("n").alias("n"), F.sum("n_empty").alias("n_empty"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"),
    )
