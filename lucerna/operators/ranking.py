"""Ranks within strata and samples of exact size, without a stratum's rows meeting in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the key that deal a stratum's rows out to tasks.
DIGITS = 3


def shuffled_key(seed: int, id_col: str) -> Column:
    """A key by which rows stand in random but repeatable order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def ranked(df: DataFrame, strata: list[str], key: str, tie: str, digits: int = DIGITS) -> DataFrame:
    """Adds `rank`, from 1, by (key, tie) within the strata. key: a column of hex strings. Rows of a stratum are dealt out by the
    key's first digits; a running sum over the counts of those buckets gives each bucket its first rank."""
    cut = df.withColumn("_b", F.substring(key, 1, digits))
    counts = cut.groupBy(*strata, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*strata, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    own = Window.partitionBy(*strata, "_b").orderBy(key, tie)
    out = cut.withColumn("_r", F.row_number().over(own)).alias("l").join(starts.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*strata, "_b"]])
    return out.select("l.*", (F.col("_from") + F.col("_r")).alias("rank")).drop("_b", "_r")


def quotas(df: DataFrame, stratum: str, size: int) -> DataFrame:
    """(stratum, n, quota): shares of `size` by largest remainder, ties to the smaller name; they add up to size."""
    counts = df.groupBy(stratum).agg(F.count("*").alias("n"))
    total = Window.partitionBy()  # as many rows as strata
    share = counts.withColumn("_all", F.sum("n").over(total)).withColumn("_base", F.floor(F.col("n") * size / F.col("_all")))
    share = share.withColumn("_part", F.col("n") * size - F.col("_base") * F.col("_all")).withColumn("_left", size - F.sum("_base").over(total))
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc("_part"), stratum))
    return share.withColumn("_place", place).select(stratum, "n", (F.col("_base") + (F.col("_place") <= F.col("_left")).cast("long")).alias("quota"))


def sample(df: DataFrame, id_col: str, stratum: str, size: int, seed: int) -> DataFrame:
    """Rows of exactly `size`, spread over the strata by quota, with `n`, `quota` and `rank`; rank <= quota."""
    keyed = ranked(df.withColumn("_k", shuffled_key(seed, id_col)), [stratum], "_k", id_col)
    share = quotas(df, stratum, size).withColumnRenamed(stratum, "_s")
    return keyed.join(share, F.col(stratum).eqNullSafe(F.col("_s"))).where("rank <= quota").drop("_k", "_s")


def split(df: DataFrame, id_col: str, stratum: str, sizes: dict[str, int], rest: str, seed: int = 42, at_least: int = 2) -> DataFrame:
    """Adds `split`: passes of exact sizes, one after the other from what is left, and `rest` for the remainder. Raises where a
    stratum has fewer than `at_least` rows, or the rows don't suffice."""
    least = df.groupBy(stratum).count().agg(F.min("count"), F.sum("count")).first()
    if least[0] is not None and least[0] < at_least:
        raise ValueError(f"a stratum has {least[0]} rows; at least {at_least} are needed")
    if sum(sizes.values()) > (least[1] or 0):
        raise ValueError(f"{least[1] or 0} rows don't suffice for {sizes}")
    left, out = df, []
    for name, size in sizes.items():
        taken = sample(left, id_col, stratum, size, seed).select(id_col)
        out.append(taken.withColumn("split", F.lit(name)))
        left = left.join(taken, id_col, "left_anti")
    named = out[0]
    for x in out[1:]:
        named = named.union(x)
    return df.join(named, id_col, "left").withColumn("split", F.coalesce("split", F.lit(rest)))


def checks(parts: DataFrame, id_col: str, sizes: dict[str, int]) -> DataFrame:
    """(check_name, ok): each split's size, each pair's disjointness, and the sum."""
    names = list(sizes)
    per = parts.groupBy(id_col).agg(*[F.max((F.col("split") == n).cast("int")).alias(f"_{k}") for k, n in enumerate(names)], *[F.sum((F.col("split") == n).cast("long")).alias(f"n{k}") for k, n in enumerate(names)])
    one = per.agg(
        *[F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"size_{n}") for k, n in enumerate(names)],
        *[F.coalesce(F.sum(F.col(f"_{a}") * F.col(f"_{b}")), F.lit(0)).alias(f"both_{names[a]}_{names[b]}") for a in range(len(names)) for b in range(a + 1, len(names))],
    )
    rows = [F.struct(F.lit(f"size_{n}").alias("check_name"), (F.col(f"size_{n}") == size).alias("ok")) for n, size in sizes.items()]
    rows += [F.struct(F.lit(c.replace("both_", "disjoint_")).alias("check_name"), (F.col(c) == 0).alias("ok")) for c in one.columns if c.startswith("both_")]
    rows.append(F.struct(F.lit("sum").alias("check_name"), (sum((F.col(f"size_{n}") for n in names), F.lit(0)) == sum(sizes.values())).alias("ok")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def require(found: DataFrame) -> None:
    """Raises AssertionError naming the failed checks."""
    if bad := [r.check_name for r in found.where("not ok").collect()]:
        raise AssertionError(f"failed: {', '.join(bad)}")


def require_rows(df: DataFrame, n: int) -> None:
    if (found := df.count()) != n:
        raise AssertionError(f"{found} rows, {n} expected")


def seeded(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """n rows, uniformly and without replacement."""
    return df.orderBy(shuffled_key(seed, id_col), id_col).limit(n)
