"""Counts, shares, tables and profiles of a data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str, ascending: bool = False) -> DataFrame:
    order = F.asc("n") if ascending else F.desc("n")
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(order, column)


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """(column, n, pct): percentages of the rows that have a value."""
    return value_counts(df, column).withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def crosstab(df: DataFrame, row: str, column: str, values: list | None = None) -> DataFrame:
    """Counts of the pairs, a column for each value, zeros where there are none."""
    return df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row).pivot(column, values).count().na.fill(0).orderBy(row)


def crosstab_margins(df: DataFrame, row: str, column: str) -> DataFrame:
    """Long form of a table with margins: (row, column, n), 'All' for a margin, zeros for missing pairs."""
    some = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).select(F.col(row).cast("string").alias(row), F.col(column).cast("string").alias(column))
    cube = some.cube(row, column).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    name = lambda c, bit: F.when(F.col("g").bitwiseAND(bit) != 0, "All").otherwise(F.col(c)).alias(c)
    cells = cube.select(name(row, 2), name(column, 1), "n")
    grid = cells.select(row).distinct().crossJoin(cells.select(column).distinct())  # names of the axes, not rows
    return grid.join(cells, [row, column], "left").na.fill(0, ["n"])


def grid(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n) over every pair of names, zeros included."""
    counts = df.groupBy(row, column).agg(F.count("*").alias("n"))
    return counts.select(row).distinct().crossJoin(counts.select(column).distinct()).join(counts, [row, column], "left").na.fill(0, ["n"])


def least_cell(df: DataFrame, row: str, column: str) -> DataFrame:
    """The smallest cell of the grid, the first of equals in axis order."""
    return grid(df, row, column).agg(F.min(F.struct("n", row, column)).alias("c")).select(f"c.{row}", f"c.{column}", "c.n")


def least_stratum(df: DataFrame, stratum: str) -> DataFrame:
    return df.groupBy(stratum).agg(F.count("*").alias("n")).agg(F.min(F.struct("n", stratum)).alias("c")).select(f"c.{stratum}", "c.n")


def small_strata(df: DataFrame, stratum: str, below: int) -> DataFrame:
    return df.groupBy(stratum).agg(F.count("*").alias("n")).where(F.col("n") < below)


def nested(column: str) -> Column:
    """A nested field as text, '' where it is missing."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def stratum(*columns: str) -> Column:
    """The values joined by '_'; null if any is."""
    return F.concat(*[x for k, c in enumerate(columns) for x in ([F.lit("_")] if k else []) + [F.col(c)]])


def null_or_empty(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n)."""
    one = df.agg(*[F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in columns])
    return one.unpivot([], columns, "column_name", "n")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n): distinct values, nulls left out. Each column's values are counted in two steps, so none is gathered."""
    parts = [df.where(F.col(c).isNotNull()).select(F.col(c)).distinct().agg(F.count("*").alias("n")).select(F.lit(c).alias("column_name"), "n") for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


#: Leading bits by which whole numbers are put into buckets: a bucket's numbers differ by less than one part in 2^(BITS - 1).
BITS = 10


def _bucket(value: Column) -> tuple[Column, Column]:
    """(bits cut off, what is left) of a whole number from 0 on; they order buckets as their numbers are ordered."""
    cut = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return cut, F.call_function("shiftright", value, cut)


def medians(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, median) of whole numbers from 0 on, exact, nulls left out; a group of nulls alone has none.

    Two scans. The first counts numbers by bucket, of which a group has some ten thousand at most, whatever it holds; the middle ranks
    lie in one or two of them. The second counts the numbers of those buckets one by one.
    """
    cut, head = _bucket(F.col("_v"))
    rows = df.select(*by, F.col(value).cast("long").alias("_v")).where("_v is not null").withColumn("_cut", cut).withColumn("_head", head)
    keys = [F.col(c) for c in by] or [F.lit(0)]
    upto = Window.partitionBy(*keys).orderBy("_cut", "_head").rowsBetween(Window.unboundedPreceding, 0)
    counts = rows.groupBy(*by, "_cut", "_head").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_to", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)  # ranks from 0
    middle = counts.where((F.col("_to") > low) & (F.col("_to") - F.col("_n") <= high)).select(*by, "_cut", "_head", (F.col("_to") - F.col("_n")).alias("_before"), "_all")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in (*by, "_cut", "_head")]
    on = same[0]
    for x in same[1:]:
        on = on & x
    found = rows.alias("r").join(middle.alias("m"), on).groupBy(*[F.col(f"m.{c}").alias(c) for c in (*by, "_cut", "_head")], "_before", "_all", F.col("r._v").alias("_v")).agg(F.count("*").alias("_n"))
    within = Window.partitionBy(*keys, "_cut", "_head").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("_to", F.col("_before") + F.sum("_n").over(within))
    at = lambda rank: F.max(F.when((F.col("_to") > rank) & (F.col("_to") - F.col("_n") <= rank), F.col("_v")))
    grouped = found.groupBy(*by) if by else found.groupBy()
    return grouped.agg(((at(low) + at(high)) / 2).alias("median"))


def length_stats(df: DataFrame, text: str, by: str | None = None) -> DataFrame:
    """Lengths in characters: count, min, max, mean, median, sample deviation."""
    keys = [by] if by else []
    rows = df.select(*keys, F.length(text).alias("_n"))
    n = F.col("_n")
    figures = [F.count(n).alias("n"), F.min(n).cast("long").alias("min_len"), F.max(n).cast("long").alias("max_len"), F.avg(n).alias("mean_len"), F.stddev_samp(n).alias("std_len")]
    out, middle = rows.groupBy(*keys).agg(*figures), medians(rows, "_n", keys).withColumnRenamed("median", "median_len")
    columns = [*keys, "n", "min_len", "max_len", "mean_len", "median_len", "std_len"]
    if not by:
        return out.crossJoin(F.broadcast(middle)).select(*columns)  # one row by one row
    return out.alias("s").join(middle.alias("m"), F.col(f"s.{by}").eqNullSafe(F.col(f"m.{by}")), "left").select(F.col(f"s.{by}").alias(by), *columns[1:])


def per_group_stats(df: DataFrame, group: str) -> DataFrame:
    """Rows per group: groups, min, max, mean, median."""
    n = df.groupBy(group).agg(F.count("*").alias("n"))
    out = n.agg(F.count("*").alias("groups"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.avg("n").alias("mean_n"))
    return out.crossJoin(F.broadcast(medians(n, "n", []).withColumnRenamed("median", "median_n")))  # one row by one row


def first_by(df: DataFrame, group: str, preference: Column, index: str, keep: list[str]) -> DataFrame:
    """One row per group: the first by (preference, index)."""
    row = F.struct(preference.alias("_p"), F.col(index), *[F.col(c) for c in keep])
    return df.where(preference.isNotNull()).groupBy(group).agg(F.min(row).alias("r")).select(group, f"r.{index}", *[f"r.{c}" for c in keep])


def level_preference(level: str, levels: list[str]) -> Column:
    """The place of a level among the preferred ones, null for others."""
    return F.nullif(F.array_position(F.lit(levels), F.col(level)), F.lit(0))


def examples_by_domain(df: DataFrame, domain: str, level: str, index: str, keep: list[str], domains: list[str], levels: list[str], extra_domain: str, extra_levels: list[str]) -> DataFrame:
    """A row per domain by preferred level, and one more of `extra_domain` by `extra_levels` where there are fewer than one
    more than domains and it isn't there already."""
    few = first_by(df.where(F.col(domain).isin(domains)), domain, level_preference(level, levels), index, [level, *keep])
    extra = first_by(df.where(F.col(domain) == extra_domain).join(F.broadcast(few.select(index)), index, "left_anti"), domain, level_preference(level, extra_levels), index, [level, *keep])
    return few.union(extra)


def first_of_types(df: DataFrame, kind: str, index: str, keep: list[str], limit: int = 3, skip: str = "unknown") -> DataFrame:
    """The first row of each type in row order, `limit` types at most, `skip` left out."""
    return first_by(df.where(F.col(kind) != skip), kind, F.lit(0), index, keep).orderBy(index).limit(limit)


def first_examples(df: DataFrame, column: str, index: str, n: int = 3) -> DataFrame:
    """The first n values that aren't empty."""
    return df.where(F.col(column).cast("string") != "").orderBy(index).limit(n).select(F.lit(column).alias("column_name"), index, F.col(column).cast("string").alias("value"))


def profile(df: DataFrame, columns: list[str], index: str, n: int = 3) -> DataFrame:
    """(column_name, dtype, n_distinct, n_empty, examples) of each column."""
    kinds = df.sparkSession.createDataFrame([(c, df.schema[c].dataType.simpleString()) for c in columns], "column_name string, dtype string")
    shown = None
    for c in columns:
        part = first_examples(df, c, index, n).groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct(index, "value"))).alias("e"))
        shown = part if shown is None else shown.union(part)
    shown = shown.select("column_name", F.transform("e", lambda x: x["value"]).alias("examples"))
    counts = distinct_counts(df, columns).withColumnRenamed("n", "n_distinct").join(null_or_empty(df, columns).withColumnRenamed("n", "n_empty"), "column_name")
    return kinds.join(counts, "column_name").join(shown, "column_name", "left")


def split_feasibility(df: DataFrame, stratum_col: str, options: list[tuple[float, float]], least: int = 2) -> DataFrame:
    """Per option (dev share, holdout share): split sizes overall and in the rarest stratum, with banker's rounding, and whether
    that stratum keeps `least` rows in each."""
    table = df.sparkSession.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(options, 1)], "option_no int, dev_pct double, holdout_pct double")
    figures = df.groupBy(stratum_col).agg(F.count("*").alias("n")).agg(F.min(F.struct("n", stratum_col)).alias("c"), F.sum("n").alias("total"))
    out = table.crossJoin(F.broadcast(figures.select(F.col(f"c.{stratum_col}").alias("rarest"), F.col("c.n").alias("rarest_n"), "total")))  # one row by a few options
    for n, prefix in (("total", ""), ("rarest_n", "rarest_")):
        for part in ("dev", "holdout"):
            out = out.withColumn(f"{prefix}{part}", F.bround(F.col(n) * F.col(f"{part}_pct")).cast("long"))
        out = out.withColumn(f"{prefix}main", F.col(n) - F.col(f"{prefix}dev") - F.col(f"{prefix}holdout"))
    return out.withColumn("feasible", F.least("rarest_dev", "rarest_holdout", "rarest_main") >= least)


def sample_feasibility(df: DataFrame, kind: str, sizes: list[int], least: int = 5) -> DataFrame:
    """Per sample size: how many rows of the rarest type to expect, and whether that is enough."""
    table = df.sparkSession.createDataFrame([(n,) for n in sizes], "sample_size long")
    figures = df.groupBy(kind).agg(F.count("*").alias("n")).agg(F.min(F.struct("n", kind)).alias("c"), F.sum("n").alias("total"))
    out = table.crossJoin(F.broadcast(figures.select(F.col(f"c.{kind}").alias("rarest"), F.col("c.n").alias("n"), "total")))
    return out.select("sample_size", "rarest", F.bround(F.col("n") * F.col("sample_size") / F.col("total")).cast("long").alias("expected")).withColumn("feasible", F.col("expected") >= least)


def recommended_sizes(df: DataFrame) -> DataFrame:
    """A tenth, a twentieth and the rest, by banker's rounding."""
    n = df.agg(F.count("*").alias("total"))
    dev, holdout = F.bround(F.col("total") * 0.1).cast("long"), F.bround(F.col("total") * 0.05).cast("long")
    return n.select("total", dev.alias("dev"), holdout.alias("holdout"), (F.col("total") - dev - holdout).alias("main_test"))


def drift(full: DataFrame, part: DataFrame, column: str, limit: float = 2.0) -> DataFrame:
    """(column, full_pct, part_pct, diff, ok): shares of a sample against those of the whole; missing ones are 0."""
    a = value_shares(full, column).select(column, F.col("pct").alias("full_pct"))
    b = value_shares(part, column).select(column, F.col("pct").alias("part_pct"))
    out = a.join(b, column, "left").na.fill(0.0, ["part_pct"]).withColumn("diff", F.abs(F.col("full_pct") - F.col("part_pct")))
    return out.withColumn("ok", F.col("diff") <= limit)


def drift_gate(found: DataFrame) -> DataFrame:
    """(max_diff, passed) over the rows of `drift`."""
    return found.agg(F.max("diff").alias("max_diff"), F.coalesce(F.bool_and("ok"), F.lit(True)).alias("passed"))


def fields(df: DataFrame) -> DataFrame:
    """(path, dtype) of every field at every depth: elements of arrays as [], values of maps as {}."""
    from pyspark.sql import types as T

    def walk(kind, path):
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in walk(f.dataType, f"{path}.{f.name}" if path else f.name)]
        if isinstance(kind, T.ArrayType):
            return [(path, "array"), *walk(kind.elementType, f"{path}[]")]
        if isinstance(kind, T.MapType):
            return [(path, "map"), *walk(kind.valueType, path + "{}")]
        return [(path, kind.simpleString())]

    return df.sparkSession.createDataFrame(walk(df.schema, ""), "path string, dtype string")
