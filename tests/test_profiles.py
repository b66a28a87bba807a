import datetime

from pyspark.sql import functions as F

from lucerna.operators import profiles


def day():
    return F.col("ts").cast("date")


def write(spark, path, rows):
    spark.createDataFrame(rows, "ts timestamp, user long, kind string").coalesce(1).write.mode("append").parquet(path)


def rows(day, start, n):
    at = datetime.datetime(2024, 1, day, 12)
    return [(at, start + k, None if k % 10 == 0 else "" if k % 10 == 1 else f"k{k % 7}") for k in range(n)]


def test_only_new_files_are_read(spark, tmp_path):
    table, store = str(tmp_path / "t"), str(tmp_path / "s")
    assert profiles.refresh(spark, table, store, ["user"], day()) == [] and profiles.stored(spark, store).count() == 0
    write(spark, table, rows(1, 0, 3000))
    first = profiles.refresh(spark, table, store, ["user", "kind"], day())
    assert len(first) == 1 and profiles.refresh(spark, table, store, ["user", "kind"], day()) == []
    write(spark, table, rows(1, 2000, 4000) + rows(2, 0, 50) + [(None, 7, "x")])
    second = profiles.refresh(spark, table, store, ["user", "kind"], day())
    assert len(second) == 1 and second != first
    got = {(r.day, r.column_name): r for r in profiles.merged(profiles.stored(spark, store), ["day"]).collect()}
    one, two = datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)
    assert (got[one, "user"].n, got[one, "kind"].n_empty, got[two, "user"].n, got[two, "user"].n_distinct, got[None, "kind"].least) == (7000, 1400, 50, 50, "x")
    assert abs(got[one, "user"].n_distinct - 6000) <= profiles.BOUND * 6000 and got[one, "kind"].n_distinct == 7
    whole = profiles.merged(profiles.stored(spark, store), [])
    assert whole.where("column_name = 'user'").first().n == 7051
    # the same rows in one go, whatever the files
    again = profiles.merged(profiles.sketched(spark.read.parquet(table), ["user", "kind"], day()), ["day"])
    assert {(r.day, r.column_name): r for r in again.collect()} == got


def test_error_bound(spark, tmp_path):
    """Over many groups of unlike sizes hardly an estimate is beyond the bound."""
    spark.range(200_000).withColumn("g", (F.sqrt("id") / 20).cast("int")).select(F.date_add(F.lit("2024-01-01").cast("date"), "g").alias("ts"), F.col("id").alias("user")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = profiles.merged(profiles.sketched(df, ["user"], F.col("ts")), ["day"]).collect()
    off = [r for r in got if abs(r.n_distinct - r.n) > profiles.BOUND * r.n]
    assert len(got) > 20 and len(off) <= 1


def test_a_file_counts_once(spark, tmp_path):
    table, store = str(tmp_path / "t"), str(tmp_path / "s")
    write(spark, table, rows(1, 0, 20))
    profiles.refresh(spark, table, store, ["user"], day())
    profiles.stored(spark, store).coalesce(1).write.mode("append").parquet(store)  # another writer's
    assert profiles.merged(profiles.stored(spark, store), []).first().n == 20
