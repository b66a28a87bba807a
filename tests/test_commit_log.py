import json
import os
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lucerna.operators import inference, prompts, runs
from lucerna.plans.derived import questions
from lucerna.sources import commit_log, json_files, stores

CONFIG = {"models": {"m": {}}, "strategies": ["da"], "inference": {"checkpoint_every": 3}}
SF = "/root/testdata/sf0.001"


def lines(spark, ids, cell="da"):
    return spark.createDataFrame([("m", cell, str(k), None) for k in ids], "model string, strategy string, question_id string, sc_result string")


def ids(spark, out):
    found = commit_log.read(spark, out)
    return sorted(json.loads(r.value)["question_id"] for r in found.collect()) if found is not None else []


def test_chunks_are_there_once(spark, tmp_path):
    out = str(tmp_path / "o")
    assert commit_log.read(spark, out) is None
    assert commit_log.append(lines(spark, range(10)).repartition(2), out, "a", 3)
    assert not commit_log.append(lines(spark, range(10)), out, "a", 3)  # a replay
    assert commit_log.append(lines(spark, [10], "sc"), out, "b", 3)
    assert ids(spark, out) == sorted(str(k) for k in range(11))
    log = commit_log.manifests(spark, out)
    assert [(m["version"], m["chunk"], m["records"]) for m in log] == [(0, "a", 10), (1, "b", 1)]
    assert len(log[0]["files"]) >= 4 and all(f.startswith("model=m/strategy=da/") for f in log[0]["files"])
    assert {(r.model, r.strategy) for r in commit_log.read(spark, out).collect()} == {("m", "da"), ("m", "sc")}
    assert '"sc_result":null' in (tmp_path / "o" / log[1]["files"][0]).read_text()


@pytest.mark.parametrize("step", ["move", "put"])
def test_a_writer_that_dies_leaves_no_part(spark, tmp_path, monkeypatch, step):
    """Killed while files are moved, or before its manifest: readers see nothing of the chunk, and the next try has it once."""
    out, calls = str(tmp_path / "o"), []
    commit_log.append(lines(spark, [0]), out, "first", 2)
    real = getattr(stores, step)

    def dies(*args):
        calls.append(args)
        if len(calls) == (2 if step == "move" else 1):
            raise OSError("killed")
        return real(*args)

    monkeypatch.setattr(stores, step, dies)
    with pytest.raises(OSError):
        commit_log.append(lines(spark, range(1, 8)).repartition(1), out, "x", 2)
    monkeypatch.undo()
    assert ids(spark, out) == ["0"]
    assert commit_log.append(lines(spark, range(1, 8)), out, "x", 2)
    assert ids(spark, out) == [str(k) for k in range(8)]


def test_another_writer_is_first(spark, tmp_path, monkeypatch):
    """Two writers of one version: both chunks are there; of one chunk only the first."""
    out = str(tmp_path / "o")
    real, raced = commit_log.manifests, []

    def late(spark, out):
        found = real(spark, out)
        if not raced:
            raced.append(1)
            commit_log.append(lines(spark, [1]), out, "other", 5)
        return found

    monkeypatch.setattr(commit_log, "manifests", late)
    assert commit_log.append(lines(spark, [2]), out, "mine", 5)
    raced.clear()
    monkeypatch.undo()
    assert [m["version"] for m in real(spark, out)] == [0, 1] and ids(spark, out) == ["1", "2"]


class Lost(inference.Scripted):
    """Answers a task's first batch and is lost in its second."""

    def generate(self, prompts, settings):
        self.asked = getattr(self, "asked", 0) + 1
        if self.asked > 1:
            raise RuntimeError("lost")
        return super().generate(prompts, settings)


def test_a_killed_run_leaves_whole_chunks(spark, tmp_path):
    q, out = questions(spark, SF), str(tmp_path / "o")
    n = q.count()
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        with pytest.raises(PySparkException):
            runs.run_cell(q, CONFIG, "m", "da", out, factory=lambda: Lost(("ANSWER: B\nJUSTIFICATION: x",)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    kept = len(ids(spark, out))
    assert kept == sum(m["records"] for m in commit_log.manifests(spark, out)) < n
    again = runs.run_cell(q, CONFIG, "m", "da", out)
    assert (again["processed"], again["skipped"]) == (n - kept, kept)
    got = ids(spark, out)
    assert len(got) == len(set(got)) == n and len(commit_log.manifests(spark, out)) > 3
    assert all(m["records"] > 0 for m in commit_log.manifests(spark, out))


def test_chunks_by_hash(spark):
    df, count = commit_log.chunks(spark.range(1000).withColumnRenamed("id", "question_id"), ["question_id"], 10)
    assert count > 1 and df.agg(F.max("_chunk")).first()[0] == count - 1
    assert commit_log.chunks(spark.range(0), ["id"], 10)[1] == 0


def test_chunks_dont_grow_in_number(spark):
    """A chunk's own cost is paid sixteen times at most, however long the run, and no row is left out."""
    df, count = commit_log.chunks(spark.range(5000).withColumnRenamed("id", "question_id"), ["question_id"], 1)
    assert count == 16
    assert df.count() == 5000 and {r._chunk for r in df.select("_chunk").distinct().collect()} == set(range(16))


def test_a_run_takes_little_disk(spark, tmp_path, monkeypatch):
    """A record holds its question twice, but its files are smaller than the questions; a chunk goes from the work folder when it is
    committed, and nothing stays there; a killed run leaves nothing there either."""
    q, out, left, seen = questions(spark, SF), str(tmp_path / "o"), tmp_path / "left", []
    monkeypatch.setattr(json_files, "work_folder", lambda *_: str(left))
    real = commit_log.append

    def append(df, *args, **kw):
        seen.append({p.name for p in left.iterdir() if p.is_dir()})
        return real(df, *args, **kw)

    monkeypatch.setattr(commit_log, "append", append)
    scripted = inference.Scripted.of(["ANSWER: B\nJUSTIFICATION: x"])
    done = runs.run_cell(q, {"inference": {"checkpoint_every": 10, "batch_size": 8}}, "m", "da", out, factory=scripted)
    assert len(seen) > 2 and all(len(a) == len(b) + 1 for a, b in zip(seen, seen[1:])) and not left.exists()
    texts = q.agg(F.sum(F.octet_length("question"))).first()[0]
    got = [json.loads(r.value) for r in commit_log.read(spark, out).collect()]
    assert sum((tmp_path / "o" / f).stat().st_size for m in commit_log.manifests(spark, out) for f in m["files"]) < texts < sum(len(r["question"]) + len(r["prompt"]) for r in got) / 2
    assert done["processed"] == q.count() and {(r["question_id"], r["question"]) for r in got} == {(r.question_id, r.question) for r in q.collect()}
    with pytest.raises(PySparkException):
        runs.run_cell(q, CONFIG, "m", "ras", out, factory=lambda: Lost(()))
    assert not left.exists()
    runs.run_cell(q, {"inference": {"compression": "none"}}, "m", "ras", out)
    assert all(f.endswith(".json") for f in commit_log.manifests(spark, out)[-1]["files"])


def test_shuffles_go_with_their_write(spark, tmp_path):
    """Shuffle files of a chunk don't wait for the garbage collector, and the session's own setting stays."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: map(str, spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()))
    held = lambda: {f for f in files() if "shuffle_" in f and os.path.exists(f) and os.path.getsize(f) > 1000}  # noqa: E731 (counts leave less)
    was, before = spark.conf.get(key), held()
    df = lines(spark, range(2000)).repartitionByRange(3, "question_id")
    assert commit_log.append(df, str(tmp_path / "o"), "a", 1000)
    ended = time.time() + 10
    while held() - before and time.time() < ended:
        time.sleep(0.2)
    assert not held() - before and spark.conf.get(key) == was


def test_prompts_are_made_after_the_shuffle(spark):
    """The same records in batches of like length, with the texts in the exchange once."""
    q = questions(spark, SF)
    made = prompts.prompt(F.col("question"), "da", prompts.choices_or_null())
    scripted, params = inference.Scripted.of(["a", "b", "c"]), inference.sampling("da", {})
    before = inference.generated(q.withColumn("prompt", made), scripted, params, 8)
    after = inference.generated(q, scripted, params, 8, prompt=made)
    row = lambda df: sorted(map(str, df.select(*sorted(before.columns)).collect()))
    assert row(before) == row(after)
    plan = after._jdf.queryExecution().optimizedPlan().toString()
    assert "AS prompt#" in plan[: plan.index("RepartitionByExpression")] and "AS prompt#" not in plan[plan.index("RepartitionByExpression") :]
