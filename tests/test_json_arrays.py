import json
import random

import pytest

from lucerna.sources import json_arrays as J
from lucerna.sources import json_files, stores


def write(path, rows, **how):
    path.write_text(json.dumps(rows, **how), encoding="utf-8")
    return str(path)


def hostile(seed, n):
    """Objects whose strings hold brackets, braces, quotes and backslashes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(['{', '}', '[', ']', '"', "\\", ",", "é", "\n", "a", '\\"', "}]", ":"]) for _ in range(rng.randint(0, 12)))
    return [{"a": word(), "b": [{"c": word()} for _ in range(rng.randint(0, 3))], "d": {word(): word()}} for _ in range(n)]


@pytest.mark.parametrize("size", [300, 1000, 10**9])
@pytest.mark.parametrize("indent", [None, 2])
def test_any_byte_range(spark, tmp_path, size, indent):
    """Objects are whole and numbered however the file is cut into ranges."""
    rows = hostile(size, 60)
    path = write(tmp_path / "x.json", rows, indent=indent, ensure_ascii=False)
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = J.read_objects(spark, path).orderBy("at").collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert [r["at"] for r in got] == list(range(60)) and [json.loads(r.text) for r in got] == rows


def test_several_files_and_none(spark, tmp_path):
    for k, rows in enumerate(([{"a": 1}], [], [{"a": 2}, {"a": 3}])):
        write(tmp_path / f"{k}.json", rows)
    got = sorted((r._file[-6:], r._at, r.a) for r in J.read_array(spark, str(tmp_path), "a int").collect())
    assert got == [("0.json", 0, 1), ("2.json", 0, 2), ("2.json", 1, 3)]


@pytest.mark.parametrize("text", ['[{"a": 1}', '[{"a": 1}, ', '[{"a": "x}]', '[1, 2]', '[{"a": 1}, "x{", {"a": 2}]'])
def test_what_isnt_an_array_of_objects_raises(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    if text == "[1, 2]":
        assert J.read_objects(spark, str(tmp_path / "x.json")).count() == 0  # no object, so nothing to give
        return
    with pytest.raises(ValueError):
        J.read_objects(spark, str(tmp_path / "x.json"))


def test_question_ids_by_place(spark, tmp_path):
    rows = [{"question": f"q {k} }}", "answer": "", "type": "filling"} for k in range(500)]
    path = write(tmp_path / "dev.json", rows)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 4000)
        df = json_files.read_questions(spark, path)
        assert J._ranges(spark, path).rdd.getNumPartitions() >= 4
        plan = df._jdf.queryExecution().toString()
        got = {r.question_id: r.question for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == {f"ske-dev-{k:05d}": f"q {k} }}" for k in range(500)}
    assert "SinglePartition" not in plan.split("== Physical Plan ==")[-1] or "hashpartitioning(file" in plan


def test_sink_in_parts(spark, tmp_path):
    rows = [{"a": k, "b": ["é\n", None], "c": {"d": "}"}} for k in range(100)]
    df = spark.createDataFrame([(r["a"], r["b"], (r["c"]["d"],)) for r in rows], "a int, b array<string>, c struct<d:string>")
    for parts in (1, 7):
        J.write_array(df.repartitionByRange(parts, "a"), str(tmp_path / "x.json"))  # replaces what is there
        assert (tmp_path / "x.json").read_text() == json.dumps(rows, indent=2, ensure_ascii=False) + "\n"
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["x.json"]
    J.write_array(df.limit(0), str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == []
    back = J.read_array(spark, str(tmp_path / "x.json"), df.schema).orderBy("_at").drop("_file", "_at")
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in df.collect()]


def test_names_are_taken_once(spark, tmp_path):
    stores.put(spark, str(tmp_path / "a"), "1")
    stores.put(spark, str(tmp_path / "b"), "2")
    assert not stores.move(spark, str(tmp_path / "a"), str(tmp_path / "b")) and stores.move(spark, str(tmp_path / "a"), str(tmp_path / "d" / "c"))
    assert stores.listed(spark, str(tmp_path / "none")) == []


def test_a_worker_looks_at_bounded_pieces():
    """A large batch comes in pieces of a megabyte, in order and whole; a longer value alone."""
    import pyarrow as pa

    values = [bytes([97 + k % 26]) * (3 << 20 if k == 7 else 1000) for k in range(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * 5000), pa.array([0] * 5000, pa.int64()), pa.array(values, pa.binary())], ["file", "start", "value"])
    pieces = [p for _, p in J._by_range([batch.slice(0, 0), batch])]
    assert b"".join(pieces) == b"".join(v + b"}" for v in values)
    assert sorted(map(len, pieces))[-2] < (1 << 20) + 5000 and max(map(len, pieces)) == (3 << 20) + 1
