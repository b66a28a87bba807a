import json
import time

from lucerna.operators import inference, runs
from lucerna.plans.derived import questions
from lucerna.sources import json_files
from lucerna.streaming.resume import stream_cell

CONFIG = {"models": {"m1": {}, "m2": {}}, "strategies": ["da", "sc"], "inference": {"sc_samples": 5}}
SF = "/root/testdata/sf0.001"


class Echo:
    """A backend that answers B and counts what it was asked."""

    def generate(self, prompts, settings):
        return [(len(p.split()), [("ANSWER: B\nJUSTIFICATION: echo", 4)] * settings["n"]) for p in prompts]


def test_cell_resumes_by_key(spark, tmp_path):
    q, out = questions(spark, SF), str(tmp_path / "o")
    first = runs.run_cell(q, CONFIG, "m1", "da", out, limit=30)
    assert (first["total"], first["processed"], first["skipped"], first["parse_rate"], first["status"]) == (30, 30, 0, 100.0, "complete")
    second = runs.run_cell(q, CONFIG, "m1", "da", out, limit=50)
    assert (second["processed"], second["skipped"]) == (20, 30)
    third = runs.run_cell(q, CONFIG, "m1", "DA", out, limit=50)
    assert (third["processed"], third["status"], third["parse_rate"]) == (0, "skipped", 100.0)
    assert runs.run_cell(q, CONFIG, "m1", "da", out, limit=0)["total"] == 0
    (tmp_path / "o" / "model=m1" / "strategy=da" / "torn.json").write_text('{"question_id": "x"')  # doesn't count
    done = runs.read_done(spark, out)
    assert done.count() == done.select("question_id").distinct().count() == 50


def test_matrix_and_votes(spark, tmp_path):
    q, out = questions(spark, SF).limit(40), str(tmp_path / "o")
    got = runs.run_matrix(q, CONFIG, out, models=["m2"], factories={"m2": Echo})
    assert [(x["model"], x["strategy"], x["processed"]) for x in got] == [("m2", "da", 40), ("m2", "sc", 40)]
    rec = [json.loads(x.value) for x in json_files.valid_lines(spark.read.text(out).where("strategy = 'sc'")).collect()]
    assert all(r["sc_result"]["total_samples"] == 5 and len(r["sc_result"]["per_sample"]) == 5 and r["completion_tokens"] == 20 for r in rec)
    assert {r["sc_result"]["final_answer"] for r in rec if r["question_type"].startswith("mcq")} == {"B"}
    da = json.loads(spark.read.text(out).where("strategy = 'da'").first().value)
    assert da["sc_result"] is None and set(da) | {"model", "strategy"} == set(inference.OUTPUT)
    cells = runs.status(runs.matrix(spark, ["m1", "m2"], ["da", "sc"]), runs.read_done(spark, out), 40)
    assert {(r.model, r.strategy): r.status for r in cells.collect()} == {("m1", "da"): "PENDING", ("m1", "sc"): "PENDING", ("m2", "da"): "COMPLETE", ("m2", "sc"): "COMPLETE"}
    e = runs.estimate(cells, 40).first()
    assert (e.pending, e.partial, e.complete, e.total) == (2, 0, 2, 4) and abs(e.hours - 6 * 40 * 200 / 750 / 3600) < 1e-9
    part = runs.status(cells.drop("n_done", "status"), runs.read_done(spark, out), 41).where("model = 'm2'").first()
    assert part.status == "PARTIAL (40/41)"


def test_stream(spark, tmp_path):
    q = questions(spark, SF).limit(20)
    q.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = stream_cell(spark.readStream.schema(q.schema).parquet(str(tmp_path / "in")), CONFIG, "m1", "da", str(tmp_path / "o"), str(tmp_path / "c"))
        began = time.time()
        while stream.isActive and time.time() - began < 120:
            time.sleep(0.2)
        assert stream.exception() is None
    assert runs.read_done(spark, str(tmp_path / "o")).count() == 20
