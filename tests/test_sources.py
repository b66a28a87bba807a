import json

import pytest

from lucerna.operators import papers
from lucerna.sources import json_files as J
from lucerna.sources import settings


def test_questions(spark, tmp_path):
    rows = [{"question": f"q{k}", "answer": "", "type": "filling", "domain": "Physics", "details": {"level": "L1"} if k else None, "answerKey": "", "choices": {"text": [], "label": []}} for k in range(5)]
    (tmp_path / "main_test.json").write_text(json.dumps(rows))
    got = J.read_questions(spark, str(tmp_path / "main_test.json")).orderBy("question_id").collect()
    assert [(r.question_id, r.question) for r in got] == [(f"ske-main-test-{k:05d}", f"q{k}") for k in range(5)]
    assert J.read_questions(spark, str(tmp_path / "main_test.json"), "dev").first().question_id.startswith("ske-dev-")
    with pytest.raises(FileNotFoundError):
        J.read_questions(spark, str(tmp_path / "none.json"))


def test_papers(spark, tmp_path):
    def a(**k):
        return {"answer": {"unanswerable": False, "extractive_spans": [], "free_form_answer": "", "yes_no": None, "evidence": []} | k}

    paper = {"p1": {"title": "T", "abstract": "x", "full_text": [1], "qas": [
        {"question": "a?", "question_id": "1", "answers": [a(extractive_spans=["x", "y"], evidence=["e"]), a(unanswerable=True)]}, {"question": "b?", "question_id": "2", "answers": [a(yes_no=False)]},
        {"question": "c?", "question_id": "3", "answers": [a(free_form_answer=" \n")]}, {"question": "d?", "question_id": "4", "answers": []}, {"question": "e?", "question_id": "5", "answers": [a(free_form_answer=" free ")]},
    ]}}
    (tmp_path / "set-train-v0.3.json").write_text(json.dumps(paper))
    got = {r.question_id: r for r in papers.questions(J.read_papers(spark, str(tmp_path))).collect()}
    assert {k: (r.answer_type, r.answer_text, r.mixed, r.split) for k, r in got.items()} == {"1": ("extractive", "x | y", True, "train"), "2": ("yes_no", "No", False, "train"), "3": ("unknown", "", False, "train"), "5": ("free_form", " free ", False, "train")}
    assert got["1"].evidence == ["e"] and got["1"].num_annotators == 2


def test_tolerant_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":1}\n\n{"a":\n{"a":2} junk\n[1]\n7\nNaN\n{"a":3}\n')
    assert J.count_lines(spark, str(tmp_path / "x.jsonl")) == 5 and J.count_lines(spark, str(tmp_path / "none")) == 0


def test_append_keeps_nulls(spark, tmp_path):
    out = str(tmp_path / "o")
    for _ in range(2):
        J.append_lines(spark.createDataFrame([("m", "da", "1", None)], "model string, strategy string, question_id string, sc_result string"), out)
    assert J.count_lines(spark, out) == 2
    assert '"sc_result":null' in next((tmp_path / "o" / "model=m" / "strategy=da").glob("*.json")).read_text()


def test_array_sink_and_manifest(spark, tmp_path):
    J.write_array(spark.createDataFrame([(1, "é"), (2, None)], "a int, b string").orderBy("a"), str(tmp_path / "a.json"))
    assert json.loads((tmp_path / "a.json").read_text()) == [{"a": 1, "b": "é"}, {"a": 2, "b": None}]
    import hashlib

    good = hashlib.md5((tmp_path / "a.json").read_bytes()).hexdigest()
    (tmp_path / "sums.md5").write_text(f"{good}  a.json\n{'0' * 32}  b.json\n")
    assert [r.file for r in J.mismatches(spark, str(tmp_path / "*.json"), str(tmp_path / "sums.md5")).collect()] == ["b.json"]


def test_archive(tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "a.tgz", "w:gz") as tar:
        for name in ("d/set-dev.json", "d/other.json", "../set-x.txt", "../../set-up.json"):
            info = tarfile.TarInfo(name)
            info.size = 2
            tar.addfile(info, io.BytesIO(b"{}"))
    assert J.stage_archive(str(tmp_path / "a.tgz"), str(tmp_path / "out"), "set") == ["set-dev.json", "set-up.json"]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["set-dev.json", "set-up.json"]


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text(json.dumps({"data": {}, "models": {"m": {"path": "p"}}, "strategies": ["da", "sc"], "inference": {}, "output": {}}))
    c = settings.load(str(tmp_path / "c.yaml"))
    assert settings.model(c, "m") == {"path": "p"}
    with pytest.raises(KeyError):
        settings.model(c, "x")
    (tmp_path / "d.yaml").write_text("{}")
    with pytest.raises(ValueError):
        settings.load(str(tmp_path / "d.yaml"))
    assert settings.subset(None, ["a", "b"]) == ["a", "b"] and settings.subset(["b"], ["a", "b"]) == ["b"]
    with pytest.raises(ValueError):
        settings.subset(["z"], ["a"])
