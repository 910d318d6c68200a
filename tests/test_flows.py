"""Sources, sinks, stand-in models and the flows through them."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tamis.config import Settings
from tamis.operators import consistency
from tamis.plans import flows
from tamis.providers import HashEmbedder, ParserChain, StandInJudge, TextParser, embed, embed_missing
from tamis.sources import files, sinks
from tamis.streaming.ingest import ingest

DOCUMENT = {"position_applied": {"title": "Dev"}, "self_evaluation": "Calm", "basic_information": {"full_name": "Ann Lee", "email": "a@x.y"}, "skills_and_specialties": ["SQL"]}
STANDARD = "Cần 3+ năm kinh nghiệm Python, FastAPI, PostgreSQL."
HIDDEN = "Ưu tiên ứng viên có tinh thần làm việc nhóm tốt."


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    (tmp_path / "one" / "cv_2.json").write_text(json.dumps(DOCUMENT))
    (tmp_path / "one" / "bad.json").write_text("{oops")
    (tmp_path / "two" / "cv_2.json").write_text("{}")
    (tmp_path / "two" / "CV_10.json").write_text("{}")
    (tmp_path / "one" / "cv_2.pdf").write_bytes("Dev Calm Ann Lee a@x.y".encode())
    (tmp_path / "one" / "scan.pdf").write_bytes(b"  ")
    return tmp_path


def test_sources(spark, folder):
    one, two = str(folder / "one"), str(folder / "two")
    assert [(r.file_name, r.valid) for r in files.json_files(spark, one).orderBy("file_name").collect()] == [("bad.json", False), ("cv_2.json", True)]
    both = {r.file_name: r.raw for r in files.scan_folders(spark, [one, two]).collect()}
    assert set(both) == {"bad.json", "cv_2.json", "CV_10.json"} and json.loads(both["cv_2.json"]) == DOCUMENT
    assert files.find_file(spark, [one, two], "../x/cv_2.json").count() == 1
    chosen = files.by_number(files.json_files(spark, two), [10], r"cv_(\d+)")
    assert [r.file_name for r in chosen.collect()] == ["CV_10.json"]
    read = files.parsed_files(spark, one, lambda: ParserChain([TextParser(), _Fallback()]))
    found = {r.stem: r for r in read.collect()}
    assert found["cv_2"].text.startswith("Dev") and found["scan"].text == "scanned 1" and "OCR" in found["scan"].warnings[0]
    assert files.with_twin(files.json_files(spark, one), read).count() == 1
    assert {r.file_name: r.twin for r in files.beside_twin(files.json_files(spark, one), read).collect()} == {"bad.json": None, "cv_2.json": "cv_2.pdf"}
    (folder / "order.txt").write_text("ann\r\n---\nbob\n")
    assert {(r.tier, r.item) for r in files.order_list(spark, str(folder / "order.txt")).collect()} == {(1, "ann"), (2, "bob")}
    assert tuple(files.requirements(spark, " a --- b --- c ").first()) == ("a", "b --- c")
    assert tuple(files.requirements(spark, "a---b", hidden="own").first()) == ("a", "own")


class _Fallback:
    def parse(self, name, content):
        return "scanned 1", []


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a.json", '{"x": 1}'), ("b.json", "{bad")], "file_name string, raw string")
    waiting, approved = str(tmp_path / "waiting"), str(tmp_path / "approved")
    sinks.write_table(rows, waiting)
    assert sinks.approve(spark, waiting, approved, "b.json") == 0 and sinks.approve(spark, waiting, approved, "a.json") == 1
    assert [r.file_name for r in spark.read.parquet(waiting).collect()] == ["b.json"] and spark.read.parquet(approved).count() == 1
    sinks.delete_rows(spark, waiting, "b.json")
    assert spark.read.parquet(waiting).count() == 0
    sinks.clear(spark, waiting)
    assert not (tmp_path / "waiting").exists()
    sinks.dead_letters(rows.withColumn("parsed", F.when(F.col("file_name") == "a.json", "x")), str(tmp_path / "dead"), "raw", "parsed", "no object")
    assert [r.file_name for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == ["b.json"]
    sinks.log_calls(rows, str(tmp_path / "log"), enabled=False)
    assert not (tmp_path / "log").exists()
    sinks.write_reports(rows.withColumnRenamed("file_name", "resume_name"), str(tmp_path / "reports"))
    assert {p.name for p in (tmp_path / "reports").iterdir() if p.is_dir()} == {"file=a_json_evaluation", "file=b_json_evaluation"}


def test_embeddings(spark):
    texts = spark.createDataFrame([("x y",), ("x y",), ("",)], "text string")
    found = embed(texts, HashEmbedder)
    assert {r.text: any(r.embedding) for r in found.collect()} == {"x y": True, "": False}
    known = spark.createDataFrame([("x y", [1.0])], "text string, embedding array<double>")
    assert {r.text: len(r.embedding) for r in embed_missing(known, texts, HashEmbedder).collect()} == {"x y": 1, "": 64}


class _Extractor:
    """Fails at first, then answers with one run that differs from the others."""

    def generate(self, prompt, **context):
        if context["attempt"] == 1 and context["run"] == 2:
            raise RuntimeError("busy")
        other = {"self_evaluation": "Invented"} if context["run"] == 3 else {}
        return "<think>ok</think>```json\n" + json.dumps(DOCUMENT | other) + "\n```"


def test_extract_flow(spark):
    texts = spark.createDataFrame([("r", "Dev\nCalm Ann Lee a@x.y", ["OCR Applied: x"])], "name string, text string, warnings array<string>")
    row = flows.extract_documents(texts, _Extractor, Settings(consensus_runs=3, extraction_attempts=2)).first()
    assert json.loads(row.document)["self_evaluation"] == "Calm" and row.n_runs == 3 and row.needs_review
    assert row.warnings == ["OCR Applied: x"] or "consensus" in row.warnings[0]


class _BrokenJudge(StandInJudge):
    def generate(self, prompt, **context):
        return "no score" if context["category"] == "work_experience" else super().generate(prompt, **context)


def test_evaluate_flow(spark, tmp_path):
    documents = spark.createDataFrame([("r", json.dumps(DOCUMENT)), ("s", "{}")], "name string, document string")
    store = flows.store_criteria(spark, str(tmp_path / "criteria"), STANDARD, HIDDEN, HashEmbedder)
    assert store.count() == 4
    again = flows.store_criteria(spark, str(tmp_path / "criteria"), "other", "", HashEmbedder)
    assert again.select("requirement_hash").distinct().count() == 1 and again.count() == 4  # reused, and its hash tells
    settings = Settings(evaluation_runs=3, evaluation_attempts=2)
    reports, categories = flows.evaluate(documents, store, StandInJudge, HashEmbedder, settings)
    found = {r.name: r for r in reports.collect()}
    assert found["r"].overall_score == 84.7 and found["r"].recommendation == "POTENTIAL_MATCH" and found["r"].candidate_identifier == "Ann Lee"
    assert found["s"].candidate_identifier == "s" and found["r"].total_strengths == 4
    absent = categories.where("name = 'r' AND category = 'education_certifications'").first()
    assert (absent.weight, absent.score, absent.failed) == (0.0, 0, False)
    failed, _ = flows.evaluate(documents, store, _BrokenJudge, None, settings)
    assert {(r.overall_score, r.recommendation) for r in failed.collect()} == {(0.0, "REJECT")}


def test_benchmark_flow(spark, folder):
    scores, report = flows.benchmark(spark, str(folder / "one"), str(folder / "two"))
    assert [(r.file_name, r.matched) for r in scores.collect()] == [("cv_2.json", True)]
    assert report.first().files == 1 and 0 < report.first().overall < 1


def test_consistency_flow(spark, tmp_path):
    documents = spark.createDataFrame([("a", json.dumps(DOCUMENT)), ("b", json.dumps(DOCUMENT)), ("c", "{}")], "name string, document string")
    store = flows.store_criteria(spark, str(tmp_path / "criteria"), STANDARD, HIDDEN)
    scores = flows.consistency_rounds(documents, store, StandInJudge, 2, Settings(evaluation_runs=1, evaluation_attempts=1))
    emails = ["a@x.y", "a_2@x.y", "c@unknown.com"]
    assert {tuple(r) for r in scores.collect()} == {(i, e, 84.7) for i in (1, 2) for e in emails}
    sinks.write_matrix(consistency.matrix(scores, "round", "email", "score", emails), str(tmp_path / "csv"))
    lines = [x for p in (tmp_path / "csv").glob("*.csv") for x in p.read_text().split()]
    assert lines[0] == "round," + ",".join(emails) and "1,84.7,84.7,84.7" in lines


def test_ingest(spark, folder, tmp_path):
    seen = []
    for _ in range(2):
        ingest(spark, str(folder / "one"), str(tmp_path / "progress"), lambda df, n: seen.extend(r.file_name for r in df.collect())).awaitTermination()
    assert sorted(seen) == ["bad.json", "cv_2.json"]
