"""Version scans, phase markers, evaluation sets and reports on files of their own."""

import json

import pytest
from pyspark.sql import functions as F

from lattica.sources import moved_metrics, phase_status, read_golden_set, scan_versions, write_report


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_versions_with_any_analysis_file_are_listed(spark, tmp_path):
    for name in ("v1/artists/report.txt", "v1/labels/violations.jsonl", "v1/masters/other.txt", "v2/artists/skipped.jsonl", "v3/artists/notes.txt"):
        put(tmp_path / name, "")
    assert rows(scan_versions(spark, str(tmp_path))) == [("v1", ["artists", "labels"]), ("v2", ["artists"])]


def test_phases_come_from_markers(spark, tmp_path):
    put(tmp_path / "extraction_status_7.json", json.dumps({"load_phase": {"status": "done"}, "parse_phase": {}, "note_phase": "x", "other": {"status": "done"}}, indent=1))
    put(tmp_path / "deep" / "mb_extraction_status_8.json", json.dumps({"load_phase": {"status": "failed", "at": 3}}))
    put(tmp_path / "extraction_status_9.json", "{broken")
    assert rows(phase_status(spark, str(tmp_path))) == [("7", "load_phase", "done"), ("7", "parse_phase", "unknown"), ("8", "load_phase", "failed")]


def test_golden_set_becomes_tables(spark, tmp_path):
    release = {"id": "r1", "title": "t", "artist_ids": ["a1", "a2"], "label_id": "l1", "master_id": None, "year": 1990, "genres": ["g"], "styles": [], "medium": "m", "have_count": 1, "want_count": 2, "unknown": 5}
    put(tmp_path / "catalog.json", json.dumps({"labels": [{"id": "l1", "name": "L", "release_count": 1}], "artists": [], "masters": [], "releases": [release]}, indent=2))
    put(tmp_path / "collectors.json", json.dumps({"collectors": [{"id": "c1", "name": "C", "taste_genres": ["g"], "collected": [{"release_id": "r1", "date_added": "2020-02-03"}], "wants": ["r2", "r3"]}]}))
    got = read_golden_set(spark, str(tmp_path / "catalog.json"), str(tmp_path / "collectors.json"))
    assert {k: df.count() for k, df in got.items()} == {"labels": 1, "artists": 0, "masters": 0, "releases": 1, "collectors": 1, "collected": 1, "wants": 2}
    assert got["releases"].select("artist_ids", "master_id", "year").first() == (["a1", "a2"], None, 1990)
    assert rows(got["collected"].withColumn("date_added", F.col("date_added").cast("string"))) == [("c1", "r1", "2020-02-03")]
    put(tmp_path / "catalog.json", "[broken")
    with pytest.raises(Exception, match="(?i)malformed|failfast|parse"):
        got["releases"].collect()


def test_reports_are_compared_within_a_tolerance(spark, tmp_path):
    schema = "policy string, precision double, listed long, note string"
    write_report(spark.createDataFrame([("a", 0.5, 3, "x"), ("b", None, 4, "x"), ("gone", 1.0, 1, "x")], schema), str(tmp_path / "report"))
    before = spark.read.schema(schema).json(str(tmp_path / "report"))
    assert len(list((tmp_path / "report").glob("*.json"))) == 1
    after = spark.createDataFrame([("a", 0.5 + 1e-12, 3, "y"), ("b", 0.1, 5, "x"), ("new", 1.0, 1, "x")], schema)
    assert rows(moved_metrics(before, after, ["policy"])) == [("b", "listed", 4.0, 5.0), ("b", "precision", None, 0.1), ("gone", "listed", 1.0, None), ("gone", "precision", 1.0, None), ("new", "listed", None, 1.0), ("new", "precision", None, 1.0)]
