"""Sealed holdouts, certificates, checkpoints and audit logs."""

from __future__ import annotations

import json

import pytest

from sparkwake.plans import govern


def test_holdout_opens_once_with_its_identity(spark):
    study = govern.Study({"train": (0, 10), "test": (12, 20), "holdout": (22, 30)}, embargo=2)
    timeline = spark.range(30).withColumnRenamed("id", "decision_index")
    assert study.phase(timeline, "test").count() == 8
    with pytest.raises(PermissionError):
        study.phase(timeline, "holdout")
    with pytest.raises(ValueError):
        study.open_holdout("other", "final run")
    study.open_holdout(study.identity, "final run")
    assert study.phase(timeline, "holdout").count() == 8
    with pytest.raises(ValueError, match="already"):
        study.open_holdout(study.identity, "again")
    with pytest.raises(ValueError, match="embargo"):
        govern.Study({"train": (0, 10), "holdout": (11, 20)}, embargo=2)


def test_certificate_needs_other_seeds_and_a_low_upper_end():
    assert govern.wilson_interval(2, 64)[1] == pytest.approx(0.106973, abs=1e-6)
    assert govern.Certificate(2.0, 2, 64, 0.15, 1, 2).approved
    assert not govern.Certificate(2.0, 2, 64, 0.15, 1, 1).approved
    assert not govern.Certificate(2.0, 2, 64, 0.10, 1, 2).approved


def test_checkpoint_is_signed_and_confined(tmp_path):
    govern.save_checkpoint(str(tmp_path), "c.json", {"a": [1, 2]}, b"k")
    assert govern.load_checkpoint(str(tmp_path), "c.json", b"k") == {"a": [1, 2]}
    with pytest.raises(ValueError, match="changed"):
        govern.load_checkpoint(str(tmp_path), "c.json", b"other")
    with pytest.raises(ValueError, match="inside"):
        govern.save_checkpoint(str(tmp_path), "../c.json", {}, b"k")
    (tmp_path / "link.json").symlink_to(tmp_path / "c.json")
    with pytest.raises(ValueError, match="link"):
        govern.load_checkpoint(str(tmp_path), "link.json", b"k")


def test_audit_log_is_chained_and_redacted(tmp_path):
    log = govern.AuditLog()
    log.append("start", {"api_key": "x", "nested": [{"Password": "y", "n": 1}]})
    log.append("end", {})
    log.verify()
    assert "x" not in json.dumps(log.records[0]["payload"]["api_key"]) and log.records[0]["payload"]["nested"][0] == {"Password": "[redacted]", "n": 1}
    log.to_jsonl(str(tmp_path / "log.jsonl"))
    assert (tmp_path / "log.jsonl").stat().st_mode & 0o777 == 0o600
    log.records[0]["payload"]["nested"] = []
    with pytest.raises(ValueError, match="record 0"):
        log.verify()


def test_preflight_finds_leaks_and_universe_gaps(spark):
    timeline = spark.createDataFrame([(5, "t1", ["a"])], "decision_time long, target_id string, expected array<string>")
    members = spark.createDataFrame([("a", 0, None)], "instrument_id string, start long, end long")
    decisions = timeline.select("target_id")
    labels = lambda at: spark.createDataFrame([("t1", at)], "target_id string, available_time long")
    assert govern.preflight(timeline, labels(6), members, decisions) == {"decisions": 1}
    with pytest.raises(ValueError, match="visible"):
        govern.preflight(timeline, labels(5), members, decisions)
    with pytest.raises(ValueError, match="no member"):
        govern.preflight(timeline, labels(6), members.where("false"), decisions)


def test_package_detects_changed_bytes(tmp_path):
    f = tmp_path / "a.bin"
    f.write_bytes(b"1")
    package = govern.package_artifacts({"data": str(f)}, {"data"})
    govern.verify_package(package)
    f.write_bytes(b"2")
    with pytest.raises(ValueError, match="changed"):
        govern.verify_package(package)
    with pytest.raises(ValueError, match="missing"):
        govern.package_artifacts({}, {"data"})
