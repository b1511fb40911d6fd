"""Artifacts come back as they were, and nothing else does."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass

import pytest

from sparkwake.functions import steps, topology
from sparkwake.plans import govern
from sparkwake.sources import feeds, packages

RUN = packages.RunManifest(*"abcdefgh")
TIMELINE = packages.Timeline((1, 5), ("t1", "t2"), (("i",), ("i",)))
PROVENANCE = {"provider": "p", "dataset_id": "d", "vintage_id": "v", "retrieved_at": dt.datetime(2024, 1, 2), "license": "l"}
EVENT = {"event_time": 1, "available_time": 2, "source_revision": 0, "ingest_sequence": 0}
ROWS = {
    "market": {"record_id": "m", "instrument_id": "i", "fields": {"x": 1.5}, **EVENT},
    "labels": {"label_id": "l", "target_id": "t1", "received_time": 3, "status": "observed", "value": 1.0, **EVENT},
    "universe": {"instrument_id": "i", "start": 0, "end": None, **EVENT},
    "returns": {"target_id": "t1", "decision_time": 1, "realization_time": 2, "available_time": 2, "value": 0.5, "source_revision": 0, "status": "observed"},
    "costs": {"target_id": "t1", "decision_time": 1, "execution_time": 1, "available_time": 1, "cost_model_id": "c", "source_revision": 0, "capacity_limit": None}
    | {f"{r}_rate": 0.0 for r in ("fee", "spread", "slippage", "impact", "other")},
    "delistings": {"instrument_id": "i", "delisting_time": 1, "delisting_return": -0.5, "delisting_reason": "gone", **EVENT},
}


@pytest.fixture
def study():
    return govern.Study({"train": (0, 4), "test": (4, 8), "holdout": (8, 9)})


@pytest.fixture
def folder(tmp_path):
    for role, row in ROWS.items():
        (tmp_path / f"{role}.jsonl").write_text(json.dumps(row) + "\n")
    return tmp_path


def test_times_keep_their_kind():
    for t in (3, 2.5, "2024-01-01", dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)):
        assert packages.decode_time(json.loads(json.dumps(packages.encode_time(t)))) == t
    with pytest.raises(ValueError, match="encoded time"):
        packages.decode_time({"kind": "date", "value": "x"})


def test_timelines_and_runs(spark):
    assert packages.Timeline.from_json(TIMELINE.to_json()) == TIMELINE
    assert packages.RunManifest.from_json(RUN.to_json()) == RUN
    assert TIMELINE.table(spark).count() == 2
    with pytest.raises(ValueError, match="rise"):
        packages.Timeline((5, 1), ("a", "b"))
    with pytest.raises(ValueError, match="changed"):
        packages.RunManifest.from_json(RUN.to_json().replace('"run_id":"a"', '"run_id":"z"'))
    with pytest.raises(ValueError, match="declared keys"):
        packages.Timeline.from_json(json.dumps(json.loads(TIMELINE.to_json()) | {"more": 1}))


def test_fingerprints_name_callables():
    @dataclass
    class Config:
        f: object
        x: int = 1

    assert packages.callable_identity(feeds.digest) == "sparkwake.sources.feeds:digest"
    assert packages.config_fingerprint(Config(feeds.digest)) != packages.config_fingerprint(Config(feeds.canonical))
    with pytest.raises(ValueError, match="cannot be found"):
        packages.config_fingerprint(Config(lambda: 0))


def test_books_and_evidence_as_json(spark, folder):
    feed = feeds.read_feed(spark, str(folder))
    for roles, schema in ((packages.BOOK_ROLES, "book"), (packages.EVIDENCE_ROLES, "evidence")):
        text = packages.dump_records(feed, roles, schema)
        back = packages.load_records(spark, text, roles, schema)
        assert packages.dump_records(back, roles, schema) == text
        with pytest.raises(ValueError, match="changed"):
            packages.load_records(spark, text.replace('"source_revision":0', '"source_revision":1', 1), roles, schema)


def test_a_handoff_becomes_a_package(spark, folder, study):
    package, feed = packages.normalise_handoff(spark, str(folder), RUN, study.identity, TIMELINE, PROVENANCE)
    files = {role: str(folder / f"{role}.jsonl") for role in ROWS}
    receipts = packages.intake(package, files, feed, study, lambda s, p: len(s.phases[p]))
    assert list(receipts) == ["train", "test"] and all(r["package"] == package["digest"] for r in receipts.values())
    with pytest.raises(PermissionError):
        packages.intake(package, files, feed, study, lambda s, p: 0, ("holdout",))
    with pytest.raises(ValueError, match="another study"):
        packages.open_package(feeds.canonical(package), files, feed, "x")
    (folder / "labels.jsonl").write_text("")
    with pytest.raises(ValueError, match="labels was changed"):
        packages.open_package(feeds.canonical(package), files, {}, study.identity)


def test_delistings_are_not_known_before_they_happen(spark, folder, study):
    (folder / "delistings.jsonl").write_text(json.dumps(ROWS["delistings"] | {"delisting_time": 9}) + "\n")
    with pytest.raises(ValueError, match="known before"):
        packages.normalise_handoff(spark, str(folder), RUN, study.identity, TIMELINE, PROVENANCE)


@pytest.mark.parametrize("machine", [steps.RecursiveRun(2), steps.GateLifecycle(0.1), steps.SignatureMemory(2, (1, 2)), topology.TopologyDetector(cloud=5, least=3)])
def test_components_go_on_where_they_stopped(machine, tmp_path):
    rows = [{"step": t, "features": [t * 0.1, 1.0], "increment": [t * 0.1, 1.0], "target": t * 0.2, "available_step": t + 2, "event": "register", "challenger": f"c{t}"} for t in range(12)]
    whole, state = machine.start(), machine.start()
    for row in rows[:6]:
        machine.step(whole, row), machine.step(state, row)
    govern.save_checkpoint(str(tmp_path), "c", packages.component_state(machine, state), b"key")
    state = packages.restore_component(machine, govern.load_checkpoint(str(tmp_path), "c", b"key"))
    assert [repr(machine.step(state, r)) for r in rows[6:]] == [repr(machine.step(whole, r)) for r in rows[6:]]
    with pytest.raises(ValueError, match="another component"):
        packages.restore_component(steps.Cusum(1, 2), packages.component_state(machine, state))
