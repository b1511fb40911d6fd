"""Packages: the identities, files and tables that a study was run on, bound by digests, as small JSON artifacts beside the tables."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
from dataclasses import asdict, dataclass, fields, is_dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import duplicates
from ..schema import empty_or_fail
from .feeds import IDENTITY, ROLES, canonical, check_delistings, digest, read_feed, schema_of, table_digest

#: Records that one JSON artifact may hold; larger books are tables, see feeds.dump_book.
MOST_RECORDS = 100_000
BOOK_ROLES, EVIDENCE_ROLES = ("market", "universe", "labels"), ("returns", "costs")


def encode_time(value):
    """A time as JSON: numbers and text as they are, datetimes tagged, so that they come back as what they were."""
    return {"kind": "datetime", "value": value.isoformat()} if isinstance(value, dt.datetime) else value


def decode_time(value):
    if not isinstance(value, dict):
        return value
    if set(value) != {"kind", "value"} or value["kind"] != "datetime" or not isinstance(value["value"], str):
        raise ValueError(f"not an encoded time: {value}")
    return dt.datetime.fromisoformat(value["value"])


def callable_identity(f) -> str:
    """module:qualified name; what has no name that can be found again has no identity."""
    name = f"{f.__module__}:{f.__qualname__}"
    if "<" in name:
        raise ValueError(f"{name} cannot be found again by its name")
    return name


def config_fingerprint(config) -> str:
    """A digest of a configuration's class and fields, callables by name; equal configurations have equal fingerprints."""

    def plain(x):
        if is_dataclass(x) and not isinstance(x, type):
            return {"class": type(x).__name__, **{f.name: plain(getattr(x, f.name)) for f in fields(x) if f.repr}}
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        return callable_identity(x) if callable(x) else x

    return digest(plain(config))


def _sealed(schema: str, body: dict) -> dict:
    made = {"schema": schema, "version": 1, **body}
    return made | {"digest": digest(made)}


def _opened(payload: str, schema: str, keys: set[str]) -> dict:
    """The body of an artifact whose keys are exactly those declared, and whose digest holds."""
    found = json.loads(payload)
    if not isinstance(found, dict) or set(found) != {"schema", "version", "digest", *keys} or (found["schema"], found["version"]) != (schema, 1):
        raise ValueError(f"not a {schema} of version 1 with exactly the declared keys")
    if digest({k: v for k, v in found.items() if k != "digest"}) != found["digest"]:
        raise ValueError(f"the {schema} was changed")
    return {k: found[k] for k in keys}


def dump_records(tables: dict[str, DataFrame], roles: tuple[str, ...], schema: str) -> str:
    """Tables of a book or of economic evidence as one canonical JSON text; bounded, as it is made on the driver."""
    body = {}
    for role in roles:
        rows = tables[role].select(*schema_of(role).fieldNames()).orderBy(*IDENTITY[role], "source_revision").limit(MOST_RECORDS + 1).collect()
        if len(rows) > MOST_RECORDS:
            raise ValueError(f"{role} has too many records for one artifact")
        body[role] = [r.asDict(recursive=True) for r in rows]
    return canonical(_sealed(schema, body))


def load_records(spark: SparkSession, payload: str, roles: tuple[str, ...], schema: str) -> dict[str, DataFrame]:
    """What dump_records wrote; a record with other keys than its role's, or a repeated revision, is an error."""
    body, out = _opened(payload, schema, set(roles)), {}
    for role in roles:
        names = schema_of(role).fieldNames()
        if any(set(r) != set(names) for r in body[role]):
            raise ValueError(f"{role}: keys differ from the declared ones")
        out[role] = spark.createDataFrame([tuple(r[c] for c in names) for r in body[role]], ROLES[role])
        empty_or_fail(duplicates(out[role], [*IDENTITY[role], "source_revision"]), f"{role}: repeated revision")
    return out


@dataclass(frozen=True)
class Timeline:
    """When a study decides what, and which members it expects then."""

    decision_times: tuple
    target_ids: tuple[str, ...]
    expected: tuple[tuple[str, ...], ...] | None = None

    def __post_init__(self):
        if len(self.decision_times) != len(self.target_ids) or (self.expected is not None and len(self.expected) != len(self.target_ids)):
            raise ValueError("a timeline's columns have one length")
        if any(a >= b for a, b in zip(self.decision_times, self.decision_times[1:], strict=False)) or len(set(self.target_ids)) != len(self.target_ids):
            raise ValueError("decision times rise and targets are unique")

    def to_json(self) -> str:
        expected = None if self.expected is None else [list(e) for e in self.expected]
        return canonical(_sealed("timeline", {"decision_times": [encode_time(t) for t in self.decision_times], "target_ids": list(self.target_ids), "expected": expected}))

    @classmethod
    def from_json(cls, payload: str) -> Timeline:
        body = _opened(payload, "timeline", {"decision_times", "target_ids", "expected"})
        expected = None if body["expected"] is None else tuple(map(tuple, body["expected"]))
        return cls(tuple(map(decode_time, body["decision_times"])), tuple(body["target_ids"]), expected)

    def table(self, spark: SparkSession) -> DataFrame:
        """decision_time, target_id, expected, as plans.govern.preflight reads it."""
        rows = list(zip(self.decision_times, self.target_ids, map(list, self.expected or [()] * len(self.target_ids)), strict=True))
        kind = "timestamp" if self.decision_times and isinstance(self.decision_times[0], dt.datetime) else "long"
        return spark.createDataFrame(rows, f"decision_time {kind}, target_id string, expected array<string>")


@dataclass(frozen=True)
class RunManifest:
    """The identities that make up one run; all of them are needed."""

    run_id: str
    input_vintage_id: str
    universe_id: str
    config_id: str
    backend_id: str
    dependency_id: str
    seed_id: str
    thread_id: str

    def __post_init__(self):
        if not all(str(v).strip() for v in asdict(self).values()):
            raise ValueError("a run needs all of its identities")

    @property
    def digest(self) -> str:
        return digest(asdict(self))

    def to_json(self) -> str:
        return canonical(_sealed("run", asdict(self)))

    @classmethod
    def from_json(cls, payload: str) -> RunManifest:
        return cls(**_opened(payload, "run", {f.name for f in fields(cls)}))


PROVENANCE = {"provider", "dataset_id", "vintage_id", "retrieved_at", "license"}


def make_package(run: RunManifest, study_identity: str, timeline: Timeline, provenance: dict, files: dict[str, str], tables: dict[str, DataFrame]) -> dict:
    """One artifact that binds a run, a study's windows, its timeline, where the data come from, each file and each table."""
    if set(provenance) != PROVENANCE or not all(str(v).strip() for v in provenance.values()):
        raise ValueError(f"a provenance has exactly {sorted(PROVENANCE)}")
    if missing := set(ROLES) - set(files):
        raise ValueError(f"roles missing: {sorted(missing)}")
    if len({os.path.basename(p) for p in files.values()}) != len(files):
        raise ValueError("artifact ids are unique")
    artifacts = {role: {"artifact_id": os.path.basename(p), **_file(p)} for role, p in sorted(files.items())}
    body = {"run": json.loads(run.to_json()), "study": study_identity, "timeline": json.loads(timeline.to_json()), "provenance": provenance | {"retrieved_at": encode_time(provenance["retrieved_at"])}}
    return _sealed("package", body | {"artifacts": artifacts, "tables": {n: table_digest(df) for n, df in sorted(tables.items())}})


def _file(path: str) -> dict:
    data = Path(path).read_bytes()
    return {"bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}


def open_package(payload: str, files: dict[str, str], tables: dict[str, DataFrame], study_identity: str) -> dict:
    """The body of a package, once its files are exactly those it names and unchanged, its tables too, and the study is the one it was made for."""
    body = _opened(payload, "package", {"run", "study", "timeline", "provenance", "artifacts", "tables"})
    if body["study"] != study_identity:
        raise ValueError("the package of another study")
    if {os.path.basename(p) for p in files.values()} != {a["artifact_id"] for a in body["artifacts"].values()}:
        raise ValueError("the files are not exactly the package's")
    for role, path in files.items():
        if _file(path) != {k: body["artifacts"][role][k] for k in ("bytes", "sha256")}:
            raise ValueError(f"artifact {role} was changed")
    for name, df in tables.items():
        if table_digest(df) != body["tables"].get(name):
            raise ValueError(f"table {name} was changed")
    RunManifest.from_json(canonical(body["run"]))
    Timeline.from_json(canonical(body["timeline"]))
    return body


def normalise_handoff(spark: SparkSession, folder: str, run: RunManifest, study_identity: str, timeline: Timeline, provenance: dict) -> tuple[dict, dict[str, DataFrame]]:
    """A vendor's six role files as validated tables and the package that binds them; anything missing, extra or malformed is an error."""
    feed = read_feed(spark, folder)
    check_delistings(feed["delistings"], feed["universe"])
    late = feed["delistings"].where("event_time > available_time or delisting_time > available_time or trim(delisting_reason) = ''")
    empty_or_fail(late.select("instrument_id"), "a delisting known before it happened, or without a reason")
    files = {role: f"{folder}/{role}.jsonl" for role in ROLES}
    return make_package(run, study_identity, timeline, provenance, files, feed), feed


def intake(package: dict, files: dict[str, str], tables: dict[str, DataFrame], study, check, phases: tuple[str, ...] | None = None) -> dict[str, dict]:
    """A receipt for every phase before the holdout, which is neither read nor opened: what ``check(study, phase)`` finds, with the package's digest."""
    open_package(canonical(package), files, tables, study.identity)
    names = phases or tuple(p for p in study.phases if p != study.holdout)
    if study.holdout in names:
        raise PermissionError("the holdout is not taken in")
    made = {p: {"phase": p, "package": package["digest"], "found": check(study, p)} for p in names}
    return {p: r | {"digest": digest(r)} for p, r in made.items()}


def _as_json(x):
    if isinstance(x, np.ndarray):
        return {"array": x.tolist()}
    if isinstance(x, tuple):
        return {"tuple": [_as_json(v) for v in x]}
    if isinstance(x, dict):
        return {"dict": [[k, _as_json(v)] for k, v in x.items()]}
    return [_as_json(v) for v in x] if isinstance(x, list) else x


def _of_json(x):
    if isinstance(x, dict):
        (kind, v), = x.items()
        if kind == "array":
            return np.array(v, float)
        return tuple(map(_of_json, v)) if kind == "tuple" else {k: _of_json(w) for k, w in v}
    return [_of_json(v) for v in x] if isinstance(x, list) else x


def component_state(machine, state: dict) -> dict:
    """A machine's state as a JSON payload, bound to the machine's configuration; for plans.govern.save_checkpoint."""
    return {"machine": type(machine).__name__, "config": config_fingerprint(machine), "state": _as_json(state)}


def restore_component(machine, payload: dict) -> dict:
    """The state for a machine of the same class and configuration; any other is an error."""
    if set(payload) != {"machine", "config", "state"} or (payload["machine"], payload["config"]) != (type(machine).__name__, config_fingerprint(machine)):
        raise ValueError("the state of another component")
    return _of_json(payload["state"])


def window_of(df: DataFrame, study, phase: str, index: str = "decision_index") -> DataFrame:
    """Rows of a phase, with its name."""
    return study.phase(df, phase, index).withColumn("phase", F.lit(phase))
