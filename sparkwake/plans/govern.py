"""Manifests, sealed holdouts, checkpoints, certificates and audit records: small driver-side artifacts bound by digests."""

from __future__ import annotations

import hashlib
import hmac
import json
import math
import os
import re
import tempfile
import threading
from collections import Counter
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.asof import place_in
from ..operators.metrics import WILSON_Z
from ..schema import empty_or_fail
from ..sources.feeds import canonical, digest

#: The largest checkpoint that is written or read.
CHECKPOINT_BYTES = 50 << 20
SECRET = re.compile(r"(?i)(password|secret|token|api_?key|credential|authorization)")


def wilson_interval(successes: int, trials: int, z: float = WILSON_Z) -> tuple[float, float]:
    if trials <= 0 or not 0 <= successes <= trials:
        raise ValueError("successes lie between 0 and a positive number of trials")
    p, zz = successes / trials, z * z
    middle = (p + zz / (2 * trials)) / (1 + zz / trials)
    half = z * math.sqrt(p * (1 - p) / trials + zz / (4 * trials * trials)) / (1 + zz / trials)
    return max(0.0, middle - half), min(1.0, middle + half)


@dataclass(frozen=True)
class Certificate:
    """What a calibration showed: approved only if the interval's upper end stays within the rate allowed, on other seeds than it was chosen on."""

    threshold: float
    alarms: int
    trials: int
    most: float
    chosen_on: int
    evaluated_on: int

    @property
    def approved(self) -> bool:
        return self.chosen_on != self.evaluated_on and wilson_interval(self.alarms, self.trials)[1] <= self.most

    @property
    def identity(self) -> str:
        return digest(asdict(self))


@dataclass
class Study:
    """Phases of a study as half-open ranges with an embargo between them; the last one is sealed until opened, once."""

    phases: dict[str, tuple[int, int]]
    embargo: int = 0
    holdout: str = "holdout"
    opened_by: str | None = None

    def __post_init__(self):
        ranges = list(self.phases.values())
        if self.holdout not in self.phases or any(a >= b for a, b in ranges):
            raise ValueError("phases are non-empty ranges and one is the holdout")
        if any(b[0] - a[1] < self.embargo for a, b in zip(ranges, ranges[1:], strict=False)):
            raise ValueError("phases are closer than the embargo")
        if list(self.phases)[-1] != self.holdout:
            raise ValueError("the holdout comes last")

    @property
    def identity(self) -> str:
        return digest({"phases": {k: list(v) for k, v in self.phases.items()}, "embargo": self.embargo, "holdout": self.holdout})

    def open_holdout(self, identity: str, reason: str) -> None:
        if identity != self.identity:
            raise ValueError("the holdout of another study")
        if self.opened_by is not None:
            raise ValueError("the holdout is open already")
        if not reason.strip():
            raise ValueError("opening the holdout needs a reason")
        self.opened_by = reason

    def phase(self, df: DataFrame, name: str, index: str = "decision_index") -> DataFrame:
        if name == self.holdout and self.opened_by is None:
            raise PermissionError("the holdout is sealed")
        start, end = self.phases[name]
        return df.where((F.col(index) >= start) & (F.col(index) < end))


def preflight(timeline: DataFrame, labels: DataFrame, memberships: DataFrame, decisions: DataFrame) -> dict[str, int]:
    """Checks before a phase runs: targets unique, no label known at its decision, the universe as expected, decisions covered.

    timeline: decision_time, target_id, expected (array of instruments); a phase's distinct decision times are few enough for the driver.
    Raises at the first breach, else returns counts.
    """
    empty_or_fail(timeline.groupBy("target_id").count().where("count > 1"), "repeated target")
    known = timeline.join(labels, "target_id").where("available_time <= decision_time").select("target_id")
    empty_or_fail(known, "label visible at its decision")
    wanted = timeline.select("decision_time", F.explode("expected").alias("instrument_id"))
    # a membership names the decisions that it holds: no pairs but those of the universe itself
    times = sorted(r[0] for r in timeline.select("decision_time").distinct().collect())
    until = F.when(F.col("end").isNull(), F.lit(len(times))).otherwise(place_in(times, F.col("end")))
    first = place_in(times, F.col("start"))
    held = F.slice(F.array(*[F.lit(t) for t in times]), first + 1, F.greatest(F.lit(0), until - first))
    active = memberships.select(F.explode(held).alias("decision_time"), "instrument_id")
    empty_or_fail(wanted.exceptAll(active).limit(1), "expected instrument is no member")
    empty_or_fail(active.exceptAll(wanted).limit(1), "member is not expected")
    empty_or_fail(timeline.join(decisions, "target_id", "left_anti").select("target_id"), "decision missing")
    return {"decisions": timeline.count()}


def save_checkpoint(root: str, name: str, payload: dict, key: bytes) -> str:
    """A signed checkpoint inside ``root``, written beside its place and then moved there."""
    place = _inside(root, name)
    body = canonical(payload)
    envelope = canonical({"payload": payload, "mac": hmac.new(key, body.encode(), hashlib.sha256).hexdigest(), "version": 1}).encode()
    if len(envelope) > CHECKPOINT_BYTES:
        raise ValueError("the checkpoint is too large")
    handle, temporary = tempfile.mkstemp(dir=place.parent)
    with os.fdopen(handle, "wb") as f:
        f.write(envelope)
        f.flush()
        os.fsync(f.fileno())
    os.chmod(temporary, 0o600)
    os.replace(temporary, place)
    return str(place)


def load_checkpoint(root: str, name: str, key: bytes) -> dict:
    place = _inside(root, name)
    if place.stat().st_size > CHECKPOINT_BYTES:
        raise ValueError("the checkpoint is too large")
    envelope = json.loads(place.read_text())
    if set(envelope) != {"payload", "mac", "version"} or envelope["version"] != 1:
        raise ValueError("not a checkpoint")
    if not hmac.compare_digest(envelope["mac"], hmac.new(key, canonical(envelope["payload"]).encode(), hashlib.sha256).hexdigest()):
        raise ValueError("the checkpoint was changed")
    return envelope["payload"]


def _inside(root: str, name: str) -> Path:
    base = Path(root).resolve()
    place = base / name
    if place.is_symlink() or base not in place.resolve().parents:
        raise ValueError("a checkpoint lies inside its root and is no link")
    return place


def redacted(payload):
    """Values under keys that name secrets are replaced, at any depth."""
    if isinstance(payload, dict):
        return {k: "[redacted]" if SECRET.search(str(k)) else redacted(v) for k, v in payload.items()}
    return [redacted(v) for v in payload] if isinstance(payload, list) else payload


@dataclass
class AuditLog:
    """Hash-chained records; export is atomic and only the owner can read it."""

    records: list[dict] = field(default_factory=list)
    _lock: threading.RLock = field(default_factory=threading.RLock, repr=False)

    def append(self, kind: str, payload: dict) -> str:
        with self._lock:
            body = {"index": len(self.records), "kind": kind, "payload": redacted(payload), "before": self.records[-1]["digest"] if self.records else "genesis"}
            self.records.append(body | {"digest": digest(body)})
            return self.records[-1]["digest"]

    def verify(self) -> None:
        before = "genesis"
        for i, r in enumerate(self.records):
            body = {k: v for k, v in r.items() if k != "digest"}
            if r["index"] != i or r["before"] != before or digest(body) != r["digest"]:
                raise ValueError(f"record {i} was changed")
            before = r["digest"]

    def to_jsonl(self, path: str) -> None:
        handle, temporary = tempfile.mkstemp(dir=Path(path).resolve().parent)
        with os.fdopen(handle, "w") as f:
            f.writelines(canonical(r) + "\n" for r in self.records)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(temporary, 0o600)
        os.replace(temporary, path)


class Metrics:
    """Counters and gauges of a run; safe to use from callback threads."""

    def __init__(self):
        self._lock, self._counts, self._gauges = threading.RLock(), Counter(), {}

    def count(self, name: str, by: int = 1) -> None:
        if by < 0:
            raise ValueError("counters only rise")
        with self._lock:
            self._counts[name] += by

    def gauge(self, name: str, value: float) -> None:
        if not math.isfinite(value):
            raise ValueError("a gauge is a finite number")
        with self._lock:
            self._gauges[name] = float(value)

    def snapshot(self) -> dict:
        with self._lock:
            return {"counts": dict(self._counts), "gauges": dict(self._gauges)}


def package_artifacts(files: dict[str, str], required: set[str]) -> dict:
    """Digests of the files behind each role; all required roles must be there."""
    if missing := required - set(files):
        raise ValueError(f"roles missing: {sorted(missing)}")
    return {role: {"path": path, "bytes": os.path.getsize(path), "sha256": hashlib.sha256(Path(path).read_bytes()).hexdigest()} for role, path in sorted(files.items())}


def verify_package(package: dict) -> None:
    for role, entry in package.items():
        data = Path(entry["path"]).read_bytes()
        if len(data) != entry["bytes"] or hashlib.sha256(data).hexdigest() != entry["sha256"]:
            raise ValueError(f"artifact {role} was changed")
