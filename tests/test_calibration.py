"""Reproducible trials, bootstraps and the feed template."""

from __future__ import annotations

import json

import numpy as np

from sparkwake.operators import calibration
from sparkwake.sources import feeds


def test_trials_do_not_depend_on_the_split(spark):
    simulate = lambda rng, trial: [(trial, t, float(x)) for t, x in enumerate(rng.normal(size=3))]
    rows = lambda at_once: sorted(map(tuple, calibration.monte_carlo(spark, 10, simulate, "trial long, t long, x double", seed=5, at_once=at_once).collect()))
    assert rows(2) == rows(10) and len(rows(3)) == 30


def test_null_crossing_rate_respects_its_level(spark):
    r = calibration.crossing_rate(calibration.sign_paths(spark, 1000, 100, "t"), 0.05, 0.5).first()
    assert r["trials"] == 1000 and r["low"] <= r["rate"] <= r["high"] < 0.10


def test_bootstrap_blocks_are_runs():
    index = calibration.block_bootstrap(np.random.default_rng(0), 50, 4000, 10.0)
    steps = np.diff(index) % 50
    assert index.min() >= 0 and index.max() < 50 and abs((steps != 1).mean() - 0.1) < 0.03


def test_template_is_a_valid_feed(spark, tmp_path):
    for path in feeds.write_template(str(tmp_path)):
        role = path.rsplit("/", 1)[1].removesuffix(".jsonl")
        assert set(json.loads(open(path).read())) == set(feeds.schema_of(role).fieldNames())
        assert feeds.read_role(spark, path, role).count() == 1
