"""What only larger tables show: many challengers and epochs, long series."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwake import registry
from sparkwake.functions import steps, topology
from sparkwake.operators import detect, folds, learning
from sparkwake.operators.folds import fold

from .oracle import same


@pytest.fixture(scope="module")
def crowd(tmp_path_factory):
    """A gate of over 1,100 challengers, whose shares are too small for floats in the end, over three epochs, and one of 40 with promotions."""
    folder, con = str(tmp_path_factory.mktemp("crowd")), duckdb.connect()
    con.sql(f"""copy (select i as event_id, timestamp '2024-01-01' + to_minutes(i::int) as ts, case when i % 3 = 0 then i // 3 % 40 else 100 + i * 7 % 1801 end as user_id,
     case when i % 3 = 0 then 'few' else 'many' end as event_type, case when i % 3 = 0 then 60 + i % 41 else i * 37 % 100 end::double as value, '' as props
     from range(5000) r(i)) to '{folder}/events.parquet'""")
    con.sql(f"create view events as select * from read_parquet('{folder}/events.parquet')")
    return folder, con


def test_a_share_too_small_for_a_float_is_never_reached():
    state, gate = (machine := steps.Gate(0.2)).start(), []
    for k in range(1500):
        gate.append(machine.step(state, {"challenger": f"c{k}", "score": 1.0}))
    assert gate[-1] == {"wealth": 1.5, "level": math.inf, "promoted": None, "open": True}
    assert gate[999]["level"] == 2.0**1001 / 0.2


def test_a_lifecycle_of_many_challengers_goes_on_over_epochs():
    state, gate = (machine := steps.GateLifecycle(0.2, 1.0)).start(), []
    do = lambda event, who=None, score=None: gate.append(machine.step(state, {"event": event, "challenger": who, "score": score})) or gate[-1]
    for k in range(1500):
        do("register", f"c{k}")
    do("seal")
    assert do("observe", "c1499", 1.0)["level"] == math.inf and do("observe", "c0", 1.0)["wealth"] == 2.0
    assert do("reset_challenger", "c1")["epoch"] == 1
    for k in range(1200):
        assert do("reset_epoch")["epoch"] == k + 2
    assert do("observe", "c0", 1.0) == {"epoch": 1201, "level": math.inf, "wealth": 2.0, "promoted": None, "incumbent": "incumbent", "open": True, "spent": gate[-1]["spent"], "taken": True}
    # all of epoch 0, the second slot's half of epoch 1, all of the epochs from 2 on
    assert gate[-1]["spent"] == pytest.approx(0.2 * (1 / 2 + 1 / 16 + 1 / 4), abs=1e-15)


@pytest.mark.parametrize("name", ["promotion_gate_fold", "gate_lifecycle"])
def test_gates_of_many_challengers_match_sql(spark, crowd, name):
    folder, con = crowd
    sql = registry.oracle_sql()[name]
    assert con.sql(f"select count(promoted) > 0 from ({sql})").fetchall() == [(True,)]
    same(registry.queries()[name](spark, folder), sql, con)


def test_rows_of_one_time_enter_a_gate_together(spark, tmp_path):
    """Each id stands twice, at first for one challenger, then for two, of whom only one crosses."""
    con = duckdb.connect()
    con.sql(f"""copy (select id + i // 120 * 1940 as event_id, case when id >= 6 and second then (id * 5 + 1) % 6 else id % 6 end as user_id,
     'gate' as event_type, case when user_id = 2 then 100 else 30 + id % 30 end::double as value
     from (select i, i % 120 // 2 + i // 120 * 60 as id, i % 2 = 1 as second from range(480) r(i)) order by second) to '{tmp_path}/events.parquet'""")
    con.sql(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    sql = registry.oracle_sql()["promotion_gate_fold"]
    assert con.sql(f"select list(distinct promoted) filter (promoted is not null), count(distinct t) from ({sql})").fetchall() == [(["2"], 240)]
    same(registry.queries()["promotion_gate_fold"](spark, str(tmp_path)), sql, con)


@pytest.mark.parametrize("step", [1, -1])
def test_ties_in_a_gate_do_not_hang_on_the_order_of_rows(spark, tmp_path, monkeypatch, step):
    """9 and 10 appear together and, by three rows each at t 7, cross together: slots go by challenger, as a number, and the promotion by slot."""
    monkeypatch.setattr(folds, "AT_ONCE", 1)
    events = [(t, who, "gate", 100.0) for t in [*range(8), 7, 7, 8] for who in (9, 10)][::step]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    made = registry.queries()["promotion_gate_fold"](spark, str(tmp_path)).collect()
    got = {(r["t"], r["level"], r["wealth"], r["promoted"], r["open"]) for r in made}
    moments = [(t, 1.5 ** (t + 1), None, True) for t in range(7)] + [(t, 1.5**10, "9", False) for t in (7, 8)]
    assert got == {(t, level, round(wealth, 6), promoted, open_) for t, wealth, promoted, open_ in moments for level in (4.321928, 5.321928)} and len(made) == 22


def rows(df):
    return {(r["s"], r["t"]): r for r in df.collect()}


@pytest.mark.parametrize("decay", [1.0, 0.9])
def test_persistent_stretches_equal_the_fold(spark, decay):
    x = F.round(F.sin("id") * 3 + F.col("id") % 7, 1)
    values = spark.range(180).select((F.col("id") % 2).alias("s"), F.col("id").alias("t"), F.array(F.when(F.col("id").between(60, 80), 0.0).otherwise(x), F.cos("id")).alias("features"))
    detector = topology.PersistentCusum(cloud=6, least=4, window=12, periods=4, threshold=2.0, decay=decay)
    whole, cut = rows(fold(values, ["s"], "t", detector)), rows(detect.persistent_path(values, ["s"], "t", detector, stretch=20))
    assert whole.keys() == cut.keys() and sum(r["ready"] for r in whole.values()) > 150
    for k, r in whole.items():
        assert (r["ready"], r["alarm"], r["state"] is None) == (cut[k]["ready"], cut[k]["alarm"], cut[k]["state"] is None)
        assert np.allclose([*(r["state"] or []), r["innovation"], r["score"], r["factor"]], [*(cut[k]["state"] or []), cut[k]["innovation"], cut[k]["score"], cut[k]["factor"]], atol=1e-6)


def test_a_graph_of_a_cloud_is_looked_at_once():
    x = np.random.default_rng(1).exponential(size=4001)
    detector, seen = topology.PersistentCusum(cloud=8, least=6), topology._state_of_graph
    seen.cache_clear()
    ready = detector.innovations(np.stack([x[1:], x[:-1]], axis=1), 0)[1]
    assert ready.sum() == 4000 - 5 - 12 and seen.cache_info().misses < 1000


def bisected(values, scale, rounds=80):
    """The root that plain bisection finds."""
    v, low, high = np.asarray(values, float), min(values), max(values)
    for _ in range(rounds):
        middle = low + (high - low) / 2
        z = (v - middle) / scale
        total = np.log((1 + z + z * z / 2) / (1 - z + z * z / 2)).sum()
        low, high = (middle if total >= -steps.ROOT else low), (middle if total <= steps.ROOT else high)
    return low + (high - low) / 2


def test_catoni_means_are_the_roots_that_bisection_finds(monkeypatch):
    rng, looks, influence = np.random.default_rng(2), [], steps._influence
    monkeypatch.setattr(steps, "_influence", lambda v, *rest: looks.append(len(v)) or influence(v, *rest))
    kinds = [rng.exponential, lambda size: rng.standard_cauchy(size) * 3, lambda size: rng.integers(0, 2, size) * 40.0, lambda size: np.full(size, 0.3)]
    columns = [kind(size=int(n)) for kind in kinds for n in rng.integers(1, 65, 50)] + [rng.normal(size=600) * 30]
    for scale in (0.5, 7.0):
        assert np.allclose(steps.catoni_means(columns, scale), [bisected(c, scale) for c in columns], rtol=1e-9, atol=1e-9)
    looks.clear()
    steps.catoni_means([rng.exponential(size=64) for _ in range(200)], 0.5)
    assert sum(looks) < 20 * 200


@pytest.mark.parametrize("names", [("a", "b", "c"), ("a", "b")])
def test_expert_stretches_equal_the_fold(spark, names):
    x = lambda k: F.round(F.sin((F.col("id") - k) / 5) + (F.col("id") - k) % 7 / 10, 2)
    values = spark.range(600).select((F.col("id") % 2).alias("s"), F.col("id").alias("t"), F.array(*[x(2 * k) for k in range(len(names))]).alias("utilities"))
    experts = steps.Experts(names, scale=0.5, switching_cost=0.15, history=8)
    whole, cut = rows(fold(values, ["s"], "t", experts)), rows(learning.expert_path(values, ["s"], "t", experts, stretch=16))
    assert whole.keys() == cut.keys() and sum(r["switched"] for r in whole.values()) > 20
    for k, r in whole.items():
        assert (r["expert"], r["switched"], r["was_reset"]) == (cut[k]["expert"], cut[k]["switched"], cut[k]["was_reset"])
        assert np.allclose(r["estimates"], cut[k]["estimates"], atol=1e-9)
    with pytest.raises(Exception, match="finite"):
        learning.expert_path(values.withColumn("utilities", F.array(*[F.lit(float("nan"))] * len(names))), ["s"], "t", experts).collect()


def test_a_series_folded_in_parts_gives_the_same_rows(spark, monkeypatch):
    """Parts with nothing but nulls in a column, then parts with values."""
    events = [("a", float(k), "register", f"c{k}", None) for k in range(4)] + [("a", 4.0, "seal", None, None)]
    events += [("a", 5.0 + k, "observe", f"c{k % 4}", 1.0) for k in range(23)] + [("a", 40.0, "reset_epoch", None, None)]
    rows_ = spark.createDataFrame([*events, *[("b", *e[1:]) for e in events[:7]]], "gate string, at double, event string, challenger string, score double")
    made = lambda: sorted(map(repr, fold(rows_, ["gate"], "at", steps.GateLifecycle(0.2, 1.0, skip=True)).collect()))
    whole = made()
    monkeypatch.setattr(folds, "AT_ONCE", 1)
    assert made() == whole and any("promoted='c0'" in r for r in whole) and any("wealth=None" in r for r in whole)
