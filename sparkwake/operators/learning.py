"""Learners and replays with a declarative form, and those that run in one bounded group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.steps import Experts
from .detect import STRETCH, in_stretches
from .folds import fold


def expert_path(df: DataFrame, keys: list[str], time: str, machine: Experts, stretch: int = STRETCH) -> DataFrame:
    """What the experts make of each series (column utilities, and change where they are reset), as folding it row by row would.

    An estimate depends on the last ``history`` rows, so series are cut into stretches. Only the choice depends on all before it: a
    series' estimates pass through one task in order, a batch at a time.

    Returns keys, time, expert, estimates, switched, was_reset.
    """
    if machine.reset_on_change and "change" in df.columns:
        return fold(df, keys, time, machine)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*keys, time])

    def run(rows: np.ndarray, start: int) -> dict:
        return {"estimates": machine.locations(rows, start).tolist(), "begins": np.arange(start, len(rows)) == 0}

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = -1
        for batch in batches:
            if not len(batch):
                continue
            at = []
            for picks, begins in zip(machine.choices(np.stack(batch["estimates"].to_numpy())).tolist(), batch["begins"].tolist(), strict=True):
                before = -1 if begins else held
                held = picks[before + 1]
                at.append((machine.names[held], before not in (-1, held)))
            expert, switched = zip(*at, strict=True)
            yield batch[[*keys, time]].assign(expert=expert, estimates=batch["estimates"], switched=switched, was_reset=False)

    # without a lead of a row, no stretch could tell that it is not the first
    found = in_stretches(df, keys, time, "utilities", max(1, machine.reach), run, "estimates array<double>, begins boolean", max(stretch, machine.history))
    return found.repartition(*keys).sortWithinPartitions(*keys, time).mapInPandas(choose, f"{kinds}, {machine.fields}")


def rolling_ridge(df: DataFrame, series: str, time: str, x: str, y: str, window: int, ridge: float) -> DataFrame:
    """Slope of a ridge fit on the ``window`` rows before each row, from two moving sums."""
    frame = Window.partitionBy(series).orderBy(time).rowsBetween(-window, -1)
    return df.withColumn("slope", F.sum(F.col(x) * F.col(y)).over(frame) / (F.lit(ridge) + F.sum(F.col(x) * F.col(x)).over(frame)))


def rolling_ridge_fit(df: DataFrame, series: str, time: str, features: str, y: str, width: int, window: int, ridge: float) -> DataFrame:
    """Coefficients (intercept last, as regular as the others) of a ridge fit on the ``window`` rows before each row; null before there is one.

    All moments are moving sums in one window; only the small solve is done in Python, for a batch of rows at once.
    """
    frame = Window.partitionBy(series).orderBy(time).rowsBetween(-window, -1)
    x = [F.col(features)[i] for i in range(width)] + [F.lit(1.0)]
    pairs = [(i, j) for i in range(width + 1) for j in range(i, width + 1)]
    gram = F.array(*[F.sum(x[i] * x[j]).over(frame) for i, j in pairs])
    moment = F.array(*[F.sum(xi * F.col(y)).over(frame) for xi in x])

    @F.pandas_udf("array<double>")
    def solve(g: pd.Series, m: pd.Series) -> pd.Series:
        known = g.map(lambda v: v is not None and v[0] is not None and np.isfinite(np.asarray(v, float)).all())
        out = pd.Series([None] * len(g), dtype=object)
        if known.any():
            flat, right = np.stack(g[known].to_numpy()).astype(float), np.stack(m[known].to_numpy()).astype(float)
            a = np.zeros((len(flat), width + 1, width + 1))
            for k, (i, j) in enumerate(pairs):
                a[:, i, j] = a[:, j, i] = flat[:, k]
            solved = np.linalg.solve(a + ridge * np.eye(width + 1), right[:, :, None])[:, :, 0]
            out[known.to_numpy()] = pd.Series(list(solved), index=out.index[known.to_numpy()])
        return out

    return df.withColumns({"__g": gram, "__m": moment}).withColumn("coefficients", solve("__g", "__m")).drop("__g", "__m")


def mean_label(df: DataFrame, series: str, time: str, label: str, delay: int) -> Column:
    """The mean of the labels known before each row: those of rows more than ``delay`` back."""
    return F.avg(label).over(Window.partitionBy(series).orderBy(time).rowsBetween(Window.unboundedPreceding, -delay - 1))


def transport(records: DataFrame, states: DataFrame, keys: list[str], current: int, drift: float, location: float, least: float) -> DataFrame:
    """Records seen strictly before ``current``, moved to its parameters and feature location.

    records: source_step, available_step, features, label; states: step, theta, location. A record's own state is the last one at
    its source step, and without one it takes no part; features shift by the change of location, the label by the shifted features times the change of
    theta, and the weight decays with both distances.
    """
    order = Window.partitionBy(*keys).orderBy("step")
    spans = states.withColumn("until", F.lead("step").over(order))
    now = spans.where((F.col("step") <= current) & (F.col("until").isNull() | (F.col("until") > current))).select(
        *keys, F.col("theta").alias("theta_now"), F.col("location").alias("location_now")
    )
    seen = records.where((F.col("source_step") < current) & (F.col("available_step") < current))
    marked = seen.select(*keys, F.col("source_step").alias("step"), F.struct(*[c for c in seen.columns if c not in keys]).alias("rec")).unionByName(
        states.select(*keys, "step", F.struct("theta", "location").alias("st")), allowMissingColumns=True
    )
    latest = Window.partitionBy(*keys).orderBy("step", F.col("rec").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    own = marked.withColumn("st", F.last("st", ignorenulls=True).over(latest)).where("rec is not null and st is not null").select(*keys, "rec.*", "st.theta", "st.location")
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    moved = own.join(now, keys).withColumns({"dl": minus(F.col("location_now"), F.col("location")), "dt": minus(F.col("theta_now"), F.col("theta"))})
    moved = moved.withColumn("moved", F.zip_with("features", "dl", lambda x, y: x + y))
    far = drift * F.sqrt(dot("dt", "dt")) + location * F.sqrt(dot("dl", "dl"))
    return moved.select(
        *keys, "source_step", "available_step", F.col("moved").alias("features"), (F.col("label") + dot("moved", "dt")).alias("label"),
        F.greatest(F.lit(least), F.least(F.lit(1.0), F.exp(-far))).alias("weight"),
    )


def signature_depth2(df: DataFrame, series: str, time: str, a: str, b: str) -> DataFrame:
    """The first two signature levels of each series' whole path, from the increments' running sums."""
    before = Window.partitionBy(series).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    run = df.withColumns({"__a": F.coalesce(F.sum(a).over(before), F.lit(0.0)), "__b": F.coalesce(F.sum(b).over(before), F.lit(0.0))})
    area = lambda x, y: F.sum(F.col(f"__{x}") * F.col({"a": a, "b": b}[y]) + F.col({"a": a, "b": b}[x]) * F.col({"a": a, "b": b}[y]) / 2)
    return run.groupBy(series).agg(
        F.sum(a).alias("s1"), F.sum(b).alias("s2"), area("a", "a").alias("s11"), area("a", "b").alias("s12"), area("b", "a").alias("s21"), area("b", "b").alias("s22")
    )


def _tilt(weights: np.ndarray, deltas: np.ndarray, target: float, bound: float, rounds: int, tolerance: float) -> np.ndarray:
    if not deltas.min() - tolerance <= target <= deltas.max() + tolerance:
        raise ValueError("the drift is out of a group's reach")
    mean = lambda g: float((w := weights * np.exp(g * deltas)) @ deltas / w.sum())
    if mean(-bound) > target + tolerance or mean(bound) < target - tolerance:
        raise ValueError("the tilt's bound can't reach the drift")
    low, high = -bound, bound
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < target else (low, middle)
    tilted = weights * np.exp((low + high) / 2 * deltas)
    return weights.sum() * tilted / tilted.sum()


def stress_weights(initial, terminal, reference, masses: dict, drifts: dict | None = None, rounds: int = 200, tolerance: float = 1e-9, bound: float = 50.0, bisections: int = 80):
    """Path weights nearest to the reference that have the terminal masses and, from each initial state, the drift (0 unless given).

    Alternates scaling to the masses with exponential tilts. Returns weights, relative entropy and rounds.
    """
    initial, terminal, reference = (np.asarray(x, float) for x in (initial, terminal, reference))
    if set(terminal.tolist()) != set(masses):
        raise ValueError("terminal masses must name the paths' terminal states")
    start = reference / reference.sum()
    w = start.copy()
    deltas = terminal - initial
    drifts = drifts or {}
    for n in range(1, rounds + 1):
        for state, mass in masses.items():
            here = terminal == state
            w[here] *= mass / w[here].sum() if w[here].sum() > 0 else 0.0
        for state in np.unique(initial):
            here = initial == state
            w[here] = _tilt(w[here], deltas[here], drifts.get(float(state), 0.0), bound, bisections, tolerance)
        off = max(abs(w[terminal == s].sum() - m) for s, m in masses.items())
        off = max(off, *(abs(w[initial == s] @ deltas[initial == s] / w[initial == s].sum() - drifts.get(float(s), 0.0)) for s in np.unique(initial)))
        if off <= tolerance:
            live = w > 0
            return w, float((w[live] * np.log(w[live] / start[live])).sum()), n
    raise ValueError("no weights meet the constraints")


def stress_bridge(paths: DataFrame, keys: list[str], masses: dict, **options) -> DataFrame:
    """stress_weights for each group of paths (path_id, initial, terminal, reference); groups are bounded scenario sets."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("path_id")
        w, entropy, n = stress_weights(group["initial"], group["terminal"], group["reference"], masses, **options)
        return group[[*keys, "path_id"]].assign(weight=w, entropy=entropy, rounds=n)

    kinds = ", ".join(f"`{c}` {paths.schema[c].dataType.simpleString()}" for c in [*keys, "path_id"])
    return paths.groupBy(*keys).applyInPandas(run, f"{kinds}, weight double, entropy double, rounds int")


def walk_forward(
    df: DataFrame, series: str, time: str, first: int, every: int, window: int | None, delay: int, fit, predict,
    action=None, least: int = 1, hold: bool = False, most: float = 1.0, audit: bool = False,
) -> DataFrame:
    """Refit every ``every`` evaluated rows on rows that lie, and whose labels were known, strictly before; predict the rest.

    fit(features, labels) -> model, given ``least`` known labels; predict(model, features) -> float; action(prediction, labels) -> position,
    else the prediction itself; positions are clipped to ``most``, and a row without a prediction keeps the last position if ``hold``,
    else none. Returns series, time, prediction, trained_rows, position, trained and, with audit, training: the times of the rows learned from.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(time)
        x, y, times = np.stack(group["features"].to_numpy()), group["label"].to_numpy(float), group[time].to_numpy()
        out, model, known, last = [], None, np.zeros(0, int), 0.0
        for t in range(first, len(group)):
            fitted = False
            if (t - first) % every == 0 or model is None:
                known = np.arange(max(0, t - delay))
                known = known[-window:] if window else known
                if len(known) >= least:
                    model, fitted = fit(x[known], y[known]), True
            prediction = float(predict(model, x[t])) if model is not None else None
            if prediction is not None and np.isfinite(prediction):
                last = min(most, max(-most, float(action(prediction, y[known]) if action else prediction)))
            elif not hold:
                last = 0.0
            made = (group[series].iloc[0], times[t], prediction, len(known), last, fitted)
            out.append((*made, times[known].tolist()) if audit else made)
        return pd.DataFrame(out, columns=[series, time, "prediction", "trained_rows", "position", "trained", *["training"] * audit])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [series, time])
    more = f", training array<{df.schema[time].dataType.simpleString()}>" if audit else ""
    return df.groupBy(series).applyInPandas(run, f"{kinds}, prediction double, trained_rows int, position double, trained boolean{more}")


def baseline_path(df: DataFrame, series: str, time: str, first: int, hook, most: float = 1.0, short: bool = True) -> DataFrame:
    """Positions of a baseline on the rows from ``first`` on: hook(place, features) -> position, clipped; not-a-number is none."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(time)
        x = np.stack(group["features"].to_numpy())
        raw = np.array([float(hook(t, x[t])) if t >= first else 0.0 for t in range(len(group))])
        low = -most if short else 0.0
        return group[[series, time]].assign(position=np.clip(np.where(np.isfinite(raw), raw, 0.0), low, most), evaluated=np.arange(len(group)) >= first)

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [series, time])
    return df.groupBy(series).applyInPandas(run, f"{kinds}, position double, evaluated boolean")
