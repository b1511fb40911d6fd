"""Streaming runner of the state machines: state lives in the stream's checkpoint, one machine per key."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import _split


def stream_fold(df: DataFrame, keys: list[str], time: str, machine) -> DataFrame:
    """The same outputs as operators.folds.fold, over a stream whose rows arrive in time order within each key.

    A micro-batch's rows of a key are put in order before they are taken; a failed batch is retried from the state before it. A row
    that is not later than what its key has taken in before is an error: what was consumed cannot change.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*keys, time])
    names = [f.split()[0] for f in _split(machine.fields)]

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, last = pickle.loads(held.get[0]) if held.exists else (machine.start(), None)
        group = pd.concat(list(batches)).sort_values(time, kind="stable")
        out = []
        if last is not None and len(group) and group[time].iloc[0] <= last:
            raise ValueError(f"{key}: a row at {group[time].iloc[0]} came after {last} was taken")
        for row in group.to_dict("records"):
            made = machine.step(state, row)
            out.append([*(row[c] for c in [*keys, time]), *(made[n] for n in names)])
        held.update((pickle.dumps((state, group[time].iloc[-1] if len(group) else last)),))
        yield pd.DataFrame(out, columns=[*keys, time, *names])

    return df.groupBy(*keys).applyInPandasWithState(run, f"{kinds}, {machine.fields}", "state binary", "append", GroupStateTimeout.NoTimeout)
