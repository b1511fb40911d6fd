"""Batch runner of the state machines: one ordered pass per series, in parallel over series."""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame

#: Rows of a series that are Python objects at a time.
AT_ONCE = 4096


def fold(df: DataFrame, keys: list[str], time: str, machine, together: bool = False) -> DataFrame:
    """Each series' rows in time order through its own machine: keys, time and the machine's outputs.

    Series are the unit of parallelism, so a machine's parameters or a trial's number belong into the keys. With ``together`` rows of equal time
    go to the machine's ``together`` at once, which makes their order of no account.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*keys, time])
    names = [f.split()[0] for f in _split(machine.fields)]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        state, out = machine.start(), []
        group = group.sort_values(time, kind="stable")
        times, end = group[time].to_numpy(), 0
        while end < len(group):
            at, end = end, min(end + AT_ONCE, len(group))
            while together and end < len(group) and times[end] == times[end - 1]:
                end += 1
            part = group.iloc[at:end]
            rows = part.astype(object).where(part.notna() | part.map(lambda v: hasattr(v, "__len__")), None).to_dict("records")
            if together:
                made = [m for _, same in groupby(rows, itemgetter(time)) for m in machine.together(state, list(same))]
            else:
                made = [machine.step(state, row) for row in rows]
            out.append(pd.DataFrame([[*(row[c] for c in [*keys, time]), *(m[n] for n in names)] for row, m in zip(rows, made, strict=True)], columns=[*keys, time, *names]))
        return pd.concat(out, ignore_index=True) if len(out) > 1 else out[0]

    return df.groupBy(*keys).applyInPandas(run, f"{kinds}, {machine.fields}")


def _split(ddl: str) -> list[str]:
    return [part.strip() for part in ddl.split(", ")]
