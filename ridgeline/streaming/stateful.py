"""Streams of events: changes and repeats by keyed state, one small row of state for each key.

Within a trigger a key's rows are taken in time order, so a trigger's rows of one key are held at once. Nulls equal nulls,
and they stay nulls: what pandas has as NaN counts as null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _plain(x, kind: T.DataType):
    """A value as state holds it; whole numbers come as floats where the column has nulls."""
    if x is None or x is pd.NaT or isinstance(x, float) and x != x:
        return None
    return int(x) if isinstance(kind, T.IntegralType) else x.item() if hasattr(x, "item") else x


def _keyed(df: DataFrame, key: str, time: str, value: str, keep, state: str) -> DataFrame:
    """keep(held, value, time) gives the new state of a row that stays, else None."""
    schema = df.schema

    def run(_, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        now, out = held.get if held.exists else None, []
        for at, (v, t) in enumerate(zip(rows[value], rows[time])):
            new = keep(now, _plain(v, schema[value].dataType), _plain(t, schema[time].dataType))
            if new is not None:
                now = new
                out.append(at)
        if now is not None:
            held.update(now)
        yield rows.iloc[out]

    return df.groupBy(key).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout)


def changes(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Rows whose value differs from the key's row before."""
    return _keyed(df, key, time, value, lambda before, v, _: None if before is not None and before[0] == v else (v,), f"v {df.schema[value].dataType.simpleString()}")


def suppress_repeats(df: DataFrame, key: str, time: str, value: str, within: float) -> DataFrame:
    """Without rows that equal the key's last kept row and come less than `within` (in time's unit, a number) after it. Rows
    without a time stay."""

    def keep(last, v, t):
        near = last is not None and last[0] == v and t is not None and last[1] is not None and t - last[1] < within
        return None if near else (v, t)

    return _keyed(df, key, time, value, keep, f"v {df.schema[value].dataType.simpleString()}, t {df.schema[time].dataType.simpleString()}")
