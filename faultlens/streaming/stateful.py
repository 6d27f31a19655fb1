"""A per-key buffer in Spark's state store, for functions that must see readings in turn."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


def with_buffer(
    stream: DataFrame, key: str, order: str, size: int, step: Step, output: T.StructType
) -> DataFrame:
    """Call `step(history, arrived)` per key and keep the newest `size` readings.

    Arrow hands over a key's readings in slices, so a busy key is never held whole.
    Slices are sorted by `order`; readings that arrive out of order across slices are
    the caller's concern (see `LivePath` for the exact way).
    """
    fields = [f for f in stream.schema.fields if f.name != key]
    columns = [f.name for f in fields]
    state_schema = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields])

    def run(k: tuple, slices: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        history = (
            pd.DataFrame(dict(zip(columns, (list(v) for v in state.get)))) if state.exists else pd.DataFrame(columns=columns)
        )
        for arrived in slices:
            arrived = arrived.sort_values(order)[columns]
            out = step(history, arrived)
            out.insert(0, key, k[0])
            history = pd.concat([history, arrived] if len(history) else [arrived]).tail(size)
            yield out[output.fieldNames()]
        state.update(tuple(history[c].tolist() for c in columns))

    return stream.groupBy(key).applyInPandasWithState(
        run, output, state_schema, "append", GroupStateTimeout.NoTimeout
    )
