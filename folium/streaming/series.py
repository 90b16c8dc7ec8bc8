"""Series of revisions that arrive over time: each against its predecessor, or against a fixed first one.

Adjacent series keep one revision a set as state: the last one in order. A revision that arrives after a later one of
its set has no place any more; it gives a row that says so, and the state stays. With ``idle`` a set's state goes when
nothing of it has arrived for so long, and the next revision begins the set anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.textdiff import text_diff

OUT = "set_id long, from_turn long, to_turn long, equal boolean, changed_lines int, truncated boolean, late boolean"
DIFF = pa.struct([("equal", pa.bool_()), ("changed_lines", pa.int32()), ("truncated", pa.bool_())])


def difference(before: str, after: str) -> dict:
    """How two texts differ by lines."""
    d = text_diff(before.split("\n"), after.split("\n"))
    return {"equal": before == after, "changed_lines": d.changed_lines, "truncated": d.truncated}


def _step(idle: int | None) -> Callable:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = []
        if state.hasTimedOut:
            state.remove()
        else:
            last = state.get if state.exists else None
            for turn, text in sorted((int(r.turn), r.text or "") for b in batches for r in b.itertuples()):
                if last is not None and turn < last[0]:
                    rows.append((key[0], None, turn, None, None, None, True))
                    continue
                if last is not None:
                    d = difference(last[1], text)
                    rows.append((key[0], last[0], turn, *d.values(), False))
                last = (turn, text)
            if last is not None:
                state.update(last)
            if idle is not None:
                state.setTimeoutDuration(idle)
        out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in OUT.split(", ")])
        yield out.astype({"from_turn": "Int64", "changed_lines": "Int32", "equal": "boolean", "truncated": "boolean"})

    return step


def adjacent(stream: DataFrame, idle: int | None = None) -> DataFrame:
    """One row per revision after a set's first: how it differs from the one before it, within and across batches.

    ``idle``: milliseconds without a revision after which a set's state goes.
    """
    rows = stream.select(F.col("conv_id").alias("set_id"), "turn", "text")
    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("set_id").applyInPandasWithState(_step(idle), OUT, "turn long, text string", "append", timeout)


def against_baseline(stream: DataFrame, baseline: DataFrame) -> DataFrame:
    """A stream-static join: how every revision differs from its set's fixed first one."""

    def run(before: pa.Array, after: pa.Array) -> pa.Array:
        return pa.array([difference(a or "", b or "") for a, b in zip(before.to_pylist(), after.to_pylist(), strict=True)], DIFF)

    base = baseline.select(F.col("conv_id").alias("set_id"), F.col("turn").alias("from_turn"), F.col("text").alias("before"))
    rows = stream.select(F.col("conv_id").alias("set_id"), F.col("turn").alias("to_turn"), F.col("text").alias("after"))
    udf = F.arrow_udf(run, "struct<equal:boolean,changed_lines:int,truncated:boolean>")
    return rows.join(base, "set_id").select("set_id", "from_turn", "to_turn", udf("before", "after").alias("d")).select("set_id", "from_turn", "to_turn", "d.*")
