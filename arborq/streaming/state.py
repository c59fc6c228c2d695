"""State machines and retry budgets over streams of a worker's messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from arborq.operators.lifecycle import STEPS

OUT = "key string, seq long, before string, state string, valid boolean, failures int, exhausted boolean"


def follow_states(messages: DataFrame, budget: int = 2) -> DataFrame:
    """messages (key, seq, state), a stream: each with the state before it, whether it may follow, and the failures of its key so far (states Dead), which are exhausted at `budget`. Messages of a batch are taken in order of seq."""
    allowed = {*STEPS}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, failures = state.get if state.exists else (None, 0)
        rows = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            valid = before is None or r.state == "Dead" or (before, r.state) in allowed or (before == "Dead" and r.state == "Created")
            failures += r.state == "Dead"
            rows.append((key[0], r.seq, before, r.state, valid, failures, failures >= budget))
            before = r.state
        state.update((before, failures))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")])

    return messages.groupBy("key").applyInPandasWithState(step, OUT, "before string, failures int", "append", GroupStateTimeout.NoTimeout)
