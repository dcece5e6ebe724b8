"""State kept between micro-batches: an admission limiter, and sinks that merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidara.streaming.machines import Limiter


def admitted_stream(calls: DataFrame, key: str, most: int, seconds: float) -> DataFrame:
    """calls (key, event_id, at) of a stream with whether each was admitted; the admitted times within the window are the state."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = Limiter(most, seconds)
        if state.exists:
            m.admitted.extend(state.get[0])
        for pdf in frames:
            pdf = pdf.sort_values(["at", "event_id"], kind="stable")
            yield pd.DataFrame({key: pdf[key], "event_id": pdf["event_id"], "admitted": [m.admit(t) for t in pdf["at"]]})
        state.update((list(m.admitted),))

    return calls.groupBy(key).applyInPandasWithState(step, f"{key} bigint, event_id bigint, admitted boolean", "admitted array<double>", "append", GroupStateTimeout.NoTimeout)


def merged_batches(stream: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands every micro-batch to `merge` once it is complete; runs over what there is."""
    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def ledger_merge(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch's latest row per key under its own version, so a repeated batch replaces itself."""

    def merge(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key).agg(*(F.max_by(c, "event_id").alias(c) for c in batch.columns if c != key))
        last.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return merge
