"""State machines over ordered rows of a key: limits, budgets, circuit breakers, dead letters.

Rows of a key are folded in time order, so each takes a grouped Arrow pass that holds one
key's rows; keys are callers, tenants or providers. The streaming forms keep the same state
between micro-batches.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Limiter:
    """Admits up to `most` requests in `seconds`; rejected ones are not counted."""

    def __init__(self, most: int = 60, seconds: float = 60.0):
        self.most, self.seconds, self.admitted = most, seconds, deque()

    def admit(self, now: float) -> bool:
        while self.admitted and self.admitted[0] <= now - self.seconds:
            self.admitted.popleft()
        if len(self.admitted) >= self.most:
            return False
        self.admitted.append(now)
        return True


class Budget:
    """Spends up to a limit; what would go over is refused and leaves the total as it is."""

    def __init__(self, limit: float = 100.0):
        self.limit, self.spent = limit, 0.0

    def spend(self, cost: float) -> bool:
        if self.spent + cost > self.limit:
            return False
        self.spent += cost
        return True


class Breaker:
    """CLOSED until `failures` in a row, OPEN for `seconds`, then HALF_OPEN for one probe."""

    def __init__(self, failures: int = 5, seconds: float = 30.0):
        self.limit, self.seconds, self.state, self.count, self.since = failures, seconds, "CLOSED", 0, 0.0

    def call(self, now: float, failed: bool) -> str:
        """What became of a call: ok, failed or rejected."""
        if self.state == "OPEN":
            if now - self.since <= self.seconds:
                return "rejected"
            self.state = "HALF_OPEN"
        if failed:
            self.count += 1
            if self.state == "HALF_OPEN" or self.count >= self.limit:
                self.state, self.since = "OPEN", now
            return "failed"
        self.state, self.count = "CLOSED", 0
        return "ok"


def _folded(df: DataFrame, key: str, order: list[str], fold, schema: str) -> DataFrame:  # noqa: ANN001
    return df.groupBy(key).applyInPandas(lambda pdf: fold(pdf.sort_values(order, kind="stable")), schema)


def admissions(calls: DataFrame, key: str, most: int, seconds: float) -> DataFrame:
    """(key, event_id, admitted) of calls (key, event_id, at: seconds)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        m = Limiter(most, seconds)
        return pd.DataFrame({key: pdf[key], "event_id": pdf["event_id"], "admitted": [m.admit(t) for t in pdf["at"]]})

    return _folded(calls, key, ["at", "event_id"], fold, f"{key} bigint, event_id bigint, admitted boolean")


def offered_load(calls: DataFrame, key: str, seconds: int) -> DataFrame:
    """calls with `load`: how many came in the window before, admitted or not; a range window, no state."""
    w = Window.partitionBy(key).orderBy("at").rangeBetween(-seconds, -1)
    return calls.withColumn("load", F.count(F.lit(1)).over(w))


def spending(costs: DataFrame, key: str, limit: float) -> DataFrame:
    """(key, event_id, accepted, spent) in order."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        b, rows = Budget(limit), []
        for i, c in zip(pdf["event_id"], pdf["cost"]):
            rows.append((i, b.spend(c), round(b.spent, 6)))
        return pd.DataFrame({key: pdf[key].to_numpy(), "event_id": [r[0] for r in rows], "accepted": [r[1] for r in rows], "spent": [r[2] for r in rows]})

    return _folded(costs, key, ["at", "event_id"], fold, f"{key} bigint, event_id bigint, accepted boolean, spent double")


def circuit_states(calls: DataFrame, key: str, failures: int = 5, seconds: float = 30.0) -> DataFrame:
    """(key, event_id, outcome, state) of calls (key, event_id, at, failed)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        b, out, states = Breaker(failures, seconds), [], []
        for t, f in zip(pdf["at"], pdf["failed"]):
            out.append(b.call(t, f))
            states.append(b.state)
        return pd.DataFrame({key: pdf[key], "event_id": pdf["event_id"], "outcome": out, "state": states})

    return _folded(calls, key, ["at", "event_id"], fold, f"{key} bigint, event_id bigint, outcome string, state string")


def dead_letters(log: DataFrame) -> DataFrame:
    """(job_id, status, error_message, retry_count, created_at) from a log of enqueue, failed and completed rows: aggregates only.

    The first enqueue creates a job; every later failure adds a retry; a completion leaves the count and the message.
    """
    fails = log.where("event <> 'completed'")
    jobs = fails.groupBy("job_id").agg((F.count(F.lit(1)) - 1).alias("retry_count"), F.max_by("error_message", "event_id").alias("error_message"), F.min("at").alias("created_at"))
    last = log.groupBy("job_id").agg(F.max_by(F.when(F.col("event") == "completed", "COMPLETED").otherwise("FAILED"), "event_id").alias("status"))
    return jobs.join(last, "job_id")


def replay_queue(letters: DataFrame, most: int = 50) -> DataFrame:
    return letters.where("status = 'FAILED'").orderBy("created_at", "job_id").limit(most)
