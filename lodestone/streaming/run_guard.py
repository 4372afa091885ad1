"""Watch evaluation runs while they happen and say when one must stop.

State per run: how many questions, what they cost in sum, how often each cost occurred,
the current streak of transient failures. Rows of one run must arrive in question order
across batches; inside a batch they are ordered here.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone import constants as k
from lodestone.policies import BudgetPolicy

OUTPUT = "run_id string, position bigint, reason string, spent double, projected double"
FACTS = ["position", "cost", "error_category", "failure_detail", "status_code", "retrieval_transient"]
TOTALS = "seen bigint, streak bigint, spent double, stopped boolean"


@dataclass(frozen=True)
class GuardSettings:
    total_questions: int
    forecast_per_question: float
    budget: BudgetPolicy = BudgetPolicy()
    known: float = 0.0
    reserve_overridden: bool = False


class Middle:
    """The median of values with counts, kept while values are added.

    *at* is the distinct value with the lower median, *below* the count of all before it;
    an added value moves it by one step at most.
    """

    def __init__(self, counts: dict[float, int]) -> None:
        self.counts = counts
        self.values = sorted(counts)
        self.size = sum(counts.values())
        self.at, self.below = 0, 0
        self._settle()

    def _settle(self) -> None:
        if not self.size:
            return
        rank = (self.size + 1) // 2
        while rank <= self.below:
            self.at -= 1
            self.below -= self.counts[self.values[self.at]]
        while rank > self.below + self.counts[self.values[self.at]]:
            self.below += self.counts[self.values[self.at]]
            self.at += 1

    def add(self, value: float) -> None:
        if value in self.counts:
            self.counts[value] += 1
        else:
            place = bisect.bisect_left(self.values, value)
            self.values.insert(place, value)
            self.counts[value] = 1
            if self.size and place <= self.at:
                self.at += 1
        if self.size and value < self.values[self.at]:
            self.below += 1
        self.size += 1
        self._settle()

    def median(self) -> float:
        low = self.values[self.at]
        if self.size % 2 or self.below + self.counts[low] > self.size // 2:
            return low
        return (low + self.values[self.at + 1]) / 2


class RunGuard(StatefulProcessor):
    """Emits one row per run: the first question after which it must stop."""

    def __init__(self, settings: GuardSettings) -> None:
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", TOTALS)
        self.costs = handle.getMapState("costs", "cost double", "times bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, streak, spent, stopped = (
            self.totals.get() if self.totals.exists() else (0, 0, 0.0, False)
        )
        if stopped:
            return
        batch = pd.concat([part[FACTS] for part in rows])
        middle = Middle({key[0]: times[0] for key, times in self.costs.iterator()} if seen else {})
        added: set[float] = set()
        for row in batch.sort_values("position").itertuples():
            seen += 1
            cost = float(row.cost)
            spent += cost
            middle.add(cost)
            added.add(cost)
            reason, streak = self._reason(row, streak)
            projected = self._projected(seen, spent, middle.median())
            if reason is None and self._over_budget(seen, spent, projected):
                reason = "budget_guard"
            if reason is not None:
                stopped = True
                yield pd.DataFrame(
                    {
                        "run_id": [str(key[0])],
                        "position": [int(row.position)],
                        "reason": [reason],
                        "spent": [spent],
                        "projected": [projected],
                    }
                )
                break
        self.totals.update((seen, streak, spent, stopped))
        for cost in added:
            self.costs.updateValue((cost,), (middle.counts[cost],))

    def _reason(self, row, streak: int) -> tuple[str | None, int]:
        if not pd.isna(row.retrieval_transient) and bool(row.retrieval_transient):
            return "retrieval_unavailable", streak
        status = None if pd.isna(row.status_code) else int(row.status_code)
        if status == 429 or row.failure_detail == "rate_limited":
            return "rate_limited", streak
        if status in k.AUTH_STATUS:
            return "auth_failure", streak
        streak = streak + 1 if row.error_category in k.TRANSIENT_CATEGORIES else 0
        return ("systemic_provider_failure" if streak >= k.SYSTEMIC_STREAK else None), streak

    def _projected(self, seen: int, spent: float, median: float) -> float:
        s = self.settings
        weight = seen / (seen + k.GUARD_PRIOR_WEIGHT)
        rate = weight * median + (1 - weight) * s.forecast_per_question
        return spent + max(s.total_questions - seen, 0) * rate

    def _over_budget(self, seen: int, spent: float, projected: float) -> bool:
        s = self.settings
        ceiling = s.budget.ceiling(s.reserve_overridden)
        expected = projected if seen >= k.GUARD_MIN_QUESTIONS else spent
        return s.known + max(spent, expected) > ceiling

    def close(self) -> None:
        pass


def run_guard(records: DataFrame, settings: GuardSettings) -> DataFrame:
    """records(run_id, position, cost, error_category, failure_detail, status_code,
    retrieval_transient) -> the stop rows. Works on streams and on batches.

    Needs the RocksDB state store provider:
    spark.sql.streaming.stateStore.providerClass =
    org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider
    """
    # Opening the stream manager registers the state store coordinator, which a batch
    # run of the processor needs as well.
    _ = records.sparkSession.streams.active
    return records.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=RunGuard(settings),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="None",
    )
