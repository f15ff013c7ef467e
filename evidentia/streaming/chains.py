"""Audit chains as a stream: the issues of ``decisions.validate_audit_chain`` as entries arrive, in any batches.

The session must keep state in RocksDB (``ROCKSDB`` under ``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ENTRY = "position long, decision_id string, ordinal long, prior_id string, prior_hash string, content_hash string"
_FIELDS = [f.split()[0] for f in _ENTRY.split(", ")]
_HASH = re.compile("[0-9a-f]{64}")


def _plain(value):
    return None if pd.isna(value) else value


class _Chain(StatefulProcessor):
    """Per subject the last entry judged, as a value, and the entries that came before their predecessors, as a list."""

    def __init__(self, wait_ms: int) -> None:
        self._wait = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "entries long, position long, decision_id string, content_hash string")
        self._early = handle.getListState("early", _ENTRY)

    def _judge(self, key: tuple, heap: list, last: tuple, everything: bool) -> tuple[tuple, list]:
        """Judges entries from the heap while the next one follows the last, or all of them."""
        issues = []
        n, at, decision, content = last
        while heap and (everything or heap[0][0] <= at + 1):
            position, _, (identity, ordinal, prior_id, prior_hash, own) = heapq.heappop(heap)
            n += 1
            found = {
                "HASH_FORMAT": own is None or not _HASH.fullmatch(own), "ORDINAL_GAP": ordinal != n,
                "BROKEN_LINK": prior_id != decision, "STALE_HASH": prior_hash != content,
            }
            issues += [(key[0], position, issue) for issue, bad in found.items() if bad]
            at, decision, content = max(at, position), identity, own
        return (n, at, decision, content), issues

    def _kept(self) -> tuple[tuple, list]:
        last = tuple(self._last.get()) if self._last.exists() else (0, 0, None, None)
        heap = [(r[0], i, tuple(r[1:])) for i, r in enumerate(self._early.get())] if self._early.exists() else []
        heapq.heapify(heap)
        return last, heap

    def _keep(self, last: tuple, heap: list) -> None:
        self._last.update(last)
        if heap:
            self._early.put([(position, *rest) for position, _, rest in sorted(heap)])
        else:
            self._early.clear()

    @staticmethod
    def _frame(issues: list) -> pd.DataFrame:
        return pd.DataFrame(issues, columns=["subject", "position", "issue"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, heap = self._kept()
        number = len(heap)
        for frame in rows:
            for row in frame[_FIELDS].itertuples(index=False):
                position, identity, ordinal, prior_id, prior_hash, own = map(_plain, row)
                heapq.heappush(heap, (int(position), number, (identity, None if ordinal is None else int(ordinal), prior_id, prior_hash, own)))
                number += 1
        last, issues = self._judge(key, heap, last, False)
        timers = list(self._handle.listTimers())
        if heap and not timers:
            self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._wait)
        elif not heap:
            for timer in timers:
                self._handle.deleteTimer(timer)
        self._keep(last, heap)
        yield self._frame(issues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, heap = self._kept()
        last, issues = self._judge(key, heap, last, True)
        self._keep(last, heap)
        yield self._frame(issues)

    def close(self) -> None:
        pass


def audit_chain(log: DataFrame, wait_ms: int = 600_000) -> DataFrame:
    """A stream of log(subject, position, decision_id, ordinal, prior_id, prior_hash, content_hash) -> its issues(subject,
    position, issue), each once, whatever batches the entries come in.

    Positions count the entries of a subject from 1 and are never null. An entry that comes before an earlier position waits
    for it, for ``wait_ms`` of processing time at most; then all that wait are judged in their order, as if the missing ones
    did not exist. Timers are looked at in each batch: a query that runs on until stopped has batches without data for them, a
    run over what is available must set ``spark.sql.streaming.noDataMicroBatches.enabled`` to false, as it would not end, and
    looks at them in its next batch with data. An entry at or before a position judged already is judged on arrival, after that one. State is one row a
    subject and the entries that wait.
    """
    return log.groupBy("subject").transformWithStateInPandas(
        statefulProcessor=_Chain(wait_ms), outputStructType="subject string, position long, issue string", outputMode="Append", timeMode="ProcessingTime"
    )
