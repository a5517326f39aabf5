"""Bounded conversation memory kept as state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from answerloom.operators.usage import MEMORY_ROLES

SCHEMA = "conv_id long, turns string, n_messages long, chars long"


class HistoryProcessor(StatefulProcessor):
    """Keeps the newest messages of a conversation inside the turn and character limits."""

    def __init__(self, max_turns: int, max_chars: int, ttl_ms: int | None) -> None:
        self.max_turns, self.max_chars, self.ttl_ms = max_turns, max_chars, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "turn long, role string, chars long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        limit = max(3 * self.max_turns, 10)
        newest = [tuple(r) for r in self.kept.get()] if self.kept.exists() else []
        for frame in rows:
            part = frame[frame["role"].isin(MEMORY_ROLES)]
            found = zip(part["turn"].astype(int), part["role"], part["text"].str.len().astype(int), strict=True)
            newest = sorted([*newest, *((int(t), r, int(c)) for t, r, c in found)], reverse=True)[:limit]
        self.kept.put([(t, r, c) for t, r, c in newest]) if newest else self.kept.clear()
        picked, turns, chars = [], 0, 0
        for turn, role, size in newest:
            if picked and (turns >= self.max_turns or chars + size > self.max_chars):
                break
            picked.append(turn)
            turns, chars = turns + (role == "user"), chars + size
        shown = ",".join(str(t) for t in sorted(picked))
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [shown], "n_messages": [len(picked)], "chars": [chars]})

    def close(self) -> None:
        pass


def stream_history(messages: DataFrame, max_turns: int = 6, max_chars: int = 4000, ttl_hours: int | None = None) -> DataFrame:
    """Latest memory of every conversation touched in a batch; state is at most ``max(3 x max_turns, 10)`` entries per
    conversation (lengths only). Needs the RocksDB state store.

    ``ttl_hours`` lets idle conversations expire; it keeps the query on processing time, which never drains, so leave
    it out for one-off ``availableNow`` runs.
    """
    return messages.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=HistoryProcessor(max_turns, max_chars, None if ttl_hours is None else ttl_hours * 3_600_000),
        outputStructType=SCHEMA, outputMode="Update", timeMode="None" if ttl_hours is None else "ProcessingTime",
    )
