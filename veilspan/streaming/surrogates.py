"""Placeholders for streams of findings: numbers are kept as keyed state, a state for each scope and type.

Within a micro-batch new values are numbered in the order of their sequence, so a stream whose order is that of the batch
gives the same mapping as the batch operator. State for a key grows with its distinct values, as a map, value by
value; ttl_ms lets values go that have not been used for so long. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilspan.operators.surrogates import SCOPE

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Numbering(StatefulProcessor):
    """Rows (sequence, value) of one scope and type to (sequence, value, surrogate, is_new)."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getMapState("numbers", "value string", "n long", self.ttl_ms) if self.ttl_ms else handle.getMapState("numbers", "value string", "n long")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        *scope, entity = key
        given = pd.concat(list(rows), ignore_index=True).sort_values(["sequence", "value"], kind="stable")
        n = self.count.get()[0] if self.count.exists() else 0
        before, out = n, []
        for sequence, value in zip(given["sequence"], given["value"], strict=True):
            new = not self.numbers.containsKey((value,))
            if new:
                n += 1
                self.numbers.updateValue((value,), (n,))
            own = n if new else self.numbers.getValue((value,))[0]
            out.append((*scope, entity, int(sequence), value, f"[{entity}_{own}]", new))
        if n != before:
            self.count.update((n,))
        yield pd.DataFrame(out, columns=[*SCOPE, "entity", "sequence", "value", "surrogate", "is_new"])

    def close(self) -> None:
        pass


def number_stream(findings: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """findings: a stream of (scope, entity, sequence, value). Append mode."""
    schema = "org_id string, workspace_id string, conversation_id string, entity string, sequence long, value string, surrogate string, is_new boolean"
    return findings.groupBy(*SCOPE, "entity").transformWithStateInPandas(Numbering(ttl_ms), schema, "Append", "None" if not ttl_ms else "ProcessingTime")
