"""Keyed sessions and drained logs as Structured Streaming.

Extraction sessions are state per ``session_id``: a start, tool calls that add entities and relationships, a finish.
A session ends by finishing, by its call cap, or by age since its start; calls after the end are answered as late.
The reinforcement log is drained by the stream's own offsets, so a row is applied exactly once per batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemora import config
from mnemora.functions import decay as D

#: session_id, event (start, add_entity, add_relationship, finish), arguments as JSON, event time.
CALLS = "session_id string, event string, arguments string, ts timestamp"
OUTCOMES = "session_id string, outcome string, detail string, calls int, entities int, relationships int"
_STATE = "started double, calls int, entities int, relationships int, touched string"


def _calls(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    session = key[0]
    columns = [c.split()[0] for c in OUTCOMES.split(", ")]
    if state.hasTimedOut:
        _, calls, entities, relationships, _ = state.get
        state.remove()
        yield pd.DataFrame([(session, "expired", "no finish in time", calls, entities, relationships)], columns=columns)
        return
    rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
    live = list(state.get) if state.exists else None
    out: list[tuple] = []
    for event, arguments, ts in rows[["event", "arguments", "ts"]].itertuples(index=False, name=None):
        now = pd.Timestamp(ts).timestamp()
        if live is not None and now - live[0] > config.SESSION_MAX_MINUTES * 60:
            out.append((session, "expired", "no finish in time", *live[1:4]))
            live = None
        if event == "start":
            if live is None:
                live = [now, 0, 0, 0, "[]"]
            continue
        if live is None:
            out.append((session, "late", f"{event}: session is over or unknown", 0, 0, 0))
            continue
        live[1] += 1
        touched = json.loads(live[4])
        try:
            given: dict[str, Any] = json.loads(arguments or "{}")
        except ValueError:
            given = {}
        if event == "add_entity" and given.get("name"):
            live[2] += 1
            touched.append(given["name"])
            out.append((session, "entity", json.dumps(given, sort_keys=True), *live[1:4]))
        elif event == "add_relationship" and given.get("source") and given.get("target"):
            live[3] += 1
            touched = [t for t in touched if t not in (given["source"], given["target"])]
            out.append((session, "relationship", json.dumps(given, sort_keys=True), *live[1:4]))
        elif event != "finish":
            out.append((session, "rejected", str(event), *live[1:4]))
        live[4] = json.dumps(touched)
        if event == "finish" or live[1] >= config.SESSION_MAX_CALLS:
            # Entities that no relationship of the session touches are named.
            out.append((session, "finished" if event == "finish" else "capped", json.dumps(sorted(set(touched))), *live[1:4]))
            live = None
    if live is None:
        if state.exists:
            state.remove()
    else:
        state.update(tuple(live))
        state.setTimeoutTimestamp(int((live[0] + config.SESSION_MAX_MINUTES * 60) * 1000))
    if out:
        yield pd.DataFrame(out, columns=columns)


def sessions(calls: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Outcomes of a stream of session calls (``CALLS``): added rows, finished, capped, expired and late ones."""
    keyed = calls.withWatermark("ts", delay).groupBy("session_id")
    return keyed.applyInPandasWithState(_calls, OUTCOMES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def drain_reinforcement(log: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs all logged traversals (``graph_id, edge``) through ``apply(counts, batch_id)`` and stops; offsets are the drain mark.

    ``counts`` has ``graph_id, edge, times``; a batch that fails is offered again under the same number.
    """

    def batch(df: DataFrame, number: int) -> None:
        apply(df.groupBy("graph_id", "edge").agg(F.count(F.lit(1)).alias("times")), number)

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reinforcement_windows(log: DataFrame, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Extension: traversals per edge and event-time window (``graph_id, edge, ts``), late rows beyond ``delay`` left out."""
    return log.withWatermark("ts", delay).groupBy(F.window("ts", width), "graph_id", "edge").agg(F.count(F.lit(1)).alias("times"))


def reinforced_by_counts(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """Edges after drained counts (``graph_id, edge, times``), capped."""
    out = edges.join(counts.select("graph_id", F.col("edge").alias("key"), "times"), ["graph_id", "key"], "left")
    return out.withColumn("strength", F.when(F.col("times").isNotNull(), D.reinforced(F.col("strength"), F.col("times"))).otherwise(F.col("strength"))).drop("times")
