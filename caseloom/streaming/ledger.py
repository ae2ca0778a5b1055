"""The request ledger as a stream: state by request, kept across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "request_hash string, state string, attempts bigint, last_attempt bigint"
STATE = "state string, attempts array<bigint>, last_attempt bigint, last_entry bigint"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
    """One request's new entries folded into its state.

    Of several deliveries of an attempt the first one recorded counts, within a
    batch by recording time and entry, over batches by arrival.  The list of
    attempts seen is as long as a request's attempts.
    """
    state, seen, last_attempt, last_entry = group.get if group.exists else ("", [], -1, -1)
    attempts = set(seen)
    for frame in frames:
        for attempt, _, entry, status in sorted(zip(frame["attempt"], frame["recorded_at"], frame["entry_no"], frame["status"]), key=lambda x: x[:3]):
            if attempt in attempts:
                continue
            attempts.add(int(attempt))
            newer = attempt > last_attempt
            if state != "accepted" and (status == "accepted" or newer):
                state = status
            if newer:
                last_attempt, last_entry = int(attempt), int(entry)
    group.update((state, sorted(attempts), last_attempt, last_entry))
    yield pd.DataFrame([(key[0], state, len(attempts), last_attempt)], columns=["request_hash", "state", "attempts", "last_attempt"])


def request_states(entries: DataFrame) -> DataFrame:
    """Each request's state after every micro-batch that brought it entries (update mode).

    An accepted attempt is final; otherwise the newest attempt decides.
    """
    keep = entries.select("request_hash", "attempt", "status", "entry_no", "recorded_at").where("request_hash IS NOT NULL AND attempt IS NOT NULL")
    return keep.groupBy("request_hash").applyInPandasWithState(_fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
