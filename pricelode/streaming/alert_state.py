"""Keyed streaming state: first, last and alerted price per listing.

The same rules as the batch state, kept in the engine's state store by a
stateful processor with typed state variables, so that a listing seen again is
compared without reading a snapshot.  A stream can start from a snapshot of the
batch state, and forget listings that were not seen for a while.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pricelode.config import StateParams

OUTPUT = (
    "state_key string, n_seen bigint, first_price double, last_price double, n_alerts bigint, "
    "alert_price double"
)
_COLUMNS = ["state_key", "n_seen", "first_price", "last_price", "n_alerts", "alert_price"]
_STATE = "n_seen bigint, first_price double, last_price double, n_alerts bigint, alert_price double"
_BATCH = 10_000
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _place(row: tuple) -> tuple:
    """Sort key of (pos, price): rows without a position come last."""
    return (True, 0) if row[0] is None else (False, row[0])


class AlertProcessor(StatefulProcessor):
    """Counts a key's rows, keeps its prices and raises an alert for every sufficient new low.

    A key has one state variable, read once and written once a batch.
    ``forget_after_ms``: state of a key that has no rows for so long expires.
    """

    def __init__(self, drop: float, forget_after_ms: int | None = None):
        self.drop, self.forget_after_ms = drop, forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", _STATE, self.forget_after_ms)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        row = initialState
        alerted = bool(row.notified) and row.notified_price is not None
        self.state.update((0, row.first_price, row.last_price, 1 if alerted else 0, row.notified_price if alerted else None))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # Of the rows that came so far, only the new lows and the ends can matter later: a key's rows are never all held.
        n, lows, first, last = 0, [], None, None
        while batch := list(islice(rows, _BATCH)):
            n += len(batch)
            priced = sorted(((r.pos, r.price) for r in batch if r.price is not None and not math.isnan(r.price)), key=_place)
            if not priced:
                continue
            first = priced[0] if first is None else min(first, priced[0], key=_place)
            last = priced[-1] if last is None else max(priced[-1], last, key=_place)
            merged, lows, least = sorted(lows + priced, key=_place), [], math.inf
            for row in merged:
                if row[1] < least:
                    lows.append(row)
                    least = row[1]
        seen, old_first, old_last, alerts, bar = self.state.get() or (0, None, None, 0, None)
        prices = (float(first[1]) if old_first is None and first else old_first, float(last[1]) if last else old_last)
        for _, price in lows:
            if not alerts or price <= bar - self.drop:
                alerts, bar = alerts + 1, float(price)
        now = (int(seen + n), *prices, int(alerts), bar)
        self.state.update(now)
        yield Row(**dict(zip(_COLUMNS, (key[0], *now), strict=True)))

    def close(self) -> None:
        pass


def keyed_alerts(
    stream: DataFrame, params: StateParams | None = None, snapshot: DataFrame | None = None, forget_after_ms: int | None = None
) -> DataFrame:
    """One row per key and micro-batch with its state after the batch.

    ``stream`` has ``state_key``, ``pos`` (order within the stream) and
    ``price``.  Rows without a price are counted and change nothing else; of the
    others only lowest-so-far prices can raise an alert.  ``snapshot`` is a batch
    state (``state_key``, ``first_price``, ``last_price``, ``notified``,
    ``notified_price``) from which a new stream goes on.

    With ``forget_after_ms`` the engine keeps looking for expired state, so a
    stream that should end by itself (``availableNow``) needs
    ``spark.sql.streaming.noDataMicroBatches.enabled`` set to false.
    """
    params = params or StateParams()
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)  # typed state variables need it
    start = None
    if snapshot is not None:
        known = snapshot.select("state_key", "first_price", "last_price", F.coalesce("notified", F.lit(False)).alias("notified"), "notified_price")
        start = known.groupBy("state_key")
    return stream.select("state_key", "pos", "price").groupBy("state_key").transformWithState(
        AlertProcessor(params.realert_drop, forget_after_ms), OUTPUT, "Update", "ProcessingTime" if forget_after_ms else "None", start
    )
