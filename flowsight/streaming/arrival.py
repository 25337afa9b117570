"""Windows in order of arrival on a stream: a late flow joins the window that is open when it comes.

No watermark decides here, so no flow is left out however late it is. Per sensor the state holds the
time of its first flow, the number of the open window, and that window's sums per source and pair of
protocols. A window is given out, complete, by the flow that opens a later one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowsight.operators.features import (
    CONTEXT,
    HTTP_APPS,
    SYN_STATES,
    features_of_totals,
    flow_bytes,
    flow_packets,
)
from flowsight.schema import FEATURES, KEY

SUMS = ["n", "bytes", "pkts", "syn", "ack", "fin", "rst"]
GROUP = ["src", "proto", "app_proto"]
PLACE_STATE = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("index", T.LongType())])
GROUP_STATE = T.StructType(
    [T.StructField("group", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in [*SUMS, "first_at", "last_at"]]
    + [T.StructField("squares", T.StringType())]
)
COUNTS = ["http", "dns", "tls", "tcp"]


def _grouped(flows: pd.DataFrame) -> pd.DataFrame:
    """Sums per window, source and protocols, in columns; ``group`` names the last three as JSON."""
    return flows.groupby(["window_index", "group"], as_index=False).agg(
        **{c: (c, "sum") for c in [*SUMS, "squares"]}, first_at=("at", "min"), last_at=("at", "max")
    )


def _merged(groups: pd.DataFrame) -> pd.DataFrame:
    """Several sums of a group as one."""
    return groups.groupby("group", as_index=False).agg(
        {**{c: "sum" for c in [*SUMS, "squares"]}, "first_at": "min", "last_at": "max"}
    )


def _total(groups: pd.DataFrame) -> dict:
    """One window's row, from its groups."""
    names = pd.DataFrame([json.loads(g) for g in groups["group"]], columns=GROUP, index=groups.index)
    n = groups["n"]
    by_source = n.groupby(names["src"]).sum()
    apps = names["app_proto"]
    http = apps.isin(HTTP_APPS) | (names["proto"] == "HTTP")
    return {
        **{c: int(groups[c].sum()) for c in SUMS},
        "squares": Decimal(sum(groups["squares"])),
        "http": int(n[http].sum()),
        "dns": int(n[apps == "dns"].sum()),
        "tls": int(n[apps == "tls"].sum()),
        "tcp": int(n[names["proto"] == "TCP"].sum()),
        "first_at": int(groups["first_at"].min()),
        "last_at": int(groups["last_at"].max()),
        "busiest": min(by_source.items(), key=lambda s: (-s[1], s[0]))[0] if len(by_source) else None,
        "protos": sorted({p for p in names["proto"] if p}),
        "apps": sorted({a for a in apps if a}),
    }


class ArrivalWindows(StatefulProcessor):
    """Per sensor: the anchor, the open window's number, and its groups."""

    def __init__(self, key: str, seconds: int):
        self.key, self.width = key, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", PLACE_STATE)
        # written as a whole once a batch: a call to the state for every group takes longer than the sums
        self.groups = handle.getListState("groups", GROUP_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        flows = pd.concat(list(rows), ignore_index=True).sort_values("arrival_seq", kind="stable", ignore_index=True)
        at = flows["at"].to_numpy()
        anchor, index = self.place.get() if self.place.exists() else (int(at[0]), 0)
        flows["window_index"] = np.maximum(np.maximum.accumulate((at - anchor) // self.width), index)
        flows["n"] = 1
        # whole numbers of any length, so the sum is exact
        flows["squares"] = flows["bytes"].to_numpy().astype(object) ** 2
        found = _grouped(flows)
        newest = int(flows["window_index"].iloc[-1])
        closed = []
        for number, groups in found.groupby("window_index"):
            if number < newest:
                closed.append(self.total(key, anchor, int(number), self.with_open(groups) if number == index else groups))
        if newest > index and index not in set(found["window_index"]) and self.groups.exists():
            closed.append(self.total(key, anchor, index, self.with_open(None)))
        self.keep(found[found["window_index"] == newest], fresh=newest > index)
        self.place.update((anchor, newest))
        if closed:
            yield pd.DataFrame(closed)

    def with_open(self, groups: pd.DataFrame | None) -> pd.DataFrame:
        """The open window's groups in the state, together with those that came now."""
        kept = pd.DataFrame([tuple(g) for g in self.groups.get()], columns=GROUP_STATE.names)
        kept["squares"] = kept["squares"].map(int).astype(object)
        parts = [p for p in (kept, groups) if p is not None and len(p)]
        return _merged(pd.concat(parts, ignore_index=True))

    def keep(self, groups: pd.DataFrame, fresh: bool) -> None:
        known = groups if fresh else self.with_open(groups)
        cells = [known[c].tolist() for c in GROUP_STATE.names[:-1]]
        self.groups.put(list(zip(*cells, map(str, known["squares"]), strict=True)))

    def total(self, key, anchor: int, number: int, groups: pd.DataFrame) -> dict:
        return {self.key: key[0], "anchor": anchor, "window_index": number, **_total(groups)}

    def close(self) -> None:
        pass


def stream_arrival_features(flows: DataFrame, seconds: int, key: str = KEY, arrival: str = "arrival_seq") -> DataFrame:
    """Feature rows of windows in order of arrival, anchored at each sensor's first flow.

    Equal to ``assign_arrival_windows`` and ``window_features_by(drop_open=True)`` over all flows: the
    index of a flow's window never goes back, and each sensor's last window stays open. Micro-batches
    follow each other as the source gives them; inside one, flows are ordered by ``arrival``. A batch's
    flows of one sensor are worked on in one task, so the source's limit per trigger bounds it.
    """
    state = F.upper("state")
    names = F.to_json(F.array("src", "proto", "app_proto"))
    flagged = lambda hit: F.coalesce(hit, F.lit(False)).cast("long")
    rows = flows.select(
        key,
        F.col(arrival).cast("long").alias("arrival_seq"),
        F.unix_micros("ts").alias("at"),
        names.alias("group"),
        flow_bytes().cast("long").alias("bytes"),
        flow_packets().cast("long").alias("pkts"),
        flagged(F.col("state").rlike(SYN_STATES)).alias("syn"),
        flagged(state.contains("ACK")).alias("ack"),
        flagged(state.contains("FIN")).alias("fin"),
        flagged(state.contains("RST")).alias("rst"),
    )
    long = lambda c: T.StructField(c, T.LongType())
    totals = T.StructType(
        [flows.schema[key]]
        + [long(c) for c in ["anchor", "window_index", *SUMS]]
        + [T.StructField("squares", T.DecimalType(38, 0))]
        + [long(c) for c in [*COUNTS, "first_at", "last_at"]]
        + [T.StructField("busiest", T.StringType())]
        + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("protos", "apps")]
    )
    closed = rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=ArrivalWindows(key, seconds),
        outputStructType=totals,
        outputMode="Append",
        timeMode="None",
    )
    step = F.lit(seconds * 1_000_000)
    start = F.col("anchor") + F.col("window_index") * step
    closed = closed.withColumns({"window_start": F.timestamp_micros(start), "window_end": F.timestamp_micros(start + step)})
    by = [key, "window_index", "window_start", "window_end"]
    return features_of_totals(closed, by).select(*by, *FEATURES, *CONTEXT)
