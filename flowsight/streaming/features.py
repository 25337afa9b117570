"""Feature streams: tumbling windows and trailing windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowsight.functions.scalars import round_even
from flowsight.operators.features import SLICE_PARTS, approx_unique_endpoints, flow_bytes, flow_packets, window_features
from flowsight.schema import KEY


def stream_window_features(
    flows: DataFrame, window: str = "10 seconds", *, lateness: str, key: str = KEY
) -> DataFrame:
    """Feature rows of windows that the event time has passed by ``lateness``.

    ``lateness`` has no default, as flows that come later than that are left out: it is the time
    within which all flows are known to arrive. Until then a late flow counts in its own window. Empty windows give no row, and
    the last window stays open until later flows close it.
    """
    return window_features(flows.withWatermark("ts", lateness), window, key)


def stream_unique_endpoints(
    flows: DataFrame, window: str = "10 seconds", *, lateness: str, key: str = KEY
) -> DataFrame:
    return approx_unique_endpoints(flows.withWatermark("ts", lateness), window, key)


def once_per_window(rows: DataFrame, lateness: str = "1 hour", key: str = KEY) -> DataFrame:
    """Rows of a feature stream without repeats of a (sensor, window)."""
    return rows.withWatermark("window_start", lateness).dropDuplicatesWithinWatermark(
        [key, "window_start"]
    )


# --- trailing features ---

FLOW_FIELDS = ["at", "bytes", "pkts", "syn"]
SUB_SLICE = T.StructType([T.StructField("sub", T.IntegerType())])
SUB_SUMS = T.StructType(
    [T.StructField("sub", T.ArrayType(T.IntegerType()))]
    + [T.StructField(c, T.ArrayType(T.LongType())) for c in ["n", "bytes", "pkts", "syn"]]
    + [T.StructField("squares", T.ArrayType(T.StringType()))]
)
SUB_FLOWS = T.StructType([T.StructField(c, T.ArrayType(T.LongType())) for c in FLOW_FIELDS])


class TrailingWindow(StatefulProcessor):
    """Keeps the flows of one slice of a sensor's time and answers for the flows that arrive.

    A slice is as long as the window, and sees a copy of the flows of the slice before it, so a
    busy sensor's history is spread over slices that expire by themselves. Within a slice the flows
    are kept by sub-slice, with a sum for each: a window is made of whole sub-slices, whose sums are
    added, and of the two that its ends cut, which alone are read flow by flow. Every look at the state
    is a message to the JVM, so the sums of a slice are one value, and tell which sub-slices there are.
    """

    def __init__(self, key: str, seconds: int):
        self.key, self.width = key, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("totals", SUB_SUMS)
        self.flows = handle.getMapState("flows", SUB_SLICE, SUB_FLOWS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows), ignore_index=True)
        start = int(key[1]) * self.width
        arrived["sub"] = (arrived["at"].to_numpy() - start) * SLICE_PARTS // self.width
        value = self.sums.get()
        sums = {} if value is None else {sub: (*four, int(squares)) for sub, *four, squares in zip(*value, strict=True)}
        if not sums:
            # The last flow that can need this slice is one slice later.
            self.handle.registerTimer((start + self.width) // 1000)
        read: dict[int, np.ndarray] = {}
        for sub, new in arrived.groupby("sub"):
            cells = new[FLOW_FIELDS].to_numpy().T
            read[int(sub)] = known = np.concatenate([self.stored(int(sub)), cells], axis=1) if int(sub) in sums else cells
            squares = int((cells[1].astype(object) ** 2).sum())
            own = (cells.shape[1], *(int(c.sum()) for c in cells[1:]), squares)
            sums[int(sub)] = tuple(a + b for a, b in zip(sums.get(int(sub), (0,) * 5), own, strict=True))
            self.flows.updateValue((int(sub),), tuple(row.tolist() for row in known))
        *four, squares = zip(*sums.values())
        self.sums.update((list(sums), *map(list, four), [str(s) for s in squares]))
        own = arrived[arrived["own"]]
        if len(own):
            yield pd.concat([self.answer(key, int(sub), sums, read, part) for sub, part in own.groupby("sub")], ignore_index=True)

    def stored(self, sub: int) -> np.ndarray:
        """The flows of a sub-slice that is in the state, as rows of ``FLOW_FIELDS``."""
        return np.array(self.flows.getValue((sub,)), dtype=np.int64).reshape(len(FLOW_FIELDS), -1)

    def answer(self, key, sub: int, sums: dict, read: dict, own: pd.DataFrame) -> pd.DataFrame:
        """Totals for flows of one sub-slice; a window reaches back to the same place 64 earlier."""
        whole = [sums[s] for s in sums if sub - SLICE_PARTS < s < sub]
        base = [sum(column) for column in zip(*whole)] if whole else [0] * 5
        times = own["at"].to_numpy()
        totals = [np.full(len(own), base[i], dtype=object) for i in range(5)]
        for edge, oldest in ((sub, None), (sub - SLICE_PARTS, times - self.width)):
            if edge not in sums:
                continue
            if edge not in read:
                read[edge] = self.stored(edge)
            flows = read[edge][:, np.argsort(read[edge][0], kind="stable")]
            cells = [np.ones(flows.shape[1], dtype=object), *flows[1:].astype(object), flows[1].astype(object) ** 2]
            last = np.searchsorted(flows[0], times, side="right") if oldest is None else np.full(len(own), flows.shape[1])
            first = np.zeros(len(own), dtype=int) if oldest is None else np.searchsorted(flows[0], oldest, side="left")
            for i, c in enumerate(cells):
                running = np.concatenate(([0], np.cumsum(c)))
                totals[i] = totals[i] + running[last] - running[first]
        n, size, pkts, syn, squares = totals
        out = {self.key: [key[0]] * len(own), "arrival_seq": own["arrival_seq"].to_numpy(), "at": times}
        out |= {c: v.astype(np.int64) for c, v in (("n", n), ("bytes", size), ("pkts", pkts), ("syn", syn))}
        # Squares are summed as whole numbers of any length, so the difference is exact.
        spread = (n * squares - size**2).astype(float)
        out["std"] = np.sqrt(spread / np.maximum(out["n"] * (out["n"] - 1), 1))
        return pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sums.clear()
        self.flows.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_trailing_features(
    flows: DataFrame, seconds: int = 30, *, lateness: str, key: str = KEY
) -> DataFrame:
    """Trailing-window features for every flow, from the flows that have arrived by then."""
    width = seconds * 1_000_000
    if "arrival_seq" not in flows.columns:  # a stream of files has no reading order
        flows = flows.withColumn("arrival_seq", F.lit(0).cast("long"))
    rows = flows.withWatermark("ts", lateness).select(
        key,
        "ts",
        F.unix_micros("ts").alias("at"),
        "arrival_seq",
        flow_bytes().alias("bytes"),
        flow_packets().alias("pkts"),
        F.upper("state").contains("SYN").cast("long").alias("syn"),
    )
    first = F.floor(F.col("at") / F.lit(width)).cast("long")
    copies = rows.withColumn("_first", first).withColumn(
        "slice", F.explode(F.array("_first", F.col("_first") + 1))
    )
    copies = copies.withColumn("own", F.col("slice") == F.col("_first")).drop("_first")
    totals = T.StructType(
        [flows.schema[key]]
        + [T.StructField(c, T.LongType()) for c in ["arrival_seq", "at", "n", "bytes", "pkts", "syn"]]
        + [T.StructField("std", T.DoubleType())]
    )
    out = copies.groupBy(key, "slice").transformWithStateInPandas(
        statefulProcessor=TrailingWindow(key, seconds),
        outputStructType=totals,
        outputMode="Append",
        timeMode="EventTime",
    )
    n = F.col("n").cast("double")
    syn = round_even(F.col("syn") / n, 6)
    zero = F.lit(0.0)
    return out.select(
        key,
        "arrival_seq",
        F.timestamp_micros("at").alias("ts"),
        F.col("n").alias("flows"),
        F.col("bytes").alias("bytes_total"),
        F.col("pkts").alias("pkts_total"),
        syn.alias("syn_ratio"),
        round_even(F.col("bytes") / n, 6).alias("mean_bytes_flow"),
        zero.alias("ack_ratio"),
        zero.alias("fin_ratio"),
        zero.alias("rst_ratio"),
        zero.alias("http_ratio"),
        syn.alias("tcp_ratio"),
        F.lit(1).alias("protocol_diversity"),
        round_even(F.col("std"), 2).alias("std_bytes"),
        zero.alias("iat_mean"),
    )
