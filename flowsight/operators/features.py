"""Traffic features: tumbling windows, trailing windows, arrival-order windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowsight.functions.scalars import (
    exact_variance,
    join_square,
    ratio,
    round_even,
    split_square,
    squared,
)
from flowsight.operators.lookups import lookup, match
from flowsight.operators.ordering import count_bucket, time_bucket, with_running_sums
from flowsight.schema import FEATURES, KEY, MAX_PROTOCOLS

# Application protocols counted as HTTP, and words that mark a SYN-type state.
HTTP_APPS = ["http", "http_proxy"]
SYN_STATES = "(?i)new|syn"


def flow_bytes() -> Column:
    return F.col("bytes_toserver") + F.col("bytes_toclient")


def flow_packets() -> Column:
    return F.col("pkts_toserver") + F.col("pkts_toclient")


def _total(name: str) -> Column:
    return F.sum(name).alias(name)


def _flagged(hit: Column) -> Column:
    return hit.cast("long")


def window_features(
    flows: DataFrame,
    window: str = "10 seconds",
    key: str = KEY,
    start: str | None = None,
) -> DataFrame:
    """One feature row per (sensor, tumbling window); works on batch and streaming flows.

    ``start`` shifts the windows from the epoch (an interval such as ``"3 seconds"``); see
    :func:`window_features_by` for windows anchored per sensor.
    """
    frame = F.window("ts", window, startTime=start) if start else F.window("ts", window)
    return (
        summarize_flows(flows.withColumn("_window", frame), [key, "_window"])
        .withColumn("window_start", F.col("_window.start"))
        .withColumn("window_end", F.col("_window.end"))
        .select(key, "window_start", "window_end", *FEATURES, *CONTEXT)
    )


# Columns that describe a window's traffic but are not model inputs.
CONTEXT = ["top_src_ip", "http_flows", "dns_flows", "tls_flows", "app_protos"]


def summarize_flows(flows: DataFrame, by: list[str]) -> DataFrame:
    """The 13 features and the context columns per group of flows.

    Two aggregations. The first counts flows in two ways at once, per source and per pair of
    protocols, so it shrinks the flows before they are shuffled, spreads a busy window over its sources,
    and is, on a stream, the only state that grows with the sources. The second builds lists and picks the
    top source, per window.
    """
    state = F.upper("state")
    flow = flows.select(
        *by,
        "src",
        "proto",
        "app_proto",
        F.unix_micros("ts").alias("at"),
        flow_bytes().alias("bytes"),
        flow_packets().alias("pkts"),
        _flagged(F.col("state").rlike(SYN_STATES)).alias("syn"),
        _flagged(state.contains("ACK")).alias("ack"),
        _flagged(state.contains("FIN")).alias("fin"),
        _flagged(state.contains("RST")).alias("rst"),
    )
    # Of a source only the flows are counted; what is summed up is summed per pair of protocols.
    measured = ["bytes", "pkts", "syn", "ack", "fin", "rst"]
    sums = ["n", *measured, "squares"]
    none = F.lit(None).cast("string")
    nothing = [F.lit(None).cast(flow.schema[c].dataType).alias(c) for c in ["at", *measured]]
    views = F.array(
        F.struct(F.lit(True).alias("of_source"), F.col("src").alias("src"), none.alias("proto"), none.alias("app_proto"), *nothing),
        F.struct(F.lit(False).alias("of_source"), none.alias("src"), F.col("proto"), F.col("app_proto"), *[F.col(c) for c in ["at", *measured]]),
    )
    viewed = flow.withColumn("_view", F.explode(views)).select(*by, "_view.*")
    counted = viewed.groupBy(*by, "of_source", "src", "proto", "app_proto").agg(
        F.count(F.lit(1)).alias("n"),
        *[_total(c) for c in measured],
        F.sum(squared(F.col("bytes"))).alias("squares"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
    )

    def flows_where(hit: Column, name: str) -> Column:
        return F.sum(F.when(hit, F.col("n")).otherwise(F.lit(0))).alias(name)

    http = F.col("app_proto").isin(HTTP_APPS) | (F.col("proto") == "HTTP")
    source = F.col("of_source") & F.col("src").isNotNull()
    ranked = F.struct((-F.col("n")).alias("rank"), F.col("src").alias("src"))
    names = lambda c: F.collect_set(F.nullif(F.col(c), F.lit("")))
    total = counted.groupBy(*by).agg(
        *[F.sum(F.when(~F.col("of_source"), F.col(c))).alias(c) for c in sums],
        flows_where(http, "http"),
        flows_where(F.col("app_proto") == "dns", "dns"),
        flows_where(F.col("app_proto") == "tls", "tls"),
        flows_where(F.col("proto") == "TCP", "tcp"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.min(F.when(source, ranked)).alias("busiest"),
        names("proto").alias("protos"),
        F.array_sort(names("app_proto")).alias("apps"),
    )
    return features_of_totals(total.withColumn("busiest", F.col("busiest.src")), by)


def features_of_totals(total: DataFrame, by: list[str]) -> DataFrame:
    """The features and context columns from a window's sums, protocol lists and busiest source."""
    n = F.col("n")
    share = lambda c: ratio(F.col(c).cast("double"), n.cast("double"))
    span = (F.col("last_at") - F.col("first_at")).cast("double") / F.lit(1e6)
    names = F.size(F.array_union("protos", "apps"))
    return total.select(
        *by,
        n.alias("flows"),
        F.col("bytes").alias("bytes_total"),
        F.col("pkts").alias("pkts_total"),
        share("syn").alias("syn_ratio"),
        share("bytes").alias("mean_bytes_flow"),
        share("ack").alias("ack_ratio"),
        share("fin").alias("fin_ratio"),
        share("rst").alias("rst_ratio"),
        share("http").alias("http_ratio"),
        share("tcp").alias("tcp_ratio"),
        F.least(F.lit(MAX_PROTOCOLS), names).cast("int").alias("protocol_diversity"),
        F.sqrt(exact_variance(n, F.col("bytes"), F.col("squares"))).alias("std_bytes"),
        # Successive gaps of the sorted times add up to last - first.
        ratio(span, (n - 1).cast("double")).alias("iat_mean"),
        F.col("busiest").alias("top_src_ip"),
        F.col("http").alias("http_flows"),
        F.col("dns").alias("dns_flows"),
        F.col("tls").alias("tls_flows"),
        F.col("apps").alias("app_protos"),
    )


def unique_endpoints(flows: DataFrame, window: str = "10 seconds", key: str = KEY) -> DataFrame:
    """Distinct sources and destinations per (sensor, window)."""
    return (
        flows.groupBy(key, F.window("ts", window).alias("_window"))
        .agg(
            F.count_distinct("src").alias("uniq_src"),
            F.count_distinct("dst").alias("uniq_dst"),
        )
        .select(
            key,
            F.col("_window.start").alias("window_start"),
            "uniq_src",
            "uniq_dst",
        )
    )


def approx_unique_endpoints(flows: DataFrame, window: str = "10 seconds", key: str = KEY) -> DataFrame:
    """As :func:`unique_endpoints` with sketches; the form to use on a stream."""
    return (
        flows.groupBy(key, F.window("ts", window).alias("_window"))
        .agg(
            F.approx_count_distinct("src").alias("uniq_src"),
            F.approx_count_distinct("dst").alias("uniq_dst"),
        )
        .select(key, F.col("_window.start").alias("window_start"), "uniq_src", "uniq_dst")
    )


# --- windows anchored at a sensor's first flow, and windows in arrival order ---


def sensor_anchors(flows: DataFrame, key: str = KEY, arrival: str = "arrival_seq") -> DataFrame:
    """Time of the first flow to arrive, per sensor."""
    return flows.groupBy(key).agg(F.min_by("ts", arrival).alias("anchor"))


def anchored_index(ts: Column, anchor: Column, seconds: int) -> Column:
    elapsed = F.unix_micros(ts) - F.unix_micros(anchor)
    return F.floor(elapsed / F.lit(seconds * 1_000_000)).cast("long")


def window_features_by(
    indexed: DataFrame, seconds: int, key: str = KEY, drop_open: bool = False
) -> DataFrame:
    """Features per (sensor, window index), for flows that carry ``anchor`` and ``window_index``.

    ``drop_open`` leaves out each sensor's last window, the one no later flow has closed.
    """
    rows = summarize_flows(indexed, [key, "anchor", "window_index"])
    step = F.lit(seconds * 1_000_000)
    start = F.unix_micros("anchor") + F.col("window_index") * step
    rows = rows.withColumn("window_start", F.timestamp_micros(start)).withColumn(
        "window_end", F.timestamp_micros(start + step)
    )
    rows = rows.select(key, "window_index", "window_start", "window_end", *FEATURES, *CONTEXT)
    return closed_windows(rows, key, "window_index") if drop_open else rows


def closed_windows(rows: DataFrame, key: str = KEY, order: str = "window_start") -> DataFrame:
    """Feature rows without each sensor's last window."""
    last = rows.groupBy(key).agg(F.max(order).alias("_last"))
    known = lookup(rows, last, [key], "inner")
    return known.filter(F.col(order) < F.col("_last")).drop("_last")


def assign_anchored_windows(
    flows: DataFrame, anchors: DataFrame, seconds: int, key: str = KEY
) -> DataFrame:
    """Window index by event time, counted from each sensor's anchor."""
    return lookup(flows, anchors, [key], how="inner").withColumn(
        "window_index", anchored_index(F.col("ts"), F.col("anchor"), seconds)
    )


def assign_arrival_windows(
    flows: DataFrame,
    anchors: DataFrame | None,
    seconds: int,
    key: str = KEY,
    arrival: str = "arrival_seq",
    bucket_rows: int = 1_000_000,
) -> DataFrame:
    """Window index in arrival order: it never goes back, so a late flow joins the current window.

    The index is that of the latest time seen so far. Buckets of arrivals are reduced to their first
    and latest time; the same few rows give the anchor, a sensor's first time, unless ``anchors``
    names it.
    """
    rows = flows.withColumn("_bucket", count_bucket(F.col(arrival), bucket_rows))
    heads = rows.groupBy(key, "_bucket").agg(F.max("ts").alias("_peak"), F.min_by("ts", arrival).alias("_first"))
    order = W.partitionBy(key).orderBy("_bucket")
    carried = heads.select(
        key,
        "_bucket",
        F.max("_peak").over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_carried"),
        F.first("_first").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("anchor"),
    )
    if anchors is not None:
        carried = match(carried.drop("anchor"), anchors, [key])
    inside = W.partitionBy(key, "_bucket").orderBy(arrival).rangeBetween(W.unboundedPreceding, W.currentRow)
    latest = F.greatest(F.max("ts").over(inside), "_carried")
    rows = match(rows, carried, [key, "_bucket"]).withColumn("_latest", latest)
    index = anchored_index(F.col("_latest"), F.col("anchor"), seconds)
    return rows.select(*flows.columns, "anchor", index.alias("window_index"))


# --- trailing windows, one output row per flow ---


def trailing_features(flows: DataFrame, seconds: int = 30, key: str = KEY) -> DataFrame:
    """Features over the flows of the last ``seconds``, for every flow.

    A flow counts from its own time until just after ``seconds`` later. Summing those entries and
    exits in time order gives every trailing total in one running pass, where a sliding frame would
    add each window up anew. Time is cut in slices of ``seconds``: a flow can only matter in its
    own slice and the next. Slices are cut again into parts of time, which start from the totals of
    the parts before them, so a slice that holds most rows is the work of many tasks.
    """
    measures = {
        "n": F.lit(1).cast("long"),
        "bytes": flow_bytes(),
        "pkts": flow_packets(),
        "syn": F.upper("state").contains("SYN").cast("long"),
        **split_square(flow_bytes()),
    }
    at = F.unix_micros("ts")
    rows = flows.select(
        key, "arrival_seq", "ts", at.alias("at"), *[m.alias(c) for c, m in measures.items()]
    ).withColumn("leaves_at", F.col("at") + seconds * 1_000_000 + 1)
    sums = sliding_totals(rows, [key], list(measures), seconds)
    n = F.col("n").cast("double")
    syn = round_even(F.col("syn") / n, 6)
    zero = F.lit(0.0)
    return sums.select(
        key,
        "arrival_seq",
        "ts",
        F.col("n").alias("flows"),
        F.col("bytes").alias("bytes_total"),
        F.col("pkts").alias("pkts_total"),
        syn.alias("syn_ratio"),
        round_even(F.col("bytes") / n, 6).alias("mean_bytes_flow"),
        # Features this path does not measure.
        zero.alias("ack_ratio"),
        zero.alias("fin_ratio"),
        zero.alias("rst_ratio"),
        zero.alias("http_ratio"),
        syn.alias("tcp_ratio"),
        F.lit(1).alias("protocol_diversity"),
        round_even(
            F.sqrt(exact_variance(F.col("n"), F.col("bytes"), join_square())), 2
        ).alias("std_bytes"),
        zero.alias("iat_mean"),
    )


#: Parts of a slice of time that are worked on apart, so a slice that holds most rows is no single task.
SLICE_PARTS = 64


def sliding_totals(rows: DataFrame, keys: list[str], measures: list[str], seconds: int) -> DataFrame:
    """For each row, ``measures`` summed over the rows present at its time.

    A row is present from ``at`` until before ``leaves_at`` (microseconds), which is at most
    ``seconds`` plus one microsecond later.
    """
    slice_us = seconds * 1_000_000
    first = F.col("_first")
    start_of_next = (first + 1) * F.lit(slice_us)
    stays = F.col("leaves_at") > start_of_next

    def move(in_slice: Column, at: Column, sign: int, own: bool) -> Column:
        return F.struct(
            in_slice.alias("_slice"), at.alias("_at"), F.lit(sign).alias("_sign"), F.lit(own).alias("_own")
        )

    # Every row enters its own slice. A row still present when the next slice starts enters that
    # too, just before its first instant, and leaves there; other rows leave in their own slice.
    enter = move(first, F.col("at"), 1, True)
    stay = F.array(
        enter,
        move(first + 1, start_of_next - 1, 1, False),
        move(first + 1, F.col("leaves_at"), -1, False),
    )
    go = F.array(enter, move(first, F.col("leaves_at"), -1, False))
    placed = rows.withColumn("_first", F.floor(F.col("at") / F.lit(slice_us)).cast("long"))
    moves = placed.select(
        *rows.columns, F.explode(F.when(stays, stay).otherwise(go)).alias("_move")
    ).select(*rows.columns, "_move.*")
    kept = [c for c in rows.columns if c not in measures and c != "leaves_at"]
    moves = moves.select(*kept, "_slice", "_at", "_own", *[(F.col(m) * F.col("_sign")).alias(m) for m in measures])
    # the first part also takes the rows that enter just before the slice
    part = F.floor((F.col("_at") - F.col("_slice") * slice_us) * SLICE_PARTS / F.lit(slice_us)).cast("int")
    totals = with_running_sums(moves, [*keys, "_slice"], "_at", F.greatest(part, F.lit(0)), measures)
    return totals.filter("_own").select(*kept, *measures)


def trailing_unique(
    flows: DataFrame, endpoint: str, seconds: int = 30, key: str = KEY, name: str | None = None
) -> DataFrame:
    """Distinct values of ``endpoint`` in the trailing window, for every flow.

    A flow stands for its endpoint only until the endpoint's next flow, so the count of standing
    flows is the count of distinct endpoints.
    """
    width = seconds * 1_000_000
    at = F.unix_micros("ts")
    rows = flows.select(
        key, "arrival_seq", "ts", at.alias("at"), F.col(endpoint).alias("_endpoint")
    ).withColumn("_slice", F.floor(F.col("at") / F.lit(width)).cast("long"))
    # The next flow of an endpoint matters only if it is within `seconds`: in the same slice, or
    # the first one of the next slice.
    heads = (
        rows.groupBy(key, "_endpoint", "_slice")
        .agg(F.min("at").alias("at"))
        .withColumn("_slice", F.col("_slice") - 1)
        .withColumn("_head", F.lit(True))
    )
    # An endpoint's flows of one slice are the unit of work: finer than the slice of a busy sensor.
    task = W.partitionBy(key, "_endpoint", "_slice").orderBy("at", "_head")
    listed = rows.withColumn("_head", F.lit(False)).unionByName(heads, allowMissingColumns=True)
    standing = (
        listed.withColumn("_next", F.lead("at").over(task))
        .filter(~F.col("_head"))
        .withColumn("leaves_at", F.least(F.col("_next"), F.col("at") + width + 1))
        .withColumn("n", F.col("_endpoint").isNotNull().cast("long"))
        .drop("_next", "_head", "_endpoint", "_slice")
    )
    return sliding_totals(standing, [key], ["n"], seconds).select(
        key, "arrival_seq", "ts", F.col("n").alias(name or f"uniq_{endpoint}")
    )


def interarrival_gaps(flows: DataFrame, seconds: int = 3600, key: str = KEY) -> DataFrame:
    """Seconds since the sensor's previous flow (null for its first).

    Within a part of a time slice that is a plain lag; a part's first flow looks back to the latest
    flow of any earlier part of the slice, or of any earlier slice.
    """
    part = F.pmod(F.unix_micros("ts"), F.lit(seconds * 1_000_000)) * SLICE_PARTS / F.lit(seconds * 1_000_000)
    rows = flows.select(key, "arrival_seq", "ts").withColumns(
        {"_slice": time_bucket(F.col("ts"), seconds), "_part": F.floor(part).cast("int")}
    )
    lasts = rows.groupBy(key, "_slice", "_part").agg(F.max("ts").alias("_last"))
    before = lambda by, order: W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    in_slice = lasts.withColumn("_carried", F.max("_last").over(before([key, "_slice"], "_part"))).drop("_last")
    slices = lasts.groupBy(key, "_slice").agg(F.max("_last").alias("_last"))
    slices = slices.withColumn("_earlier", F.max("_last").over(before([key], "_slice"))).drop("_last")
    entries = match(in_slice, slices, [key, "_slice"])
    entries = entries.select(key, "_slice", "_part", F.coalesce("_carried", "_earlier").alias("_carried"))
    inside = W.partitionBy(key, "_slice", "_part").orderBy("ts", "arrival_seq")
    previous = F.coalesce(F.lag("ts").over(inside), F.col("_carried"))
    gap = (F.unix_micros("ts") - F.unix_micros(previous)) / F.lit(1e6)
    return match(rows, entries, [key, "_slice", "_part"]).select(
        key, "arrival_seq", "ts", gap.alias("gap_sec")
    )
