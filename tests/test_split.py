import pytest
from pyspark.sql import functions as F

from flowsight.operators import lookups, ordering, split
from flowsight.schema import FEATURES


def converted(spark):
    counts = {
        "DDoS-SYN_Flood.pcap_converted.csv": 4,
        "XSS.pcap_converted.csv": 5,
        "BenignTraffic1.pcap_converted.csv": 11,
        "benign_sim_15f.csv": 5,
        "ciciot_benign_15f.csv": 3,
        "other-benign.csv": 1,
    }
    rows = [(f, i * 7, float(i)) for f, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "source_file string, row_position long, flows double")


def test_split_by_file(spark):
    out = split.split_by_file(converted(spark))
    parts = {(r.source_file.split(".")[0], r.part): (r.n, r.label) for r in out.groupBy("source_file", "part").agg(F.count("*").alias("n"), F.first("label").alias("label")).collect()}
    assert parts == {
        ("DDoS-SYN_Flood", "test"): (4, "DDoS-SYN_Flood"),
        ("XSS", "train"): (5, "XSS"),
        ("BenignTraffic1", "train"): (8, "benign"),
        ("BenignTraffic1", "test"): (3, "benign"),
        ("benign_sim_15f", "train"): (2, "benign"),
        ("benign_sim_15f", "test"): (3, "benign"),
        ("other-benign", "train"): (1, "benign"),
    }
    first = out.filter("part = 'train' AND source_file LIKE 'BenignTraffic%'").agg(F.max("row_position")).first()[0]
    assert first == 49


def test_heads_do_not_depend_on_buckets(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 13 % 1009).alias("o"))
    for width in (1, 10, 5000):
        out = split.head_or_tail(df, ["g"], "o", ordering.count_bucket(F.col("o"), width), F.floor(F.col("total") * 0.25))
        assert out.count() == 1000
        sizes = {r.g: (r.n, r.high, r.low) for r in out.groupBy("g").agg(
            F.count_if("in_head").alias("n"), F.max(F.when(F.col("in_head"), F.col("o"))).alias("high"), F.min(F.when(~F.col("in_head"), F.col("o"))).alias("low")).collect()}
        assert {g: s[0] for g, s in sizes.items()} == {0: 83, 1: 83, 2: 83}
        assert all(s[1] < s[2] for s in sizes.values())
    none = split.head_or_tail(df, ["g"], "o", ordering.count_bucket(F.col("o"), 10), F.lit(0))
    assert none.filter("in_head").isEmpty() and none.count() == 1000


def test_positions(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), (F.col("id") * 7 % 503).alias("o"))
    out = ordering.with_position(df, ["g"], ["o"], ordering.count_bucket(F.col("o"), 20))
    rows = out.orderBy("g", "o").collect()
    assert [r.position for r in rows] == [*range(250), *range(250)]


def test_stratified_split_is_exact_and_stable(spark):
    df = spark.range(1003).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    a = split.stratified_split(df, ["id"])
    counts = {r.y: r.n for r in a.groupBy("y").agg(F.count_if("is_validation").alias("n")).collect()}
    assert counts == {0: 180, 1: 20}
    b = split.stratified_split(df.repartition(7), ["id"])
    assert a.exceptAll(b).isEmpty()
    assert not a.exceptAll(split.stratified_split(df, ["id"], seed=1)).isEmpty()
    loose = split.stratified_split(df, ["id"], exact=False)
    assert 130 < loose.filter("is_validation").count() < 270
    assert "Exchange" not in loose._jdf.queryExecution().toString()


def test_training_set_is_distinct_and_shuffled(spark):
    rows = [(*([float(i % 40)] * len(FEATURES)), "x", i) for i in range(100)]
    df = spark.createDataFrame(rows, ", ".join([*(f"{c} double" for c in FEATURES), "label string", "extra int"]))
    out = split.training_set(df)
    first = [r.flows for r in out.collect()]
    assert len(first) == 40 and out.columns == [*FEATURES, "label"]
    assert first != sorted(first) and first == [r.flows for r in split.training_set(df.repartition(5)).collect()]
    n = split.duplicate_count(df.drop("extra")).first()
    assert (n.before, n.after, n.dropped) == (100, 40, 60)


def test_union_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([("y", 2)], "b string, c int")
    assert {tuple(r) for r in split.union_datasets(a, b).collect()} == {(1, "x", None), (None, "y", 2)}


def test_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    weights = {r.y: r.weight for r in split.balanced_weights(df).distinct().collect()}
    assert weights == {0: pytest.approx(8 / 12), 1: 2.0}


def test_replay(spark):
    df = converted(spark).filter("flows < 4")
    out = split.replay_feed(df, cycles=3, rows_per_file=2)
    assert out.columns == ["source_file", "row_position", *FEATURES, "cycle"]
    assert out.count() == 3 * (2 * 5 + 1)
    assert out.agg(F.max("row_position")).first()[0] == 7
    assert split.replay_feed(df, cycles=0).count() == df.count()


def test_lookup_keeps_null_keys_and_runs_no_job(spark):
    left = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"), "id"
    )
    dim = spark.range(200).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), (F.col("id") * 2).alias("v"))
    found = {r.id: (r.k, r.v) for r in lookups.lookup(left, dim, ["k"]).collect()}
    want = {r.id: (r.k, 0 if r.k is None else r.k * 2 if r.k < 200 else None) for r in left.collect()}
    assert found == want
    inner = lookups.lookup(left, dim, ["k"], "inner", salts=4)
    assert inner.columns == ["k", "id", "v"]
    assert inner.count() == left.filter("k IS NULL OR k < 200").count()


def test_running_max_over_buckets(spark):
    import random

    rng = random.Random(1)
    rows = [(i % 2, i, rng.choice([None, rng.randrange(100)])) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, o long, v int")
    out = ordering.with_running_max(df, ["g"], F.col("o"), ordering.count_bucket(F.col("o"), 9), F.col("v"), "m")
    for r in out.collect():
        seen = [v for g, o, v in rows if g == r.g and o <= r.o and v is not None]
        assert r.m == (max(seen) if seen else None)


class Session:
    """Just enough of a session to ask for its settings."""

    def __init__(self, **settings):
        self.conf = settings


def test_scratch_folder():
    from flowsight.session import scratch_dir

    folders = {"spark.checkpoint.dir": "hdfs:///shared/", "spark.sql.warehouse.dir": "hdfs:///warehouse"}
    assert scratch_dir(Session(**folders), "x").startswith("hdfs:///shared/x-")
    del folders["spark.checkpoint.dir"]
    assert scratch_dir(Session(**folders), "x").startswith("hdfs:///warehouse/x-")
