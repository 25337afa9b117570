import pytest
from pyspark.sql import functions as F

from flowsight.functions import labels as lb
from flowsight.operators import clean, convert
from flowsight.plans.adapters import DATASETS
from flowsight.plans.training_queries import LABELS
from flowsight.schema import FEATURES
from flowsight.sources import packets, tables


def test_alias_resolution():
    assert convert.resolve_column(["Tot sum", "x"], convert.BYTES) == "Tot sum"
    assert convert.resolve_column(["packets", "Pkt_Num"], convert.PACKETS) == "Pkt_Num"
    assert convert.resolve_column(["Tot sum", "tot_SUM"], convert.BYTES) == "tot_SUM"
    assert convert.resolve_column(["a"], convert.BYTES) is None


def test_dataset_labels(spark):
    df = spark.createDataFrame([(f"{d}.pcap.csv", x) for d, x in zip(DATASETS, LABELS)], "f string, x string")
    assert df.filter(lb.attack_label(F.col("f")) != F.col("x")).isEmpty()
    odd = spark.createDataFrame([("dir/My Data-Set.csv",), (".csv",)], "f string")
    assert [r[0] for r in odd.select(lb.attack_label(F.col("f"))).collect()] == ["my_data_set", ".csv"]


def test_binary_labels(spark):
    df = spark.createDataFrame([("Benign", 0), ("NORMAL", 1), ("BenignTraffic", 2), ("xss", 0), (None, None)], "l string, n int")
    label = F.col("l")
    got = df.select(
        lb.binary_label(label).alias("a"),
        lb.binary_label(label, "benign_normal").alias("b"),
        lb.binary_label(label, "tokens").alias("c"),
        lb.binary_label(label, "tokens", benign_name="xss").alias("d"),
        lb.binary_label(F.col("n"), "tokens", numeric=True, benign_index=2).alias("e"),
    ).collect()
    assert [tuple(r) for r in got] == [(0, 0, 0, 0, 1), (1, 0, 0, 0, 1), (1, 1, 0, 0, 0), (1, 1, 1, 0, 1), (1, 1, 1, 1, 1)]


def summaries(spark, columns, rows):
    return spark.createDataFrame([("XSS.pcap.csv", *r) for r in rows], ", ".join(["source_file string", *[f"`{c}` string" for c in columns]]))


def test_conversion_by_hand(spark):
    df = summaries(
        spark,
        ["Number", "Tot sum", "syn_flag_number", "ack_count", "fin_flag_number", "HTTP", "tcp", "UDP", "Min", "Max", "Rate"],
        [
            ("4.9", " 1001.006 ", "7", "2", "-1", "1", "9", "3", "2", "10", "0.5"),
            ("0", "x", "", "1", "0.25", "NaN", "0", "0", "9", "1", "0"),
            ("inf", "1", "0", "0", "0", "0", "0", "0", "0", "0", "0"),
            ("1", "inf", "0", "0", "0", "0", "0", "0", "0", "0", "0"),
        ],
    )
    out = convert.convert_packet_summaries(df, with_legacy=True).collect()
    assert len(out) == 2
    a, b = out
    assert (a.flows, a.pkts_total, a.bytes_total, a.mean_bytes_flow) == (4, 4, 1001.01, 250.2515)
    assert (a.syn_ratio, a.ack_ratio, a.fin_ratio, a.rst_ratio) == (1.0, 0.5, 0.0, 0.0)
    assert (a.http_ratio, a.tcp_ratio, a.protocol_diversity, a.std_bytes) == (0.25, 1.0, 2, 2.0)
    assert a.iat_mean == pytest.approx(1.999996, abs=1e-6)
    assert (a.label, a.uniq_src, a.uniq_dst) == ("xss", 1, 1)
    assert (b.flows, b.bytes_total, b.ack_ratio, b.fin_ratio, b.std_bytes, b.iat_mean) == (1, 0.0, 1.0, 0.25, 0.0, 1000.0)


def test_syn_guess_needs_a_flag_column(spark):
    ratio = lambda c: convert.convert_packet_summaries(summaries(spark, ["Number", "bytes", c], [("1", "1", "1")])).first().syn_ratio
    assert (ratio("urg_flag"), ratio("other"), ratio("syn count")) == (0.1, 0.0, 1.0)


def test_proxies_are_opt_out(spark):
    df = summaries(spark, ["name", "first", "second"], [("a", "3", "8"), ("b", " 4 ", "")])
    with pytest.raises(convert.UnresolvedColumns):
        convert.convert_packet_summaries(df, allow_proxy=False)
    rows = convert.convert_packet_summaries(df).collect()
    assert [(r.flows, r.bytes_total) for r in rows] == [(3, 8.0), (4, 0.0)]
    assert convert.packet_and_byte_columns(summaries(spark, ["Number", "size"], []), True) == ("Number", "size")


def write_csvs(folder):
    (folder / "XSS.pcap.csv").write_text("Number,Tot sum,HTTP\n" + "".join(f"{i},{i * 10},1\n" for i in range(1, 6)))
    (folder / "Mirai-udpplain.pcap.csv").write_text("tot_sum,packets\n7,2\n9,3\n")
    (folder / "SqlInjection.pcap.csv").write_text("tot_sum,packets\n8,1\n")
    (folder / "Odd.pcap.csv").write_text("a,label\n1,x\n")
    (folder / "ignored.csv").write_text("Number,bytes\n1,1\n")


def test_files_with_different_headers(spark, tmp_path):
    write_csvs(tmp_path)
    frames = packets.read_packet_summaries(spark, str(tmp_path))
    assert len(frames) == 3
    good, bad = packets.convert_files(frames)
    assert [r.source_file for r in bad.collect()] == ["Odd.pcap.csv"]
    rows = good.collect()
    assert sorted((r.source_file, r.label, r.flows, r.bytes_total) for r in rows if r.label != "xss") == [
        ("Mirai-udpplain.pcap.csv", "mirai_udp", 2, 7.0),
        ("Mirai-udpplain.pcap.csv", "mirai_udp", 3, 9.0),
        ("SqlInjection.pcap.csv", "injection_sql", 1, 8.0),
    ]
    ordered = [r.flows for r in good.filter("label = 'xss'").orderBy("row_position").collect()]
    assert ordered == [1, 2, 3, 4, 5]
    counts = {(r.source_file, r.label): r.rows for r in convert.conversion_summary(good).collect()}
    assert counts[None, None] == 8 and counts["XSS.pcap.csv", "xss"] == 5 and len(counts) == 4

    tables.write_converted(good, str(tmp_path / "converted"))
    stored = tables.read_features(spark, str(tmp_path / "converted"))
    assert stored.count() == 8 and set(FEATURES) < set(stored.columns)


def test_file_profiles_and_coverage(spark, tmp_path):
    raw, done = tmp_path / "raw", tmp_path / "done"
    raw.mkdir(), done.mkdir()
    write_csvs(raw)
    (done / "XSS.pcap_converted.csv").write_text("flows,label\n1,xss\n")
    profile = packets.schema_profile(packets.file_headers(spark, str(raw)))
    by_name = {r.file_name: r for r in profile.collect()}
    assert by_name["Odd.pcap.csv"].has_label and by_name["Odd.pcap.csv"].feature_count == 1
    assert by_name["XSS.pcap.csv"].first_columns == ["Number", "Tot sum", "HTTP"]
    assert packets.profile_summary(profile).first().files == 4
    converted = packets.schema_profile(packets.file_headers(spark, str(done), "*_converted.csv"))
    cover = {r.file_name: (r.converted, r.converted_features) for r in convert.conversion_coverage(profile, converted).collect()}
    assert cover["XSS.pcap.csv"] == (True, 1) and cover["Odd.pcap.csv"][0] is False
    assert convert.unconverted_files(profile, converted).count() == 3


def test_headers_cost_a_few_bytes_a_file(spark, tmp_path, monkeypatch):
    row = ",".join(["12345.678"] * 30) + "\n"
    (tmp_path / "big one.pcap.csv").write_text("Number,Tot sum\n" + row * 10_000)
    (tmp_path / "wide.pcap.csv").write_bytes((",".join(f"c{i}" for i in range(9000)) + "\r\n1\r\n").encode())
    (tmp_path / "line.pcap.csv").write_text("a,b")
    (tmp_path / "empty.pcap.csv").write_text("")
    found = {r.file_name: r.header for r in packets.file_headers(spark, str(tmp_path)).collect()}
    assert set(found) == {"big one.pcap.csv", "wide.pcap.csv", "line.pcap.csv"}
    assert found["big one.pcap.csv"] == "Number,Tot sum" and found["line.pcap.csv"] == "a,b"
    assert found["wide.pcap.csv"].endswith(",c8999")

    read = []

    class Store:
        def open_input_stream(self, name):
            file = open(name, "rb")
            take = file.read
            return type("Counted", (), {
                "__enter__": lambda s: s, "__exit__": lambda s, *e: file.close(),
                "read": lambda s, n: (read.append(n), take(n))[1],
            })()

    monkeypatch.setattr(packets, "_open", lambda path: (Store(), path))
    assert packets.first_line(str(tmp_path / "big one.pcap.csv")) == "Number,Tot sum"
    assert read == [packets.HEADER_BYTES]


def test_rejected_files_are_in_the_summary(spark, tmp_path):
    write_csvs(tmp_path)
    (tmp_path / "Odd two.pcap.csv").write_text("a,label\n" + "1,x\n" * 9)
    good, bad = packets.convert_files(packets.read_packet_summaries(spark, str(tmp_path)))
    lines = {(r.source_file, r.label, r.rows) for r in convert.conversion_summary(good, bad).collect()}
    assert {("Odd.pcap.csv", None, 0), ("Odd two.pcap.csv", None, 0), (None, None, 8)} < lines and len(lines) == 6


def test_positions_increase_over_blocks(spark, tmp_path):
    """A file cut in many blocks still has one increasing, unique position per row."""
    (tmp_path / "big.pcap.csv").write_text("Number,bytes\n" + "".join(f"{i},{i}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        (frame,) = packets.read_packet_summaries(spark, str(tmp_path))
        rows = frame.select(F.col("Number").cast("int").alias("i"), "row_position").orderBy("row_position").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.i for r in rows] == list(range(20_000))
    assert len({r.row_position for r in rows}) == 20_000


def test_cleaning(spark):
    df = spark.createDataFrame([(" 1.5 ",), ("abc",), ("NaN",), ("inf",), (None,)], "x string")
    assert [r.x for r in clean.clean_features(df, ["x"]).collect()] == [1.5, float("inf")]
    counted = clean.malformed_count(df, ["x"]).first()
    assert (counted.rows, counted.dropped) == (5, 3)
    assert [r.x for r in clean.drop_invalid(clean.to_numeric(df, ["x"])).collect()] == [1.5]
    prepared = clean.prepare_features(clean.to_numeric(df, ["x"]), ["x", "y"]).collect()
    assert [(r.x, r.y) for r in prepared] == [(1.5, 0.0)] + [(0.0, 0.0)] * 4
    with pytest.raises(ValueError, match="y"):
        clean.clean_features(df, ["x", "y"])


def test_column_names_and_choice(spark):
    df = spark.createDataFrame([(1, 2.0, "a", 3, "t")], "` a b ` int, flows double, label string, uniq_src int, note string")
    named = clean.normalize_columns(df)
    assert named.columns == ["a_b", "flows", "label", "uniq_src", "note"]
    assert clean.select_feature_columns(named) == ["a_b", "flows"]
    assert clean.core_columns(named).columns == ["flows", "label"]
    assert set(clean.add_missing_features(named).columns) >= set(FEATURES)
