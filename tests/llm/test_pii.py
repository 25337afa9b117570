"""Personal data against a plain-loop version of the contract."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from flowsight.llm import pii
from flowsight.llm.queries import QUERIES

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(number):
    total = 0
    for i, d in enumerate(reversed(number)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    out = []
    for kind, (name, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": name != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[name]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def texts():
    rng = random.Random(3)
    parts = ["a@b.co", "a@b.co_x@d.e", "é", "🙂", " ", "-", ".", "+1 (269) 555-3296", "4539578763621486", "4539 5787 6362 1486",
             "1.2.3.4", "001.255.256.1", "1.2.3.4.5.6.7.8", "0", "12345", "+", "+49 30 1234567", "(", ")", "x at y dot com", "@", "\n",
             "269 555-3296", "20010db8:1:2:3:4:5:6:7", "a:b:c:d:1:2:3:4", "card 4539578763621487", "%", "00000000000000", "7 "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(600)] + [
        "", "1" * 30_000, "a" * 30_000, "1 " * 10_000, "1." * 10_000, "+1" + " " * 20_000, "+1 (" * 5_000,
        "x@" * 5_000, "a@b" + ".c" * 10_000, "1-" * 9 + "3",
    ]


def test_strict_spans_match_plain_loops(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = {r.doc_id: [(s.start, s.kind, s.end) for s in r.strict] for r in pii.find(df).collect()}
    for i, text in rows:
        assert found[i] == base(text), text[:200]


def test_all_spans_hold_the_strict_ones_and_redact(spark):
    rows = [*enumerate(texts()[:300]), (1000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))
    out = pii.find(df)
    assert sorted(out.columns) == ["doc_id", "spans", "strict", "text"]
    for r in out.withColumn("clean", pii.redacted(F.col("text"), F.col("spans"))).collect():
        assert {tuple(s) for s in r.strict} <= {tuple(s) for s in r.spans}
        assert all((r.text or "")[s.start : s.end] == s.value for s in r.spans)
        cover, clean, at = [s for s in r.spans], "", 0
        for s in cover:
            if s.start >= at:
                clean += (r.text or "")[at : s.start] + f"[{pii.KINDS[s.kind].upper()}]"
            at = max(at, s.end)
        assert r.clean == clean + (r.text or "")[at:]


def test_looser_candidates_keep_their_kind(spark):
    """Their kind was their place in the text, and the sixth one's name was not found."""
    texts = ["call 269 555-3296 " * 6, "joe at site dot com, ann at site dot com", "ip 2001:db8:1:2:3:4:5:6 or 2001:db8:1:2:3:4:5:7", "tel (269) 555-3296"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.find(df, pii.estimate([])).withColumn("listing", pii.listing(F.col("spans"))).withColumn("clean", pii.redacted(F.col("text"), F.col("spans"))).collect()
    kinds = {r.doc_id: [s.kind for s in r.spans] for r in rows}
    assert kinds == {0: [pii.PHONE] * 6, 1: [pii.EMAIL] * 2, 2: [pii.IP] * 2, 3: [pii.PHONE]}
    assert {r.doc_id: r.listing for r in rows}[1] == "email:0:19,email:21:40"
    assert {r.doc_id: r.clean for r in rows}[0] == "call [PHONE] " * 6


def test_many_spans_of_one_text_and_what_stands_around_them(spark):
    text = "".join(f"{i:04d} é mail a{i}@b.co" + "," * (i % 3) for i in range(1000))
    got = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = got.select(F.explode(pii.found(F.col("text"), pii.STRICT[pii.EMAIL], pii.NEEDS[pii.EMAIL])).alias("m")).select("m.*").collect()
    wanted = [(m.start(), m.end(), m[0], text[max(m.start() - pii.CONTEXT_CHARS, 0) : m.start()], text[m.end() : m.end() + 1]) for m in re.finditer(BASE[0][1], text)]
    assert len(wanted) > 3 * pii.BLOCK
    assert [tuple(r) for r in got] == wanted


def test_reliable_labelers_win(spark):
    model = pii.estimate([(2, 242, 0, 100), (2, 0, 0, 100), (2, 2 * 81 + 0 * 27 + 9 + 3 + 1, 0, 10)])
    assert model.reliability["card", "validity"] > 0.5
    assert len(pii.estimate([]).prior) == 4


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "")], [(None, "a@b.co"), (None, "a@b.co")]])
def test_edge_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = pii.find(df).collect()
    assert len(out) == len(rows)
    assert all(len(r.strict) == (r.text == "a@b.co") for r in out)


def test_query(spark, sf_dir):
    wanted = {}
    for i, text in duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall():
        spans = base(text or "")
        listing = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        wanted[i] = (*[sum(k == j for _, k, _ in spans) for j in range(4)], hashlib.sha256(listing.encode()).hexdigest())
    found = {r[0]: tuple(r)[1:6] for r in QUERIES["op4_personal_data"](spark, sf_dir).collect()}
    assert found == wanted


def test_no_python_in_the_plan(spark, sf_dir, plan_of):
    plan = plan_of(QUERIES["op4_personal_data"](spark, sf_dir))
    assert not re.search("Python|Pandas|Arrow", plan)
