"""License scans against plain loops over rules and intervals."""

import random
import re
import re._parser as parser

from pyspark.sql import functions as F

from flowsight.llm import license_scan
from flowsight.llm.license_rules import CONFIDENCE, GATES, RULES, Rule
from flowsight.llm.queries import QUERIES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    own = words(text)
    places = [(i, label) for i in range(len(own)) for phrase, label in BASE.items() if tuple(own[i : i + len(phrase)]) == phrase]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(own), len(places), min(starts, default=None), max(starts, default=None), labels


def detected(text, rules):
    """Every rule tried on every text, every interval compared with every other."""
    joined = " " + " ".join(words(text)) + " "
    found = []
    for n, r in enumerate(rules):
        for m in re.finditer(license_scan.bordered(r.pattern), joined):
            start = joined[: m.start()].count(" ") - 1
            found.append((start, start + m[0].count(" ") + 1, r.level, n))
    found.sort(key=lambda d: (d[0], -d[1], d[2], d[3]))

    def suppressed(i):
        start, end, level, _ = found[i]
        return any(
            s <= start and e >= end and (lv < level or lv == level and ((s, e) != (start, end) or j < i))
            for j, (s, e, lv, _) in enumerate(found)
            if j != i
        )

    return [d for i, d in enumerate(found) if not suppressed(i)]


def expected(text, rules=RULES, confidence=CONFIDENCE):
    left = detected(text, rules)
    *counts, labels = base(text)
    both = {rules[d[3]].label for d in left} | set(filter(None, labels.split(",")))
    score = max((confidence[d[2]] for d in left), default=0.0)
    return (*counts, labels, ",".join(sorted(both)), score, [(s, e, rules[n].label) for s, e, _, n in left])


def sample(tree, rng):
    """A string that a rule's pattern matches."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "SUBPATTERN":
            out += sample(arg[3], rng)
        elif name == "BRANCH":
            out += sample(rng.choice(arg[1]), rng)
        elif name == "MAX_REPEAT":
            out += "".join(sample(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
        elif name == "IN":
            kind, value = arg[0]
            out += chr(value) if str(kind) == "LITERAL" else chr(value[0]) if str(kind) == "RANGE" else "q"
        else:
            assert name == "ASSERT_NOT", name
    return out


def texts(seed, n):
    rng = random.Random(seed)
    parts = ["the", "MIT License.", "Apache License", "GENERAL PUBLIC LICENSE", "mit", "license", "permit license", "é", "Äpache license",
             "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "version 2.0", "CC BY-NC 4.0", "GNU",
             "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "\n", "KELVIN Key İ",
             "All rights reserved", "public domain", "general public mit license license"]
    for _ in range(n):
        own = [sample(parser.parse(rng.choice(RULES).pattern), rng) if rng.random() < 0.4 else rng.choice(parts) for _ in range(rng.randint(0, 12))]
        yield rng.choice([" ", "-", ", "]).join(own)


def scanned(spark, rows, **kw):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(8)
    found = license_scan.scan(df, **kw).withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "license_score"]
    return {r.doc_id: (*(r[c] for c in columns), [tuple(x) for x in r.licenses]) for r in found.collect()}


def test_every_match_holds_its_keyword():
    assert len(RULES) >= 290 and len({r.pattern for r in RULES}) > 280
    rng = random.Random(5)
    for rule in RULES:
        assert rule.pattern.count("(?:") == rule.pattern.count("(") - rule.pattern.count("(?!")
        for _ in range(50):
            text = sample(parser.parse(rule.pattern), rng)
            assert rule.keyword in text and license_scan.gate(rule.keyword) in text
    assert len({license_scan.gate(r.keyword) for r in RULES}) < 70 and len(GATES) == len(set(GATES))


def test_equals_plain_loops(spark):
    rows = list(texts(1, 400))
    got = scanned(spark, rows)
    for i, text in enumerate(rows):
        assert got[i] == expected(text), text


def test_rules_and_levels_of_ones_own(spark):
    rules = [Rule("long", "a b", "a b c d", 0), Rule("weak", "c", "c", 1), Rule("wide", "b", "a b c d e", 1), Rule("same", "a b", "a b", 0), Rule("late", "e", "d e", 1)]
    rows = ["a b c d e", "a b c", "c a b c d e c", "", None, "a b a b a b"] + ["a b c d e " * 700]
    got = scanned(spark, rows, rules=rules, confidence=[0.9, 0.5])
    for i, text in enumerate(rows):
        assert got[i] == expected(text, rules, [0.9, 0.5]), text


def test_awkward_tables(spark):
    assert scanned(spark, []) == {}
    rows = ["mit license " * 3000, "x" * 300_000, "- " * 100_000, " \t\n", "MIT LICENSE", None, "mit license"]
    got = scanned(spark, rows)
    for i, text in enumerate(rows):
        assert got[i][:5] == base(text)
    assert got[0][5:7] == ("mit", 0.7) and len(got[0][7]) == 3000
    df = spark.createDataFrame([("MIT License", 5, "z", 1.0)], "text string, n_words int, labels string, `a.b` double")
    row = license_scan.scan(df).first()
    assert row.n_words == 2 and row.labels == ["mit"] and row["a.b"] == 1.0


def test_query_equals_plain_loops(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:8] for r in QUERIES["op11_license_scan"](spark, sf_dir).collect()}
    assert got == {r.doc_id: expected(r.text)[:7] for r in rows}


def test_no_python_in_the_plan(spark, sf_dir, plan_of):
    assert "Python" not in plan_of(QUERIES["op11_license_scan"](spark, sf_dir))
    assert "Arrow" not in plan_of(QUERIES["op11_license_scan"](spark, sf_dir))
