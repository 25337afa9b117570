"""License scans by ordered signature rules, in DataFrame functions only.

A text is read as words in lower case. About 300 patterns (``license_rules``) stand in order of
priority: sentences of license texts, identifiers, notices, names with a version, addresses, names,
general mentions. A rule is tried only where its keyword is found, and keywords that share a part
only where that part is found, so most texts meet a few dozen plain searches and no pattern at all.
Detections are intervals of words. One is suppressed if it lies inside an interval of a rule of a
stronger level, or inside a longer one of its own level (of equal ones the earlier rule's stays).

Base phrases are found apart from the rules and always stay.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsight.llm.license_rules import CONFIDENCE, GATES, RULES, Rule

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: What separates words, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Items that a running fold appends to one list before it starts the next.
FOLD = 256


def worded(text: Column) -> Column:
    """The words with a space before, between and after them; one space if there are none.

    ``lower`` changes letters beyond A-Z too. They are parts of words all the same, and none of them
    becomes a letter of a base phrase: the only two with an ASCII lower case are the Kelvin sign (k)
    and the dotted capital I, which keeps its dot as a character of its own.
    """
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BETWEEN, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def bordered(pattern: str) -> str:
    return rf"(?<= )(?:{pattern})(?= )"


def running(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What ``step(state, item) -> (state, out)`` gives for every item, in order.

    A list that grows by one item is copied each time, so results go to lists of ``FOLD`` items.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(s: Column, item: Column) -> Column:
        new, out = step(s["state"], item)
        return F.struct(new.alias("state"), F.concat(s["out"], F.array(out)).alias("out"))

    def block(s: Column, start: Column) -> Column:
        inside = F.aggregate(F.slice(items, start, F.lit(FOLD)), F.struct(s["state"].alias("state"), none.alias("out")), one)
        # one fold, unpacked by a list of one, so that it is worked out once
        return F.transform(
            F.array(inside), lambda r: F.struct(r["state"].alias("state"), F.concat(s["out"], F.array(r["out"])).alias("out"))
        )[0]

    lists = F.array().cast(f"array<array<{kind}>>")
    starts = F.sequence(F.lit(1), F.size(items), F.lit(FOLD))
    folded = F.aggregate(starts, F.struct(state.alias("state"), lists.alias("out")), block, lambda s: F.flatten(s["out"]))
    return F.when(F.size(items) > 0, folded).otherwise(none)


INTERVAL = "struct<start:int,end:int,level:int,rule:int>"


def matches(text: Column, pattern: Column, level: Column, rule: Column) -> Column:
    """A pattern's matches as intervals of words (start, end, level, rule), end exclusive."""
    values = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values))
    pieces = F.transform(
        F.arrays_zip(gaps.alias("gap"), values.alias("value")),
        lambda p: F.struct(spaces(p["gap"]).alias("gap"), spaces(p["value"]).alias("value")),
    )

    def step(at: Column, p: Column) -> tuple[Column, Column]:
        # ``at`` counts the spaces so far; the one before a word makes its number
        start = at + p["gap"] - 1
        out = F.struct(start.alias("start"), (start + p["value"] + 1).alias("end"), level.alias("level"), rule.alias("rule"))
        return at + p["gap"] + p["value"], out

    return running(pieces, F.lit(0), step, INTERVAL)


def gate(keyword: str) -> str:
    return next((g for g in GATES if g in keyword), keyword)


def _table(rules: Sequence[Rule]) -> Column:
    """The rules as one constant: gates, in them keywords, in them (pattern, level, rule)."""
    numbered = sorted(enumerate(rules), key=lambda r: (gate(r[1].keyword), r[1].keyword, r[0]))
    gates = []
    for name, own in groupby(numbered, key=lambda r: gate(r[1].keyword)):
        keywords = []
        for keyword, same in groupby(own, key=lambda r: r[1].keyword):
            found = [
                F.struct(F.lit(bordered(r.pattern)).alias("pattern"), F.lit(r.level).alias("level"), F.lit(i).alias("rule"))
                for i, r in same
            ]
            keywords.append(F.struct(F.lit(keyword).alias("keyword"), F.array(*found).alias("rules")))
        gates.append(F.struct(F.lit(name).alias("gate"), F.array(*keywords).alias("keywords")))
    return F.array(*gates)


def detections(text: Column, rules: Sequence[Rule]) -> Column:
    """All matches of the rules whose keyword the text holds, by start, longest first, then rule."""
    gates = F.filter(_table(rules), lambda g: F.contains(text, g["gate"]))
    keywords = F.filter(F.flatten(F.transform(gates, lambda g: g["keywords"])), lambda k: F.contains(text, k["keyword"]))
    tried = F.flatten(F.transform(keywords, lambda k: k["rules"]))
    found = F.flatten(F.transform(tried, lambda r: matches(text, r["pattern"], r["level"], r["rule"])))
    ordered = F.array_sort(
        F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("end"), d["level"].alias("level"), d["rule"].alias("rule")))
    )
    return F.transform(
        ordered, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("end"), d["level"].alias("level"), d["rule"].alias("rule"))
    )


def unsuppressed(found: Column, levels: int) -> Column:
    """The intervals that no earlier one of their level or a stronger one contains.

    Sorted by start and falling end, an interval is contained if an earlier one ends no sooner, so
    the furthest end so far per level (stronger ones included) is all that has to be carried.
    """

    def step(ends: Column, d: Column) -> tuple[Column, Column]:
        new = F.transform(ends, lambda e, i: F.when(i >= d["level"], F.greatest(e, d["end"])).otherwise(e))
        return new, F.struct(d.alias("found"), (F.element_at(ends, d["level"] + 1) < d["end"]).alias("stays"))

    start = F.array_repeat(F.lit(-1), levels)
    marked = running(found, start, step, f"struct<found:{INTERVAL},stays:boolean>")
    return F.transform(F.filter(marked, lambda m: m["stays"]), lambda m: m["found"])


def scan(df: DataFrame, column: str = "text", rules: Sequence[Rule] = RULES, confidence: Sequence[float] = CONFIDENCE) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, license_score, licenses.

    Base columns count the places of the base phrases; ``licenses`` lists the detections that stay as
    (start, end, label), in words; ``labels`` are theirs and the base's; the score is the highest
    confidence of a detection, 0 without any. A null text is empty; an empty text has no words and
    no labels. Rows stay where they are and are not compared with each other, so repeated rows get
    equal results; texts of any length are read whole. Columns named like the added ones are replaced.
    """
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "license_score", "licenses"]
    df = df.drop(*added).withColumn("_words", worded(F.col(column)))
    text = F.col("_words")
    phrase = bordered("|".join(PHRASES))
    maybe = F.contains(text, F.lit(" license "))
    df = df.withColumn("_base", F.when(maybe, F.regexp_extract_all(text, F.lit(phrase), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_gaps", F.when(F.size("_base") > 0, F.split(text, phrase, -1)))
    df = df.withColumn("_found", unsuppressed(detections(text, rules), len(confidence)))
    labels, weights = F.array(*[F.lit(r.label) for r in rules]), F.array(*[F.lit(float(c)) for c in confidence])
    names = F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair])
    base = F.transform(F.array_distinct("_base"), lambda p: F.element_at(names, p))
    own = F.transform("_found", lambda d: F.element_at(labels, d["rule"] + 1))
    n_words = F.greatest(spaces(text) - 1, F.lit(0))
    after = spaces(F.element_at("_gaps", -1)) - 1
    last = n_words - after - spaces(F.element_at("_base", -1)) - 1
    kept = [c for c in df.columns if c not in ("_words", "_base", "_gaps", "_found")]
    return df.select(
        *[F.col(f"`{c}`") for c in kept],
        n_words.cast("long").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.when(F.size("_base") > 0, spaces(F.element_at("_gaps", 1)) - 1).cast("long").alias("first_word"),
        F.when(F.size("_base") > 0, last).cast("long").alias("last_word"),
        F.array_sort(base).alias("base_labels"),
        F.array_sort(F.array_distinct(F.concat(base, own))).alias("labels"),
        F.coalesce(F.array_max(F.transform("_found", lambda d: F.element_at(weights, d["level"] + 1))), F.lit(0.0)).alias("license_score"),
        F.transform(
            "_found",
            lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), F.element_at(labels, d["rule"] + 1).alias("label")),
        ).alias("licenses"),
    )
