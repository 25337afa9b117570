"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans: the strict ones of four kinds, and looser candidates (written-out addresses,
national phone numbers, long numbers whose check digit fails, addresses of six-byte groups). Labelers
of three sorts vote on each: regular expressions (layout, validity), gazetteers (top-level domains,
issuers, area codes) and context (words before, neighbouring characters). Expectation-maximisation
over the counts of vote combinations estimates how reliable each labeler is and how likely each
combination is personal data. A naive Bayes classifier over features of the span itself, trained on
those probabilities, gives the final decision together with the votes. Strict spans always stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsight.session import materialize

#: The kinds in their order.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# The strict patterns, written so that they need no backtracking over long runs. A match may begin
# inside a run of its characters only where the last match ended.
STRICT = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole runs of digits with single separators, of the only lengths that can pass
    r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Looser candidates per kind; strict matches that fail their check are candidates too.
LOOSE = (
    r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+(?: ?[(\[]at[)\]] ?| at )[a-z0-9-]{1,63}+"
    r"(?:(?: ?[(\[]dot[)\]] ?| dot |\.)[a-z]{2,24}+){1,4}+",
    r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}+:){7}[0-9a-f]{1,4}+(?![0-9a-f:])",
    None,
    r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
)
#: What a text must hold for a pattern to be tried at all; every match has it.
NEEDS = (r"@[A-Za-z0-9-]", r"[0-9]\.[0-9]++\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){11}", r"\+[0-9]")
LOOSE_NEEDS = (
    r"(?i)(?:[(\[]at[)\]] ?| at )[a-z0-9-]++(?: ?[(\[]dot[)\]]| dot |\.)", r":[0-9A-Fa-f]{1,4}:", None, r"[0-9]\)?[ .-][0-9]{3}[ .-][0-9]{4}"
)

TOP_LEVEL = "com|org|net|edu|gov|int|info|io|dev|app|de|fr|es|it|uk|eu|us|ca|au|jp|nl|ch|at"
CONTEXT = (
    r"(?i)\b(?:e-?mail|mail|contact|write|reach|mailto)\W*$",
    r"(?i)\b(?:ip|host|server|address|ping|from)\W*$",
    r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|pay(?:ment)?|iban)\W*$",
    r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|dial|whatsapp)\W*$",
)
CONTEXT_CHARS = 40
LABELERS = ("layout", "validity", "gazetteer", "context", "edges")
#: Lists are built in blocks of so many entries, since adding to a list copies it.
BLOCK = 256


def blocks(values: Column) -> Column:
    """A list cut into lists of ``BLOCK`` entries."""
    n = F.size(values)
    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    return F.when(n > 0, cut).otherwise(F.slice(F.array(values), 1, 0))


def folded(values: Column, state: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What each entry of a list adds, as a list of type ``out``; ``step`` gives the next state and the addition."""
    none, nothing = F.array().cast(f"array<{out}>"), F.array().cast(f"array<array<{out}>>")

    def within(s: Column, m: Column) -> Column:
        state, added = step(s["state"], m)
        return F.struct(state.alias("state"), F.concat(s["out"], F.array(added)).alias("out"))

    def block(s: Column, some: Column) -> Column:
        start = F.struct(s["last"]["state"].alias("state"), none.alias("out"))
        return F.struct(F.aggregate(some, start, within).alias("last"), F.concat(s["done"], F.array(s["last"]["out"])).alias("done"))

    start = F.struct(F.struct(state.alias("state"), none.alias("out")).alias("last"), nothing.alias("done"))
    return F.aggregate(blocks(values), start, block, lambda s: F.flatten(F.concat(s["done"], F.array(s["last"]["out"]))))


MATCH = "struct<start:int,end:int,value:string,before:string,after:string>"


def found(text: Column, pattern: str, needs: str | None = None) -> Column:
    """Matches from left to right as structs (start, end, value, before, after); positions in code points.

    ``before`` are up to ``CONTEXT_CHARS`` characters before the match, ``after`` is the one behind it.
    """
    parts, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # The matches fill the gaps between the parts: the k-th begins after k + 1 parts and k matches.
    gaps = F.arrays_zip(
        F.slice(parts, F.lit(1), F.size(values)).alias("gap"), values.alias("value"),
        F.slice(parts, F.lit(2), F.size(values)).alias("next"), F.slice(values, F.lit(2), F.size(values)).alias("then"),
    )

    def step(s: Column, m: Column) -> tuple[Column, Column]:
        start = s["at"] + F.length(m["gap"])
        end = start + F.length(m["value"])
        before = F.right(F.concat(s["before"], m["gap"]), F.lit(CONTEXT_CHARS))
        after = F.left(F.concat(F.left(m["next"], F.lit(1)), F.coalesce(F.left(m["then"], F.lit(1)), F.lit(""))), F.lit(1))
        columns = {"start": start, "end": end, "value": m["value"], "before": before, "after": after}
        state = F.struct(end.alias("at"), F.right(F.concat(before, m["value"]), F.lit(CONTEXT_CHARS)).alias("before"))
        return state, F.struct(*[v.alias(c) for c, v in columns.items()])

    placed = folded(gaps, F.struct(F.lit(0).alias("at"), F.lit("").alias("before")), MATCH, step)
    return placed if needs is None else F.when(text.rlike(needs), placed).otherwise(F.array().cast(f"array<{MATCH}>"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a string of digits fits."""
    n = F.length(number)
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    digit = lambda i: F.substr(number, n - i + 1, F.lit(1)).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i))
    )
    return (n > 0) & (total % 10 == 0)


def passes(kind: int, value: Column) -> Column:
    """The check that a strict match of the kind has to pass."""
    if kind == IP:
        plain = F.regexp_replace(value, r"(^|\.)0+(?=[0-9])", "$1")
        return plain.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == CARD:
        return F.length(digits(value)).between(12, 19) & luhn(digits(value))
    if kind == PHONE:
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def _tagged(spans: Column, kind: int, strict: bool) -> Column:
    fields = lambda s: {"start": s["start"], "kind": F.lit(kind), "end": s["end"], "value": s["value"], "strict": F.lit(strict), "before": s["before"], "after": s["after"]}
    return F.transform(spans, lambda s: F.struct(*[v.alias(c) for c, v in fields(s).items()]))


def _checked(spans: Column, kind: int, strict: bool) -> Column:
    """Matches of a strict pattern that pass their check, or those that do not."""
    return _tagged(F.filter(spans, lambda s: passes(kind, s["value"]) if strict else ~passes(kind, s["value"])), kind, strict)


def strict_spans(matches: Sequence[Column]) -> Column:
    """Strict spans of all kinds in order of start, then kind, as structs (start, kind, end, value, strict, before, after)."""
    return F.array_sort(F.concat(*[_checked(m, k, True) for k, m in enumerate(matches)]))


def candidate_spans(text: Column, matches: Sequence[Column], strict: Column) -> Column:
    """Looser candidates that touch no strict span, of all kinds; ``strict`` has the strict ones in blocks."""
    lists = [_checked(matches[k], k, False) for k in (IP, CARD, PHONE)]
    lists += [_tagged(found(text, pattern, LOOSE_NEEDS[k]), k, False) for k, pattern in enumerate(LOOSE) if pattern]
    meet = lambda s, b: (b["start"] < s["end"]) & (s["start"] < b["end"])
    free = lambda s: ~F.exists(strict, lambda block: meet(s, block) & F.exists(block["spans"], lambda b: meet(s, b)))
    return F.array_sort(F.filter(F.concat(*lists), free))


def in_blocks(spans: Column) -> Column:
    """Blocks of spans with the smallest start and the largest end."""
    ends = lambda b: F.array_max(F.transform(b, lambda s: s["end"]))
    return F.transform(blocks(spans), lambda b: F.struct(b.alias("spans"), F.element_at(b, 1)["start"].alias("start"), ends(b).alias("end")))


def per_kind(kind: Column, values: Sequence[Column]) -> Column:
    return reduce(lambda rest, k: F.when(kind == k, values[k]).otherwise(rest), range(2, -1, -1), values[3])


def vote(yes: Column, no: Column) -> Column:
    """1 for, 0 abstains, -1 against."""
    return F.when(yes, 1).when(no, -1).otherwise(0)


def judged(span: Column) -> Column:
    """A span with its votes and features as numbers: (…, votes, features)."""
    kind, value = span["kind"], span["value"]
    start, end = span["start"], span["end"]
    before, after = span["before"], span["after"]
    number = digits(value)
    long_enough = F.length(number)
    never, always = F.lit(False), F.lit(True)
    layout = per_kind(
        kind,
        [
            vote(value.contains("@"), ~value.rlike(r"(?i)[(\[]|\bdot\b")),
            vote(value.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), value.rlike(r"[0-9]{4}")),
            vote(value.rlike(r"^(?:[0-9]{12,19}|(?:[0-9]{4}[ -]){3}[0-9]{4})$"), value.rlike(r" .*-|-.* ")),
            vote(value.rlike(r"^\+?[0-9() .-]*\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"), never),
        ],
    )
    validity = per_kind(
        kind,
        [
            vote(value.rlike(r"[A-Za-z0-9]+(?:@|[)\] ] ?)[A-Za-z0-9-]+\W"), never),
            vote(passes(IP, value) | value.contains(":"), always),
            vote(passes(CARD, value), always),
            vote(long_enough.between(9, 15), always),
        ],
    )
    gazetteer = per_kind(
        kind,
        [
            vote(value.rlike(rf"(?i)\W(?:{TOP_LEVEL})$"), always),
            vote(value.rlike(r"^(?:10|127|192|172|169)\."), value.rlike(r"^0|\.255$")),
            vote(number.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"), number.rlike(r"^[0789]")),
            vote(number.rlike(r"^1?[2-9][0-9]{2}[2-9]"), number.rlike(r"^1?[01][0-9]")),
        ],
    )
    context = per_kind(kind, [vote(before.rlike(CONTEXT[k]), never) for k in range(4)])
    edges = vote(~before.rlike(r"[\w.-]$") & ~after.rlike(r"[\w-]"), before.rlike(r"\w$") | after.rlike(r"\w"))
    votes = [layout, validity, gazetteer, context, edges]
    code = reduce(lambda c, v: c * 3 + v + 1, votes, F.lit(0))
    length = F.least(F.floor(F.length(value) / 4), F.lit(7)).cast("int")
    separator = F.when(value.contains("-"), 3).when(value.contains("."), 2).when(value.contains(" "), 1).otherwise(0)
    border = F.when(before == "", 0).when(before.rlike(r"\s$"), 1).otherwise(2)
    return F.struct(
        start.alias("start"), kind.alias("kind"), end.alias("end"), value.alias("value"), span["strict"].alias("strict"),
        code.alias("votes"), (length * 12 + separator * 3 + border).alias("features"),
    )


def with_spans(df: DataFrame, column: str) -> DataFrame:
    """Adds ``_strict`` and ``_judged``, the strict spans and all spans with votes and features."""
    text = F.coalesce(F.col(column), F.lit(""))
    own = [c for c in df.columns if c not in ("_strict", "_judged")]
    names = [f"_strict_{k}" for k in range(4)]
    df = df.select(*[F.col(f"`{c}`") for c in own], *[found(text, STRICT[k], NEEDS[k]).alias(c) for k, c in enumerate(names)])
    matches = [F.col(c) for c in names]
    df = df.withColumn("_strict", strict_spans(matches))
    df = df.withColumn("_strict_blocks", in_blocks(F.col("_strict")))
    spans = F.concat("_strict", candidate_spans(text, matches, F.col("_strict_blocks")))
    return df.select(*[F.col(f"`{c}`") for c in own], "_strict", F.transform(spans, judged).alias("_judged"))


@dataclass
class SpanModel:
    """Log-odds: per kind a prior, per labeler and vote, and per span feature value."""

    prior: list[float]
    votes: list[list[list[float]]]
    features: list[list[list[float]]]
    reliability: dict[tuple[str, str], float] = field(default_factory=dict)


#: Values of the three span features: length, separator, character before.
FEATURE_SIZES = (8, 4, 3)


def _votes(code: int) -> list[int]:
    out = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        out.append(v)
    return out[::-1]


def _features(code: int) -> list[int]:
    return [code // 12, code // 3 % 4, code % 3]


def estimate(counts: Sequence[tuple[int, int, int, int]], rounds: int = 60) -> SpanModel:
    """EM over (kind, votes, features, n): labelers vote independently given the truth, per kind."""
    model = SpanModel([], [], [])
    for kind in range(4):
        rows = [(_votes(v), _features(f), n) for k, v, f, n in counts if k == kind]
        # start from the majority, then alternate
        truth = [min(max(0.5 + 0.2 * sum(x - 1 for x in votes), 0.05), 0.95) for votes, _, _ in rows]
        prior, odds = 0.0, [[0.0] * 3 for _ in LABELERS]
        rates: list[list[list[float]]] = []
        for _ in range(rounds if rows else 0):
            yes = sum(p * n for p, (_, _, n) in zip(truth, rows, strict=True))
            no = sum((1 - p) * n for p, (_, _, n) in zip(truth, rows, strict=True))
            prior = math.log((yes + 1) / (no + 1))
            rates = []
            for j in range(len(LABELERS)):
                table = [[1.0] * 3, [1.0] * 3]
                for p, (votes, _, n) in zip(truth, rows, strict=True):
                    table[1][votes[j]] += p * n
                    table[0][votes[j]] += (1 - p) * n
                rates.append([[x / sum(row) for x in row] for row in table])
                odds[j] = [math.log(a / b) for a, b in zip(rates[j][1], rates[j][0], strict=True)]
            truth = [
                1 / (1 + math.exp(-max(-30.0, min(30.0, prior + sum(odds[j][v] for j, v in enumerate(votes))))))
                for votes, _, _ in rows
            ]
        model.prior.append(prior)
        model.votes.append(odds)
        for name, table in zip(LABELERS, rates, strict=False):
            model.reliability[KINDS[kind], name] = table[1][2] / (table[1][2] + table[1][0])
        features = []
        for j, size in enumerate(FEATURE_SIZES):
            table = [[1.0] * size, [1.0] * size]
            for p, (_, own, n) in zip(truth, rows, strict=True):
                table[1][own[j]] += p * n
                table[0][own[j]] += (1 - p) * n
            total = sum(table[1]), sum(table[0])
            features.append([math.log(a / total[0] * total[1] / b) for a, b in zip(*table[::-1], strict=True)])
        model.features.append(features)
    return model


def fit(df: DataFrame, column: str = "text") -> SpanModel:
    """Learns from the spans of all texts.

    The driver gets one count per kind, vote combination and feature combination: at most
    4 * 3**5 * 96 rows, whatever the corpus holds.
    """
    return fit_spans(with_spans(df.select(column), column))


def fit_spans(judged: DataFrame) -> SpanModel:
    """Learns from the spans of ``with_spans``."""
    spans = judged.select(F.explode("_judged").alias("s"))
    return estimate([tuple(r) for r in spans.groupBy("s.kind", "s.votes", "s.features").count().collect()])


def score(span: Column, model: SpanModel) -> Column:
    """The probability that a judged span is personal data."""

    def table(values: list, at: Column) -> Column:
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), at.cast("int") + 1)

    def of_kind(kind: int) -> Column:
        total = F.lit(model.prior[kind])
        for j, odds in enumerate(model.votes[kind]):
            total = total + table(odds, F.floor(span["votes"] / 3 ** (len(LABELERS) - 1 - j)) % 3)
        places = (F.floor(span["features"] / 12), F.floor(span["features"] / 3) % 4, span["features"] % 3)
        for odds, at in zip(model.features[kind], places, strict=True):
            total = total + table(odds, at)
        return total

    return 1 / (1 + F.exp(-per_kind(span["kind"], [of_kind(k) for k in range(4)])))


def find(df: DataFrame, model: SpanModel | None = None, column: str = "text", threshold: float = 0.5) -> DataFrame:
    """Adds ``strict`` and ``spans``: lists of (start, kind, end, value), positions in code points.

    ``spans`` holds the strict ones and the candidates of at least ``threshold``, by start, then
    kind; without a ``model`` one is fitted on ``df``. A null or empty text has empty lists; columns
    named like the added ones are replaced. Rows stay in their partitions and are not compared, so
    repeated rows get equal spans; texts of any length are read whole. An empty table gives an empty
    one, and a model that judges by its starting values. Where a model is fitted, texts and spans are
    written once, so that patterns run once.
    """
    df = with_spans(df.drop("strict", "spans"), column)
    if model is None:
        df = materialize(df, "spans")
        model = fit_spans(df)
    kept = F.filter("_judged", lambda s: s["strict"] | (score(s, model) >= threshold))

    def plain(spans: Column) -> Column:
        return F.array_sort(
            F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "kind", "end", "value")]))
        )

    return df.select(
        *[c for c in df.columns if not c.startswith(("_strict", "_judged"))],
        plain(F.col("_strict")).alias("strict"),
        plain(kept).alias("spans"),
    )


def listing(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in square brackets; touching spans become one."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.coalesce(text, F.lit(""))
    state = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, m: F.when(
            m["start"] >= s["at"],
            F.struct(
                m["end"].alias("at"),
                F.concat(
                    s["out"], F.substr(text, s["at"] + 1, m["start"] - s["at"]), F.element_at(names, m["kind"] + 1)
                ).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(s["at"], m["end"]).alias("at"), s["out"].alias("out"))),
    )
    return F.concat(state["out"], F.substr(text, state["at"] + 1, F.length(text)))
