"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a classifier decides.

1. Candidates. Regular expressions mark possible spans of seven kinds in every
   whole text. Four kinds are the base (email, ip, card, phone): their valid
   matches are always kept. The others (local phone numbers, secrets after a
   keyword, names after a title) and invalid base matches are only candidates.
2. Votes. Five labelers say yes, no or nothing to each candidate: validity by
   rule, gazetteers (domains, number prefixes, first names, ...), the words in
   front, the shape, and the characters at the edges.
3. Estimation. What is gathered from the corpus is the number of candidates of
   each vote pattern (kind x 3^5 x length class at most), over all documents.
   Expectation-maximisation on this table gives each labeler's reliability and
   each pattern's probability; a logistic span classifier on kind, votes and
   length is trained on those probabilities.
4. Decision. The classifier's weights are literals of one expression; added
   spans are candidates over one half.

All of it over rows is DataFrame functions. A pattern's matches are put between
two marks of a private-use character and the text split there, which gives all
positions in one pass; patterns are written so that a match begins at the start
of its run and never backtracks over it. Nothing but the pattern counts is
shuffled.

Defined cases: a null text is the empty text; without any candidate nothing is
learned and nothing added; repeated rows count as often as they occur; a text
with the marking character is searched with that character exchanged for
another; extra columns are passed over; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.common import reliable, table

MARK, OTHER = "\ue000", "\ue001"

BASE = ["email", "ip", "card", "phone"]
ADDED = ["phone_local", "secret", "person"]
KINDS = [*BASE, *ADDED]

#: What marks each kind: a pattern, and the replacement that puts its span between marks.
#: A local part starts where its run starts, or right behind another address; digits where their run starts.
PATTERNS: dict[str, tuple[str, str]] = {
    "email": (
        r"(?:(?<![A-Za-z0-9._%+-])|(?<=[A-Za-z0-9-])(?=[._%+]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        f"{MARK}$0{MARK}",
    ),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", f"{MARK}$0{MARK}"),
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", f"{MARK}$0{MARK}"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", f"{MARK}$0{MARK}"),
    "phone_local": (r"(?<![0-9+(-])(?<![0-9] )\([0-9]{3}\) ?[0-9]{3}[ -][0-9]{4}(?![0-9])", f"{MARK}$0{MARK}"),
    "secret": (
        r"((?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key) {0,3}[=:] {0,3}[\"']?)([A-Za-z0-9_+/=.-]{12,}+)",
        f"$1{MARK}$2{MARK}",
    ),
    "person": (r"((?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.? )([A-Z][a-z]++(?: [A-Z][a-z]++)?+)", f"$1{MARK}$2{MARK}"),
}
#: A character or word that a text with the kind must hold: a cheap test before the pattern.
NEEDS: dict[str, str] = {"email": "@", "ip": ".", "phone": "+", "phone_local": "("}

#: Gazetteers, as patterns over the span.
GAZETTEER: dict[str, str] = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|io|info|de|fr|es|it|uk|eu|ch|at|nl|be|us|ca)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+(?:1|7|20|27|3[0-4]|36|39|4[0-9]|5[1-8]|6[0-6]|8[1-6]|9[0-8])",
    "phone_local": r"^\([2-9]",
    "secret": r"^(?:[0-9a-f]+|[0-9A-F]+|sk-.*|ghp_.*|AKIA.*)$",
    "person": r"^(?:Alice|Anna|Bob|Carlos|Claire|David|Elena|Emma|Hans|Jane|John|Jose|Juan|Julia|Klaus|Laura|Marie|Mark|Mary|Michael|Paul|Peter|Pierre|Sarah|Thomas)(?: |$)",
}
#: Words in front of a span that speak for its kind.
CONTEXT: dict[str, str] = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach)[^\n]{0,20}$",
    "ip": r"(?i)(?:\bip\b|address|host|server|from|login)[^\n]{0,20}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|payment)[^\n]{0,20}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|contact)[^\n]{0,20}$",
    "phone_local": r"(?i)(?:phone|tel|call|mobile|fax|contact)[^\n]{0,20}$",
    "secret": r"(?i)(?:token|secret|key|auth|bearer)[^\n]{0,20}$",
    "person": r"(?i)(?:name|contact|by|from|with|dear)[^\n]{0,20}$",
}
#: Words in front that speak against any kind.
AGAINST = r"(?i)(?:version|release|isbn|issn|order no|item no|serial|section|figure|table)[^\n]{0,6}$"
SHAPE: dict[str, str] = {
    "email": r"^.{6,64}$",
    "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^(?:[0-9]{15,16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})$",
    "phone": r"[ ().-]",
    "phone_local": r"-",
    "secret": r"^.{20,}$",
    "person": r" ",
}
CONTEXT_CHARS = 40
LABELERS = ["valid", "gazetteer", "context", "shape", "edges"]
#: Upper ends of the length classes.
LENGTHS = [12, 16, 20, 32]

_SPAN = "array<struct<a:int,b:int,value:string,before:string,after:string>>"
#: Values of one chunk of a running sum, and characters of one block of a text that is rewritten.
CHUNK, BLOCK = 64, 4096


def searchable(text: Column) -> Column:
    """The text without the marking character; positions stay."""
    return F.coalesce(F.when(text.contains(MARK), F.translate(text, MARK, OTHER)).otherwise(text), F.lit(""))


def running(values: Column, kind: str, merge: Callable[[Column, Column], Column]) -> Column:
    """What ``merge`` makes of all values before each place of an array, from 0 on.

    In two levels of ``CHUNK``: an array that grows by one is copied at each step, so one
    level would take time in the square of a text's matches.
    """
    n = F.size(values)

    def step(acc: Column, x: Column) -> Column:
        return F.struct(merge(acc["now"], x).alias("now"), F.concat(acc["before"], F.array(acc["now"])).alias("before"))

    def scan(part: Column, start: Column) -> Column:
        first = F.struct(start.cast(kind).alias("now"), F.array().cast(f"array<{kind}>").alias("before"))
        return F.aggregate(part, first, step, lambda acc: acc["before"])

    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda j: F.slice(values, j * CHUNK + 1, CHUNK))
    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast(kind), merge))
    both = F.zip_with(chunks, scan(totals, F.lit(0)), lambda c, start: scan(c, start))
    return F.when(n > 0, F.flatten(both)).otherwise(F.array().cast(f"array<{kind}>"))


def marked_spans(text: Column, kind: str) -> Column:
    """Spans (a, b) of a kind's pattern: code points, end exclusive; with their text and what is around it.

    The replacement puts marks around each span, so every other piece between marks is one. All
    parts come from these pieces; the text is not walked again for each.
    """
    pattern, replacement = PATTERNS[kind]
    pieces = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(replacement)), MARK, -1)

    def spans(p: Column) -> Column:
        sizes = p["sizes"]

        def span(i: Column) -> Column:
            # an even number of pieces holds as many characters as half of it, since no span is empty
            first = F.greatest(i - 2 * CONTEXT_CHARS, F.lit(0))
            before = F.right(F.array_join(F.slice(p["tails"], first + 1, i - first), ""), F.lit(CONTEXT_CHARS))
            after = F.left(F.array_join(F.slice(p["heads"], i + 2, F.lit(2)), ""), F.lit(1))
            at = F.get(p["starts"], i)
            return F.struct(at.alias("a"), (at + F.get(sizes, i)).alias("b"), F.get(p["pieces"], i).alias("value"), before.alias("before"), after.alias("after"))

        return F.transform(F.sequence(F.lit(1), F.size(sizes) - 2, F.lit(2)), span)

    parts = F.struct(pieces.alias("pieces"))
    named = _let(parts, lambda p: F.struct(
        p["pieces"].alias("pieces"), F.transform(p["pieces"], F.length).alias("sizes"),
        F.transform(p["pieces"], lambda x: F.right(x, F.lit(CONTEXT_CHARS))).alias("tails"), F.transform(p["pieces"], lambda x: F.left(x, F.lit(1))).alias("heads")))
    placed = _let(named, lambda p: F.struct(p["pieces"].alias("pieces"), p["sizes"].alias("sizes"), p["tails"].alias("tails"), p["heads"].alias("heads"),
                                            running(p["sizes"], "int", lambda x, y: x + y).alias("starts")))
    found = _let(placed, lambda p: F.when(F.size(p["sizes"]) > 2, spans(p)).otherwise(F.array().cast(_SPAN)))
    test = text.rlike(pattern)
    if kind in NEEDS:
        test = text.contains(NEEDS[kind]) & test
    return F.when(test, found).otherwise(F.array().cast(_SPAN))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The rule that a match of the kind must pass."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return luhn(F.regexp_replace(value, "[ -]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out.when(no, -1) if no is not None else out).otherwise(0)


def candidate(kind: str, span: Column) -> Column:
    """A span with the labelers' votes and its length class."""
    value, before, after = span["value"], span["before"], span["after"]
    ok = valid(kind, value)
    size = span["b"] - span["a"]
    length = sum((size > x).cast("int") for x in LENGTHS)
    joined = before.rlike("[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]")
    return F.struct(
        F.lit(kind).alias("kind"),
        span["a"].alias("a"),
        span["b"].alias("b"),
        (F.lit(kind in BASE) & ok).alias("base"),
        _vote(ok, ~ok).alias("valid"),
        _vote(value.rlike(GAZETTEER[kind])).alias("gazetteer"),
        _vote(before.rlike(CONTEXT[kind]), before.rlike(AGAINST)).alias("context"),
        _vote(value.rlike(SHAPE[kind]), F.lit(True)).alias("shape"),
        _vote(~joined, joined).alias("edges"),
        length.alias("length"),
    )


def with_candidates(docs: DataFrame, text_col: str, name: str = "candidates") -> DataFrame:
    """``docs`` with an array of all candidates, by kind and then position."""
    taken = set(docs.columns)

    def free(base: str) -> str:
        """A column name that ``docs`` doesn't have."""
        while base in taken:
            base = "_" + base
        taken.add(base)
        return base

    whole = free("__text")
    spans = {k: free(f"__{k}") for k in KINDS}
    out = docs.withColumn(whole, searchable(F.col(text_col)))
    out = out.select("*", *[marked_spans(F.col(whole), k).alias(c) for k, c in spans.items()])
    found = [F.transform(F.col(c), partial(candidate, k)) for k, c in spans.items()]
    none = F.lit(True)
    for c in spans.values():
        none = none & (F.size(c) == 0)
    kind = "array<struct<kind:string,a:int,b:int,base:boolean,valid:int,gazetteer:int,context:int,shape:int,edges:int,length:int>>"
    out = out.withColumn(name, F.when(none, F.array().cast(kind)).otherwise(F.concat(*found).cast(kind)))
    return out.drop(whole, *spans.values())


@dataclass
class SpanModel:
    """Estimated reliabilities, and the classifier's weights by feature."""

    reliability: dict[str, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)

    def probability(self, c: Column) -> Column:
        """The classifier's probability that a candidate is personal data."""
        if not self.weights:
            return F.lit(0.0)
        known = F.create_map(*[F.lit(x) for kv in self.weights.items() for x in kv])
        names = [F.concat(F.lit("kind="), c["kind"]), *[F.concat(F.lit(f"{x}="), c[x].cast("string")) for x in [*LABELERS, "length"]]]
        total = F.lit(self.weights.get("", 0.0))
        for n in names:
            total = total + F.coalesce(F.try_element_at(known, n), F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def estimate(patterns: list[dict], rounds: int = 40, smoothing: float = 0.5) -> tuple[list[float], dict[str, float]]:
    """Expectation-maximisation over counted vote patterns: probabilities of each, and labelers' reliabilities.

    A pattern has ``kind``, a vote of each labeler and its count ``n``. Votes
    are independent given the truth; each kind has a share of true spans.
    """
    truth = []
    for p in patterns:
        balance = sum(p[x] for x in LABELERS)
        truth.append(1 / (1 + math.exp(-balance)))
    for _ in range(rounds):
        share, says = {}, {}
        for p, t in zip(patterns, truth, strict=True):
            yes, all_ = share.get(p["kind"], (smoothing, 2 * smoothing))
            share[p["kind"]] = yes + p["n"] * t, all_ + p["n"]
            for x in LABELERS:
                for y, w in ((1, t), (0, 1 - t)):
                    says[x, p[x], y] = says.get((x, p[x], y), smoothing) + p["n"] * w
        total = {(x, y): sum(says.get((x, v, y), smoothing) for v in (-1, 0, 1)) for x in LABELERS for y in (0, 1)}
        truth = []
        for p in patterns:
            yes, all_ = share[p["kind"]]
            odds = math.log(yes / (all_ - yes)) if 0 < yes < all_ else 0.0
            for x in LABELERS:
                odds += math.log(says[x, p[x], 1] / total[x, 1]) - math.log(says[x, p[x], 0] / total[x, 0])
            truth.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    agree = {}
    for x in LABELERS:
        right = wrong = smoothing
        for p, t in zip(patterns, truth, strict=True):
            right += p["n"] * (t if p[x] > 0 else 1 - t if p[x] < 0 else 0)
            wrong += p["n"] * (1 - t if p[x] > 0 else t if p[x] < 0 else 0)
        agree[x] = right / (right + wrong)
    return truth, agree


def train(rows: list[dict], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> SpanModel:
    """The classifier, trained on counted patterns with their estimated probabilities."""
    if not rows:
        return SpanModel()
    truth, agree = estimate(rows)
    features = [["", f"kind={p['kind']}", *[f"{x}={p[x]}" for x in [*LABELERS, "length"]]] for p in rows]
    total = sum(p["n"] for p in rows)
    weights = {f: 0.0 for fs in features for f in fs}
    for _ in range(rounds):
        slope = {f: decay * w for f, w in weights.items()}
        for p, t, fs in zip(rows, truth, features, strict=True):
            z = max(-30.0, min(30.0, sum(weights[f] for f in fs)))
            error = p["n"] / total * (1 / (1 + math.exp(-z)) - t)
            for f in fs:
                slope[f] += error
        for f in weights:
            weights[f] -= rate * slope[f]
    return SpanModel(agree, weights)


def patterns(found: DataFrame, name: str = "candidates") -> DataFrame:
    """The candidates' kinds, votes and length classes, and how often each of these occurs."""
    keys = ["kind", *LABELERS, "length"]
    # explode would add filters on the array, which Spark moves below it with another copy of all patterns
    each = found.select(F.explode_outer(name).alias("c")).filter("c is not null")
    return each.select(*[F.col(f"c.{k}").alias(k) for k in keys]).groupBy(*keys).agg(F.count("*").alias("n")).orderBy(*keys)


def fit(found: DataFrame, name: str = "candidates") -> SpanModel:
    """Learn from the candidates of all documents; only counted patterns come to the driver."""
    return train([r.asDict() for r in patterns(found, name).collect()])


def kept_spans(found: Column, model: SpanModel) -> Column:
    """Base spans and the candidates that the classifier adds."""
    return F.filter(found, lambda c: c["base"] | (model.probability(c) >= 0.5))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["a"].cast("string"), c["b"].cast("string"))), ",")


def _only(kind: str, name: Column) -> Column:
    return F.when(name == kind, name).otherwise("")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and places of personal data in every text."""
    found = reliable(with_candidates(docs.select(id_col, text_col), text_col).select(id_col, "candidates"))
    model = fit(found)
    base = F.filter("candidates", lambda c: c["base"])
    kinds = F.transform(base, lambda c: c["kind"])
    counts = [F.size(F.array_remove(F.transform(kinds, partial(_only, k)), "")).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(
        F.col(id_col), *counts, F.sha2(written(base), 256).alias("base_sha256"), written(kept_spans(F.col("candidates"), model)).alias("spans")
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``; in the text each span found is replaced by its kind in angle brackets.

    Of overlapping spans the first gives the name. Two passes over the texts:
    one counts the vote patterns, one rewrites.
    """
    model = fit(with_candidates(docs.select(text_col), text_col))
    name = "__candidates"
    while name in docs.columns:
        name = "_" + name
    spans = F.array_sort(F.transform(kept_spans(F.col(name), model), lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"), c["kind"].alias("kind"))))
    text = F.col(text_col)
    rewritten = _let(F.struct(spans.alias("spans"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks")), _rewritten)
    out = with_candidates(docs, text_col, name)
    return out.withColumn(text_col, F.when(F.size(kept_spans(F.col(name), model)) > 0, rewritten).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])


def _between(blocks: Column, a: Column, b: Column) -> Column:
    """Characters a to b (exclusive) of a text in blocks of ``BLOCK`` characters."""
    first, last = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
    head = F.substring(F.get(blocks, first), a - first * BLOCK + 1, F.least(b - a, F.lit(BLOCK)))
    middle = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    tail = F.when(last > first, F.left(F.get(blocks, last), b - last * BLOCK)).otherwise("")
    return F.when(b > a, F.concat(head, middle, tail)).otherwise("")


def _rewritten(x: Column) -> Column:
    """The text with a name in the place of each run of overlapping spans."""
    blocks = x["blocks"]

    def joined(y: Column) -> Column:
        # a run begins where a span starts at or behind the end of all before it
        ends = running(F.transform(y["spans"], lambda s: s["b"]), "int", lambda p, q: F.greatest(p, q))
        return F.filter(F.zip_with(y["spans"], ends, lambda s, end: F.struct(s["a"].alias("a"), end.alias("end"), s["kind"].alias("kind"))), lambda r: r["a"] >= r["end"])

    def written_out(y: Column) -> Column:
        parts = F.transform(y["runs"], lambda r: F.concat(_between(blocks, r["end"], r["a"]), F.lit("<"), F.upper(r["kind"]), F.lit(">")))
        total = F.aggregate(blocks, F.lit(0), lambda n, block: n + F.length(block))
        return F.concat(F.array_join(parts, ""), _between(blocks, F.array_max(F.transform(x["spans"], lambda s: s["b"])), total))

    return _let(F.struct(joined(x).alias("runs")), written_out)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all ``documents``."""
    return find(table(spark, sf_dir, "documents"))
