"""Personal data spans by weak supervision, with DataFrame functions only.

Candidates are base matches (fixed patterns and checks; always kept) and looser
forms of the same kinds plus names. Five labelers vote on every candidate (yes,
no, or nothing): its format, a gazetteer of its kind, cue words before it, the
characters around it, and its digits. Votes are counted by pattern, so
expectation-maximisation over the labelers' reliabilities sees at most a few
hundred rows however large the corpus is. Its posteriors weight the counts from
which the span classifier (naive Bayes over discrete span features) is trained.
The classifier decides which loose candidates are added; one that overlaps a
base span never is.

Positions are code points, the end is exclusive. Patterns run in linear time on
long runs of one character: a match may start only where its run starts, and
repetitions do not give back.

A text's cost grows with its length and its matches, not with their product:
positions are running sums taken block by block, places in a text are looked up
in pieces, and overlaps are found by binary search.

Defined cases: a null or empty text has no span; repeated rows are answered one
by one; without candidates nothing is learnt and nothing added; an empty table
gives no rows; a candidate whose odds are even (0) is added.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import free_name
from flowtide.session import materialize

KINDS = ("email", "ip", "card", "phone", "name")

# Base patterns. `\G` lets a match start right after the one before it.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Looser forms: (kind, a cheap sign that one may be there, pattern).
_LOOSE = (
    ("email", r"(?i)[\[(]at[\])]", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[a-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[a-z0-9-]++)++"),
    ("ip", r":[0-9a-fA-F]{1,4}:", r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])"),
    ("card", r"[0-9]{4}[\x20-][0-9]{4}", r"(?<![0-9])(?:[0-9]{4}[\x20-]){3}[0-9]{1,4}(?![0-9])"),
    ("phone", r"[0-9]{3}[).\x20-]", r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[.\x20-])[0-9]{3,4}[.\x20-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])"),
    ("name", r"(?:Mr|Mrs|Ms|Dr|Prof)[.\x20]", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]++(?:\x20[A-Z][a-z]++)?"),
)

# What the gazetteer labeler knows of each kind: reserved or common endings, issuer numbers, dialling forms, given names.
_GAZETTEER = {
    "email": r"(?i)(?:\.|dot[\])]\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ca|it|nl|ch)$",
    "ip": r"^(?:10|127|172|192|169|[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\.|^[23][0-9a-fA-F]{3}:|^fe80:",
    "card": r"^(?:4|5[1-5]|3[47]|6(?:011|5)|2[2-7])",
    "phone": r"^\+?(?:1|33|34|44|49|39|31|41)[\x20(.-]|^\(?[2-9][0-9]{2}\)?[\x20.-]",
    "name": r"\x20(?:James|John|Robert|Michael|David|William|Mary|Anna|Maria|Linda|Sarah|Laura|Peter|Paul|Thomas|Hans|Pierre|Jean|Jose|Juan|Carlos|Ana)(?:\x20|$)",
}
_CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|login|from|dirección|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|tarjeta|carte|karte)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|teléfono|téléphone|telefon|handy)\b",
    "name": r"(?i)\b(?:by|dear|from|sincerely|signed|patient|author|contact)\b",
}
_COUNTER_CUES = r"(?i)\b(?:version|release|isbn|order|invoice|page|figure|table|section|serial|token|key|hash|id)\b"
VOTES = 5
BLOCK = 64
PIECE = 256

_SPAN = "array<struct<start:int,end:int,kind:int,base:boolean,match:string>>"


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, start: Column, join) -> Column:
    """For each element what `join` makes of `start` and all elements before it.

    Worked out block by block, then over the blocks, so that appending to arrays costs a bounded part of the length.
    """
    none = F.array().cast("array<int>")

    def grown(state: Column, value: Column) -> Column:
        return F.struct(join(state["at"], value).alias("at"), F.array_append(state["out"], state["at"]).alias("out"))

    def all_before(steps: Column, first: Column, value) -> Column:
        return F.aggregate(steps, F.struct(first.alias("at"), none.alias("out")), lambda state, i: grown(state, value(i)), lambda state: state["out"])

    def over(v: Column) -> Column:
        def inside(k: Column) -> Column:
            return F.sequence(k * BLOCK, F.least(F.size(v), k * BLOCK + BLOCK) - 1)

        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        totals = F.transform(blocks, lambda k: F.aggregate(inside(k), start, lambda t, i: join(t, F.get(v, i))))
        begins = let(totals, lambda t: all_before(t, start, lambda x: x))
        parts = let(begins, lambda g: F.transform(blocks, lambda k: all_before(inside(k), F.get(g, k), lambda i: F.get(v, i))))
        return F.when(F.size(v) > 0, F.flatten(parts)).otherwise(none)

    return let(values, over)


def pieces_of(text: Column) -> Column:
    """The text in pieces of PIECE code points, so that a place in it is found without reading what is before."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """The code points [start, end) of a text in pieces."""
    first = F.floor(start / PIECE).cast("int")
    some = F.transform(F.sequence(first, F.greatest(first, F.floor((end - 1) / PIECE).cast("int"))), lambda k: F.get(pieces, k))
    return F.when(end > start, F.substring(F.array_join(some, ""), start - first * PIECE + 1, end - start)).otherwise("")


def _spans(text: Column, pattern: str, kind: int, base: bool, sign: Column, valid) -> Column:
    """Matches with positions: the text between matches gives the distance from one to the next."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("match"))  # one gap more than matches

    def placed(pairs: Column) -> Column:
        steps = F.transform(pairs, lambda p: F.char_length(p["gap"]) + F.coalesce(F.char_length(p["match"]), F.lit(0)))

        def span(pair: Column, before: Column) -> Column:
            start = before + F.char_length(pair["gap"])
            found = F.struct(start.alias("start"), (start + F.char_length(pair["match"])).alias("end"), F.lit(kind).alias("kind"), F.lit(base).alias("base"), pair["match"].alias("match"))
            return F.when(pair["match"].isNotNull() & valid(pair["match"]), found)

        at = running(steps, F.lit(0), lambda a, b: a + b)
        return let(at, lambda before: F.array_compact(F.transform(pairs, lambda p, i: span(p, F.get(before, i)))))

    return F.when(sign, let(zipped, placed).cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _small_parts(match: Column) -> Column:
    """Every part of a dotted number is at most 255."""

    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.char_length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(match, r"\."), small)


def luhn(digits: Column) -> Column:
    """Weighted digit sum is a multiple of ten; every second digit from the right counts double."""
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _card(match: Column) -> Column:
    d = _digits(match)
    return F.when(F.char_length(d).between(12, 19), luhn(d)).otherwise(False)


def base_spans(text: Column) -> list[Column]:
    """The base matches of each kind."""
    always = F.lit(True)
    return [
        _spans(text, _EMAIL, 0, True, F.contains(text, F.lit("@")), lambda m: always),
        _spans(text, _IP, 1, True, text.rlike(r"[0-9]\.[0-9]"), _small_parts),
        _spans(text, _CARD, 2, True, text.rlike(r"[0-9][\x20-]?[0-9]"), _card),
        _spans(text, _PHONE, 3, True, F.contains(text, F.lit("+")), lambda m: F.char_length(_digits(m)).between(9, 15)),
    ]


def loose_spans(text: Column) -> Column:
    return F.concat(*[_spans(text, pattern, KINDS.index(kind), False, text.rlike(sign), lambda m: F.lit(True)) for kind, sign, pattern in _LOOSE])


def _by_kind(span: Column, tables: dict[str, str], value: Column) -> Column:
    out = F.lit(False)
    for i, kind in enumerate(KINDS):
        if kind in tables:
            out = F.when(span["kind"] == i, value.rlike(tables[kind])).otherwise(out)
    return out


def _judged(pieces: Column, span: Column) -> Column:
    """A candidate with the labelers' votes ('1', '0' or '-' each) and its feature values."""
    before = _cut(pieces, F.greatest(span["start"] - 40, F.lit(0)), span["start"])
    left = F.substring(before, -1, 1)
    right = F.coalesce(_cut(pieces, span["end"], span["end"] + 1), F.lit(""))
    n = F.char_length(_digits(span["match"]))
    separated = span["match"].rlike(r"[\x20().@-]")

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, "1").when(no, "0").otherwise("-")

    word = r"^[A-Za-z0-9_]$"
    embedded = left.rlike(word) | right.rlike(word)
    digits_fit = F.when(span["kind"] == 2, n.between(13, 19)).when(span["kind"] == 3, n.between(9, 13)).when(span["kind"] == 1, n.between(4, 32))
    votes = F.concat(
        vote(span["base"], F.lit(False)),
        vote(_by_kind(span, _GAZETTEER, span["match"]), ~span["base"]),
        vote(_by_kind(span, _CUES, before), before.rlike(_COUNTER_CUES)),
        vote(~embedded, embedded),
        vote(F.coalesce(digits_fit, F.lit(False)), F.coalesce(~digits_fit, F.lit(False))),
    )
    side = F.when(left == "", "^").when(left.rlike(r"^\s$"), "_").when(left.rlike(word), "w").otherwise(".")
    features = F.concat_ws(
        "|",
        F.concat(F.lit("kind="), span["kind"].cast("string")),
        F.concat(F.lit("digits="), F.least(n, F.lit(20)).cast("string")),
        F.concat(F.lit("left="), side),
        F.concat(F.lit("split="), separated.cast("string")),
        F.concat(F.lit("cue="), F.substring(votes, 3, 1)),
        F.concat(F.lit("known="), F.substring(votes, 2, 1)),
    )
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), span["kind"].alias("kind"), span["base"].alias("base"), votes.alias("votes"), features.alias("features"))


def candidates(docs: DataFrame, text: str = "text", name: str = "candidates") -> DataFrame:
    """Adds every candidate of each whole text, base spans first; loose ones that overlap a base span are left out."""
    taken = [*docs.columns, name]
    own = [free_name(n, taken) for n in ("_text", "_base", "_loose", "_spans", "_pieces")]
    t, base, loose, spans, pieces = (F.col(f"`{n}`") for n in own)
    out = docs.withColumn(own[0], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    kinds = [free_name(f"_base{k}", taken) for k in range(4)]
    out = out.select("*", *[c.alias(n) for c, n in zip(base_spans(t), kinds, strict=True)], loose_spans(t).alias(own[2]))

    def free(span: Column) -> Column:
        clear = F.lit(True)
        for n in kinds:
            clear = clear & ~_meets(F.col(f"`{n}`"), span)
        return clear

    out = out.withColumn(own[1], F.concat(*[F.col(f"`{n}`") for n in kinds])).withColumn(own[3], F.filter(loose, free))
    out = out.withColumn(own[3], F.concat(base, spans)).withColumn(own[4], F.when(F.size(spans) > 0, pieces_of(t)))
    return out.withColumn(name, F.transform(spans, lambda s: _judged(pieces, s))).drop(*own, *kinds)


def _meets(spans: Column, other: Column) -> Column:
    """Whether a span overlaps any of the given ones, which are in order and apart: a binary search for the first that ends behind its start."""
    n = F.size(spans)
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(n + 1)).cast("int") + 1)

    def halve(state: Column, _: Column) -> Column:
        mid = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        behind = F.get(spans, mid)["end"] > other["start"]
        closer = F.when(behind, F.struct(state["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct((mid + 1).alias("lo"), state["hi"].alias("hi")))
        return F.when(state["lo"] < state["hi"], closer).otherwise(state)

    first = F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve, lambda state: state["lo"])
    return F.when(n == 0, False).otherwise(F.coalesce(F.get(spans, first)["start"] < other["end"], F.lit(False)))


def reliabilities(patterns: Sequence[tuple[str, int]], rounds: int = 50, smoothing: float = 1.0) -> tuple[float, list[tuple[float, float]], dict[str, float]]:
    """EM over (votes, count): the share of true candidates, per labeler P(yes | true) and P(yes | false), and each pattern's posterior."""

    def majority(votes: str) -> float:
        yes, no = votes.count("1"), votes.count("0")
        return (yes + 0.5) / (yes + no + 1.0)

    posterior = {v: majority(v) for v, _ in patterns}
    prior, rates = 0.5, [(0.5, 0.5)] * VOTES
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        prior = min(max(sum(n * posterior[v] for v, n in patterns) / max(total, 1), 1e-6), 1 - 1e-6)
        rates = []
        for k in range(VOTES):
            cells = defaultdict(float)
            for v, n in patterns:
                if v[k] != "-":
                    cells[True, v[k]] += n * posterior[v]
                    cells[False, v[k]] += n * (1 - posterior[v])
            rates.append(tuple((cells[t, "1"] + smoothing * (0.8 if t else 0.2)) / (cells[t, "1"] + cells[t, "0"] + smoothing) for t in (True, False)))
        for v, _ in patterns:
            z = math.log(prior / (1 - prior))
            for k, c in enumerate(v):
                if c != "-":
                    t, f = rates[k]
                    z += math.log(t / f) if c == "1" else math.log(max(1 - t, 1e-9) / max(1 - f, 1e-9))
            posterior[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    return prior, rates, posterior


def train(found: DataFrame, name: str = "candidates") -> dict[str, float]:
    """Log-odds by feature value (key '' is the base rate), from the candidates of the whole corpus.

    Only counts by vote pattern and feature pattern reach the driver: both have a fixed number of values.
    """
    spans = found.select(F.explode(name).alias("s")).select("s.votes", "s.features")
    counts = [(r.votes, r.features, r["count"]) for r in spans.groupBy("votes", "features").count().orderBy("votes", "features").collect()]
    if not counts:
        return {}
    patterns: dict[str, int] = defaultdict(int)
    for votes, _, n in counts:
        patterns[votes] += n
    _, _, posterior = reliabilities(sorted(patterns.items()))
    true, false = defaultdict(float), defaultdict(float)
    for votes, features, n in counts:
        for f in ["", *features.split("|")]:
            true[f] += n * posterior[votes]
            false[f] += n * (1 - posterior[votes])
    odds = {"": math.log((true[""] + 1) / (false[""] + 1))}
    for f in true:
        if f:
            odds[f] = math.log((true[f] + 1) / (true[""] + 2)) - math.log((false[f] + 1) / (false[""] + 2))
    return odds


def decide(found: DataFrame, odds: dict[str, float], name: str = "candidates", out: str = "spans") -> DataFrame:
    """Adds the kept spans in order of start and kind: all base ones, and loose ones the classifier believes."""
    weights = F.create_map(*[F.lit(x) for kv in odds.items() for x in kv]) if odds else F.lit(None).cast("map<string,double>")

    def believed(span: Column) -> Column:
        total = F.aggregate(F.split(span["features"], r"\|"), F.lit(float(odds.get("", 0.0))), lambda z, f: z + F.coalesce(F.try_element_at(weights, f), F.lit(0.0)))
        return span["base"] | (total >= 0)

    kept = F.filter(name, believed)
    order = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base")))
    return found.withColumn(out, F.array_sort(order))


def find_spans(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), out: str = "spans") -> DataFrame:
    """Kept columns plus the spans of every whole text; the candidates are written once and read twice."""
    name = free_name("_candidates", [*keep, text, out])
    found = candidates(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])]), text, name)
    found = materialize(found.select(*[F.col(f"`{c}`") for c in keep], name), "personal-data")
    return decide(found, train(found, name), name, out).drop(name)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one mark."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def whole(pieces: Column) -> Column:
        def part(s: Column, seen: Column) -> Column:
            """The gap before a span and its mark, if it begins behind all that was seen; nothing otherwise."""
            return F.when(s["start"] >= seen, F.concat(_cut(pieces, seen, s["start"]), F.get(names, s["kind"]))).otherwise("")

        upto = running(F.transform(spans, lambda s: s["end"]), F.lit(0), F.greatest)
        marked = let(upto, lambda seen: F.array_join(F.transform(spans, lambda s, i: part(s, F.get(seen, i))), ""))
        rest = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(marked, _cut(pieces, rest, F.char_length(text)))

    return F.when(F.size(spans) > 0, let(pieces_of(text), whole)).otherwise(text)
