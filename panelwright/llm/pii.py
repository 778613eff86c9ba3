"""Personal data by weak supervision, in DataFrame operations only.

Base spans come from fixed patterns with a check each (``BASE``), leftmost and without overlap by kind, and
always stay. Wider patterns (``WIDER``) give more candidates of each kind, and a kind of secrets. On every
candidate four labelers vote yes, no or nothing: the shape of the match, a gazetteer (top-level domains, calling
codes, issuer digits, reserved networks, key prefixes), words in the text before it, and the characters around
it. The votes of all documents are counted by pattern, together with three features of the span itself (length,
share of digits, case), some thousands of rows at most whatever the number of documents; from the votes
expectation-maximisation estimates each labeler's reliability and the probability that a candidate is real, and
a logistic classifier of votes and features is fitted to these, which judges the wider candidates.

Places of matches are prefix sums in blocks, and overlaps are found by a sorted sweep, so the cost of a text
grows with its length and not with the square of its matches.

Edge cases: a null text counts as empty; overlapping candidates of a wider pattern give way to base spans;
repeated rows are judged each; without candidates nothing is fitted and base spans alone are returned;
offsets are code points, ends exclusive; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.arrays import let

KINDS = ("email", "ip", "card", "phone", "secret")

#: Possessive forms, which neither backtrack over long runs nor recurse once a repeat (a greedy group with a choice in it does). A match begins where the last one ended or where its run begins.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDER = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?:(?: ?[\[(]dot[\])] ?|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+",
}
#: A text without these has no match; asking is cheaper than the pattern.
NEEDS = {"base_email": "@", "base_phone": "+", "wider_email": "at", "wider_ip": ":"}

GAZETTEER = {
    "email": r"(?i)(\.|dot[\])] ?)([a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|cloud|online|site|example|test)$",
    "ip": r"^(?!0+\.|127\.|255\.|22[4-9]\.|23[0-9]\.|0+:0+:0+:0+:)",
    "card": r"^[3-6]",
    "phone": r"^\(?\+?(1|3[0-9]|4[0-9]|5[0-9]|6[0-9]|7|8[0-9]|9[0-9]|[2-9][0-9]{2}\)?[ .-])",
    "secret": r"^(gh[opusr]_|github_pat_|AKIA|ASIA|sk-|sk_|pk_|rk_|xox|glpat-|npm_|AIza|ya29|eyJ|SG\.)",
}
BEFORE = {
    "email": r"(?i)(mail|contact|write|reply|address|from|to)\W{0,3}$",
    "ip": r"(?i)(\bip|host|addr|server|client|from)\W{0,3}$",
    "card": r"(?i)(card|visa|credit|debit|payment|pan)\W{0,3}$",
    "phone": r"(?i)(tel|phone|call|fax|mobile|cell|contact)\W{0,3}$",
    "secret": r"(?i)(token|key|secret|password|passwd|pwd|auth|bearer|credential)\W{0,6}$",
}
AGAINST = r"(?i)(\bv|version|isbn|issn|doi|order|invoice|commit|sha\d*|hash|digest|id|no|http\S*)\W{0,3}$"
LABELERS, TRAITS = 4, 3
#: Values that a prefix sum handles one after another.
BLOCK = 64


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    digits = F.split(F.reverse(_digits(v)), "")
    total = F.aggregate(
        F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) - F.when(d.cast("int") > 4, 9).otherwise(0))), F.lit(0), lambda a, d: a + d
    )
    return total % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(_digits(v)).between(13, 19), _luhn(v)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    if kind == "secret":
        return v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    return F.lit(True)


SPAN = "array<struct<s:int,e:int,v:string>>"


def _matches(pattern: str, needs: str | None) -> Column:
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    return F.when(F.instr("text", needs) > 0, found).otherwise(F.array().cast("array<string>")) if needs else found


def _prefix(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Each value of a non-empty array of ints >= 0 combined with all before it: inside blocks first, then with what the blocks before amount to."""
    empty = lambda: F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("out"))

    def inside(a: Column, x: Column) -> Column:
        now = combine(a["last"], x)
        return F.struct(now.alias("last"), F.concat(a["out"], F.array(now)).alias("out"))

    def across(a: Column, x: Column) -> Column:
        return F.struct(combine(a["last"], F.element_at(x, -1)).alias("last"), F.concat(a["out"], F.array(a["last"])).alias("out"))

    def cut(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / BLOCK).cast("int") - 1), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))

    local = F.transform(let(values, cut), lambda x: F.aggregate(x, empty(), inside, lambda a: a["out"]))
    joined = let(local, lambda y: F.zip_with(y, F.aggregate(y, empty(), across, lambda a: a["out"]), lambda x, t: F.transform(x, lambda v: combine(t, v))))
    return F.flatten(joined)


def _spans(hits: str, pattern: str) -> Column:
    """Places of the matches: the lengths of them and of what lies between them, added up."""
    gaps = F.slice(F.split("text", pattern, -1), 1, F.size(hits))
    sizes = F.zip_with(gaps, F.col(hits), lambda g, h: F.length(g) + F.length(h))
    placed = F.zip_with(hits, _prefix(sizes, lambda a, b: a + b), lambda h, e: F.struct((e - F.length(h)).alias("s"), e.alias("e"), h.alias("v")))
    return F.when(F.size(hits) > 0, placed).otherwise(F.array().cast(SPAN))


def _clear(more: str, base: str) -> Column:
    """The spans of ``more`` that overlap none of ``base``: of the base spans that begin before a span ends, none may end after it begins."""
    asked = F.transform(more, lambda x: F.struct(x["e"].alias("at"), F.lit(0).alias("end"), x.alias("x")))
    said = F.transform(base, lambda b: F.struct(b["s"].alias("at"), b["e"].alias("end"), F.get(more, F.lit(0)).alias("x")))

    def sweep(events: Column) -> Column:
        ends = _prefix(F.transform(events, lambda v: v["end"]), F.greatest)
        judged = F.zip_with(events, ends, lambda v, end: F.struct(((v["end"] == 0) & (end <= v["x"]["s"])).alias("ok"), v["x"].alias("x")))
        return F.transform(F.filter(judged, lambda j: j["ok"]), lambda j: j["x"])

    return F.when((F.size(more) > 0) & (F.size(base) > 0), let(F.sort_array(F.concat(asked, said)), sweep)).otherwise(F.col(more))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text, base, wider): arrays of structs (kind, s, e, v) with kind as a place in ``KINDS``."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    todo = [(f"{part}_{k}", k, p) for part, patterns in (("base", BASE), ("wider", WIDER)) for k, p in patterns.items()]
    hits = rows.select("doc_id", "text", *[_matches(p, NEEDS.get(name)).alias(name) for name, _, p in todo])
    placed = hits.select("doc_id", "text", *[_spans(name, p).alias(name) for name, _, p in todo])

    def checked(name: str, kind: str) -> Column:
        wide = name == "wider_ip"  # eight groups, checked by its pattern
        valid = F.col(name) if wide else F.filter(F.col(name), lambda x: _valid(kind, x["v"]))
        return F.transform(valid, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))

    sure = placed.select("*", F.concat(*[checked(n, k) for n, k, _ in todo if n.startswith("base_")]).alias("base"))
    more = sure.select("doc_id", "text", "base", F.concat(*[checked(n, k) for n, k, _ in todo if n.startswith("wider_")]).alias("more"))
    return more.select("doc_id", "text", "base", _clear("more", "base").alias("wider"))


def _by_kind(kind: Column, patterns: dict[str, str], v: Column) -> Column:
    out = F.lit(False)
    for k, p in patterns.items():
        out = F.when(kind == KINDS.index(k), v.rlike(p)).otherwise(out)
    return out


def _traits(v: Column) -> list[Column]:
    """Features of a span as digits: length, share of digits, and case (no letter, lower, upper, both)."""
    n = F.length(v)
    digits = n - F.length(F.translate(v, "0123456789", ""))
    return [
        F.when(n < 12, "0").when(n < 24, "1").when(n < 40, "2").otherwise("3"),
        F.least(F.floor(digits * 4 / n), F.lit(3)).cast("int").cast("string"),
        (F.when(F.upper(v) != v, 1).otherwise(0) + F.when(F.lower(v) != v, 2).otherwise(0)).cast("string"),
    ]


def _voted(spans: str, base: bool) -> Column:
    """The spans with their votes, 1, -1 or 0, written as digits 2, 0 and 1, and their traits in one string."""

    def vote(yes: Column, no: Column) -> Column:
        return F.when(no, "0").when(yes, "2").otherwise("1")

    def one(x: Column) -> Column:
        kind, v = x["kind"], x["v"]
        left = F.substring(F.col("text"), F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24)))
        right = F.substring(F.col("text"), x["e"] + 1, F.lit(1))
        shape = F.lit("2") if base else vote((kind == KINDS.index("secret")) & v.rlike("^[^0-9]*+[0-9][^A-Za-z]*+[A-Za-z][^0-9]*+[0-9]") & (F.length(v) >= 32) | v.startswith("("), v.rlike("^[a-z]+$|^[A-Za-z]+[/_-][A-Za-z/_-]*$"))
        names = _by_kind(kind, GAZETTEER, v)
        votes = [
            shape,
            vote(names, ~names & kind.isin(KINDS.index("ip"), KINDS.index("card"))),
            vote(_by_kind(kind, BEFORE, left), left.rlike(AGAINST) & ~_by_kind(kind, BEFORE, left)),
            vote(left.rlike(r"(^|[\s\"'(<:=,;|])$") & right.rlike(r"^([\s\"')>.,;|!?]|$)"), left.rlike(r"[\p{L}0-9/]$") | right.rlike(r"^[\p{L}0-9/]")),
        ]
        return F.struct(kind.alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.concat(*votes, *_traits(v)).alias("votes"))

    return F.transform(spans, one)


def vote_counts(found: DataFrame) -> list[tuple[int, str, int]]:
    """(kind, votes and traits, number of candidates) over all documents: at most 81 x 64 rows a kind."""
    voted = found.select(F.explode(F.concat(_voted("base", True), _voted("wider", False))).alias("c"))
    return sorted((r[0], r[1], r[2]) for r in voted.groupBy("c.kind", "c.votes").count().collect())


def estimate(counts: list[tuple[int, str, int]], rounds: int = 25) -> dict[tuple[int, str], float]:
    """(kind, votes) -> the probability that a candidate with these votes is real, by expectation-maximisation for each kind; votes are independent given the truth, each labeler with rates of its own, smoothed."""
    out: dict[tuple[int, str], float] = {}
    for kind in sorted({k for k, _, _ in counts}):
        tally_of: dict[str, int] = {}
        for k, v, n in counts:
            if k == kind:
                tally_of[v[:LABELERS]] = tally_of.get(v[:LABELERS], 0) + n
        rows = sorted(tally_of.items())
        real = {v: 1 / (1 + math.exp(-sum(int(c) - 1 for c in v))) for v, _ in rows}
        for _ in range(rounds):
            yes = sum(n * real[v] for v, n in rows)
            prior = (yes + 1) / (sum(n for _, n in rows) + 2)
            rate = []
            for j in range(LABELERS):
                tally = {True: {"0": 0.5, "1": 1.0, "2": 2.0}, False: {"0": 2.0, "1": 1.0, "2": 0.5}}
                for v, n in rows:
                    tally[True][v[j]] += n * real[v]
                    tally[False][v[j]] += n * (1 - real[v])
                rate.append({t: {c: x / sum(tally[t].values()) for c, x in tally[t].items()} for t in tally})
            for v, _ in rows:
                a, b = prior, 1 - prior
                for j in range(LABELERS):
                    a, b = a * rate[j][True][v[j]], b * rate[j][False][v[j]]
                real[v] = a / (a + b)
        out |= {(kind, v): p for v, p in real.items()}
    return out


#: Weights of the classifier: kind, yes votes, no votes, and for each kind the values of the traits.
N_WEIGHTS = len(KINDS) + 2 * LABELERS + len(KINDS) * TRAITS * 4


def _trait_at(kind: int, j: int) -> int:
    return len(KINDS) + 2 * LABELERS + (kind * TRAITS + j) * 4


def _features(kind: int, votes: str) -> list[float]:
    x = [float(kind == k) for k in range(len(KINDS))] + [float(c == "2") for c in votes[:LABELERS]] + [float(c == "0") for c in votes[:LABELERS]]
    x += [0.0] * (N_WEIGHTS - len(x))
    for j, c in enumerate(votes[LABELERS:]):
        x[_trait_at(kind, j) + int(c)] = 1.0
    return x


def train(counts: list[tuple[int, str, int]], rounds: int = 300) -> list[float]:
    """Weights of the final classifier: logistic regression of votes and traits on the estimated probabilities, weighted by the logarithm of the counts."""
    if not counts:
        return [0.0] * N_WEIGHTS
    target = estimate(counts)
    x = np.array([_features(k, v) for k, v, _ in counts])
    y, n = np.array([target[k, v[:LABELERS]] for k, v, _ in counts]), np.log1p([n for _, _, n in counts])
    w = np.zeros(N_WEIGHTS)
    for _ in range(rounds):
        w -= 2.0 * (0.01 * w + x.T @ (n * (1 / (1 + np.exp(-x @ w)) - y)) / n.sum())
    return w.tolist()


def _accepted(spans: str, w: list[float]) -> Column:
    def score(x: Column) -> Column:
        total = F.element_at(F.array(*[F.lit(a) for a in w[: len(KINDS)]]), x["kind"] + 1)
        for j in range(LABELERS):
            c = F.substring(x["votes"], j + 1, 1)
            total += F.when(c == "2", w[len(KINDS) + j]).when(c == "0", w[len(KINDS) + LABELERS + j]).otherwise(0.0)
        traits = F.array(*[F.lit(a) for a in w[len(KINDS) + 2 * LABELERS :]])
        for j in range(TRAITS):
            total += F.element_at(traits, (x["kind"] * TRAITS + j) * 4 + F.substring(x["votes"], LABELERS + j + 1, 1).cast("int") + 1)
        return total

    return F.filter(F.col(spans), lambda x: score(x) > 0)


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _number(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = candidates(docs)
    w = train(vote_counts(found))
    plain = lambda spans: F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    voted = found.select("doc_id", "base", _voted("wider", False).alias("wider"))
    return voted.select(
        "doc_id",
        *[_number(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])],
        F.sha2(_written(plain("base")), 256).alias("base_sha256"),
        _written(F.concat(plain("base"), plain(_accepted("wider", w)))).alias("spans"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
